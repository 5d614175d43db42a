"""Synonym tables from landed lookup payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof import schema as S


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", S.CORRUPT)
    return reader.json(path, multiLine=True)


def _parsed(documents: DataFrame, schema) -> DataFrame:
    """Payloads of a table of whole JSON documents ``(value)``; what does not parse gives no rows."""
    fields = type(schema)([f for f in schema if f.name != S.CORRUPT])
    return documents.select(F.inline(F.array(F.from_json("value", fields))))


def _candidates(payloads: DataFrame) -> DataFrame:
    return payloads.select(
        F.col("term").alias("name"), F.posexplode("approximateGroup.candidate").alias("rank", "c")
    ).select("name", "c.rxcui", "c.score", F.col("rank").cast("int"))


def _ingredients(payloads: DataFrame) -> DataFrame:
    groups = payloads.select(
        F.coalesce("concept", "relatedGroup.rxcui").alias("rxcui"),
        F.explode("relatedGroup.conceptGroup").alias("g"),
    )
    return groups.select("rxcui", F.explode("g.conceptProperties").alias("p")).select(
        "rxcui",
        F.col("p.rxcui").alias("ingredient_rxcui"),
        F.col("p.name").alias("ingredient_name"),
    )


def candidates_of_documents(documents: DataFrame) -> DataFrame:
    """``(name, rxcui, score, rank)``; rank is the place in the payload. A payload without
    candidates gives no rows."""
    return _candidates(_parsed(documents, S.CANDIDATE_PAYLOAD))


def ingredients_of_documents(documents: DataFrame) -> DataFrame:
    """``(rxcui, ingredient_rxcui, ingredient_name)``."""
    return _ingredients(_parsed(documents, S.INGREDIENT_PAYLOAD))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`candidates_of_documents`, of a folder of payloads."""
    return _candidates(_read(spark, path, S.CANDIDATE_PAYLOAD))


def read_ingredients(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`ingredients_of_documents`, of a folder of payloads."""
    return _ingredients(_read(spark, path, S.INGREDIENT_PAYLOAD))
