"""Series: labelled subsets of the entities, many-to-many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.functions.text import series_identity


def collapse_series(definitions: DataFrame, order: str = "ord") -> DataFrame:
    """Keep the first of the series definitions ``(label, ..., ord)`` with equal identity."""
    first = Window.partitionBy(series_identity(F.col("label"))).orderBy(order)
    return (
        definitions.withColumn("_nth", F.row_number().over(first))
        .where(F.col("_nth") == 1)
        .drop("_nth")
    )


def series_of_terms(definitions: DataFrame, attributes: DataFrame) -> DataFrame:
    """``(series, entity_id)`` for definitions ``(label, term)`` over ``(entity_id, term)`` rows.

    Terms are compared by series identity, so the match is an equi-join of any size.
    """
    wanted = definitions.select(
        F.col("label").alias("series"), series_identity(F.col("term")).alias("_term")
    )
    have = attributes.select("entity_id", series_identity(F.col("term")).alias("_term")).distinct()
    return have.join(wanted, "_term").select("series", "entity_id").distinct()


def series_where(entities: DataFrame, id_col: str, predicates: dict[str, Column]) -> DataFrame:
    """``(series, entity_id)`` of an entity table, one predicate per series, in one scan."""
    labels = F.array_compact(
        F.array(*[F.when(p, F.lit(label)) for label, p in predicates.items()])
    )
    return entities.select(F.explode(labels).alias("series"), F.col(id_col).alias("entity_id"))
