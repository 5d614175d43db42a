"""Study records from landed pages.

A page is one JSON document: ``searchNo``, ``pageNo``, optional ``series``, ``totalCount`` and
``dataTimestamp``, and the ``studies`` array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyproof import schema as S
from tallyproof.functions import fixed_values as V
from tallyproof.operators.selection import first_rows
from tallyproof.session import stored

def parse_pages(documents: DataFrame, strict: bool = False) -> DataFrame:
    """Pages of a table of whole JSON documents ``(value, source)``.

    Parsed by an expression over all fields of the schema: a file reader would skip fields that a
    query does not use, and with them the faults in those fields.
    """
    options = {
        "mode": "FAILFAST" if strict else "PERMISSIVE",
        "columnNameOfCorruptRecord": S.CORRUPT,
    }
    schema = T.StructType([f for f in S.PAGE if not strict or f.name != S.CORRUPT])
    page = F.from_json("value", schema, options)
    return documents.select("source", F.inline(F.array(page)))


def read_pages(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """One row per page, with the file it came from. ``strict`` fails on a malformed page."""
    documents = spark.read.text(path, wholetext=True)
    return parse_pages(documents.select("value", F.col("_metadata.file_path").alias("source")), strict)


def malformed_pages(pages: DataFrame) -> DataFrame:
    """``(source, problem)`` of pages whose shape is not the documented one."""
    token = F.schema_of_variant("nextPageToken")
    problem = F.when(F.col(S.CORRUPT).isNotNull(), "wrong type or not an object").when(
        ~token.isin("STRING", "VOID"), "page token is not a string"
    )
    return pages.select("source", problem.alias("problem")).where("problem is not null")


def studies_of_pages(pages: DataFrame) -> DataFrame:
    """One row per listed study with ``(search_no, page_no, pos)``, its place in source order."""
    return pages.select(
        F.col("searchNo").alias("search_no"),
        F.col("pageNo").alias("page_no"),
        "series",
        F.posexplode("studies").alias("pos", "_study"),
    ).select(
        "search_no",
        "page_no",
        "pos",
        "series",
        F.col(S.ID_PATH.replace("protocolSection", "_study.protocolSection")).alias("entity_id"),
        "_study.protocolSection",
    )


def admit(df: DataFrame, id_col: str, pattern: str = V.STUDY_ID_PATTERN):
    """Rows with a usable id, and the others."""
    usable = F.coalesce(F.col(id_col).rlike(pattern), F.lit(False))
    return df.where(usable), df.where(~usable)


def first_writer(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """One row per id, the first in source order.

    The row limit is applied before the shuffle too, so an id repeated in a large share of the
    rows costs one row per task.
    """
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    return df.withColumn("_nth", nth).where(F.col("_nth") == 1).drop("_nth")


def union_first(parts: list[DataFrame], id_col: str, order: list[str]) -> DataFrame:
    """Union of several searches, each entity once."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return first_writer(whole, id_col, order)


def capped(df: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows in source order; only the range in which the last of them lies is sorted."""
    return first_rows(df, order, cap)


def split_cap(
    searches: dict[str, DataFrame], id_col: str, order: list[str], cap: int
) -> tuple[DataFrame, dict[str, dict]]:
    """Share one cap over several searches, in order.

    Each search gets an equal part of what is left after the *distinct* ids read so far; what it
    does not use goes to the later ones. A search with no share stays as an empty series. Returns
    ``(series, id)`` rows and per-series facts. The loop runs once per named series; each series'
    ids are written once, and counted from what was written.
    """
    read: DataFrame | None = None
    facts: dict[str, dict] = {}
    left = len(searches)
    for label, rows in searches.items():
        seen = 0 if read is None else read.select(id_col).distinct().count()
        budget = max(0, (cap - seen) // left)
        left -= 1
        total = rows.count()
        facts[label] = {
            "share": budget,
            "fetched": min(budget, total),
            "total_matching": total,
            "capped": total > budget,
        }
        first = capped(rows.select(id_col, *[c for c in order if c != id_col]), order, budget)
        part = stored(first.select(F.lit(label).alias("series"), id_col), "series")
        read = part if read is None else read.unionByName(part)
    return read, facts


def search_facts(pages: DataFrame) -> DataFrame:
    """Per search: studies listed and the total its first page with a total reports."""
    return pages.groupBy(F.col("searchNo").alias("search_no")).agg(
        F.sum(F.coalesce(F.size("studies"), F.lit(0))).alias("fetched"),
        F.min_by("totalCount", F.when(F.col("totalCount").isNotNull(), F.col("pageNo"))).alias(
            "total_matching"
        ),
        F.max("dataTimestamp").alias("data_as_of"),
    )


def data_as_of(pages: DataFrame) -> DataFrame:
    return pages.agg(F.max("dataTimestamp").alias("data_as_of"))


def series_of_studies(studies: DataFrame) -> DataFrame:
    """``(series, entity_id)`` as listed by the searches."""
    return studies.where(F.col("series").isNotNull()).select("series", "entity_id").distinct()
