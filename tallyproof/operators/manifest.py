"""One-row tables of what a result rests on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_MATCHING = "NO_MATCHING_TRIALS"
NOT_CHARTABLE = "NO_CHARTABLE_DATA"
NOT_IN_SAMPLE = "NO_MATCHES_IN_FETCHED_SAMPLE"


def fetch_totals(searches: DataFrame) -> DataFrame:
    """Over ``(fetched, capped, total_matching)`` rows, one per search: largest reported total
    and whether any search is incomplete.

    A search is complete when it fetched at least its reported total. Without a reported total
    it is incomplete only if its cap stopped it.
    """
    complete = F.col("fetched") >= F.col("total_matching")
    truncated = F.coalesce(~complete, F.col("capped"))
    return searches.agg(
        F.max("total_matching").alias("total_matching"),
        F.coalesce(F.bool_or(truncated), F.lit(False)).alias("truncated"),
    )


def empty_reason(
    records: int, result_rows: int, fetched: int, truncated: bool, has_local_filter: bool
) -> str | None:
    """Why a result is empty; None when it is not."""
    if records == 0:
        if fetched > 0 and truncated and has_local_filter:
            return NOT_IN_SAMPLE
        return NO_MATCHING
    return NOT_CHARTABLE if result_rows == 0 else None


def provenance(pages: DataFrame) -> DataFrame:
    """``(source)``: every file read. File tables without that column have ``_metadata``."""
    source = "source" if "source" in pages.columns else "_metadata.file_path"
    return pages.select(F.col(source).alias("source")).distinct()
