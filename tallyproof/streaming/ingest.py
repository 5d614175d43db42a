"""Incremental ingest of landed pages into a study table, with everything that is not stored there.

A table is a folder of five tables, each with a part per batch:

- ``studies``: the first arrival of each usable id;
- ``membership``: ``(series, entity_id)`` as listed by the searches, each pair once;
- ``refused``: listed rows without a usable id, with their place;
- ``malformed``: ``(source, problem)`` of pages whose shape is not the documented one;
- ``ids``: the stored ids and pairs, which later batches compare themselves with (`index`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.functions import fixed_values as V
from tallyproof.sources.pages import (
    admit,
    first_writer,
    malformed_pages,
    parse_pages,
    series_of_studies,
    studies_of_pages,
)
from tallyproof.streaming import index

SOURCE_ORDER = ["search_no", "page_no", "pos"]


@dataclass(frozen=True)
class Batch:
    """What one batch of pages adds to each table."""

    studies: DataFrame
    membership: DataFrame
    refused: DataFrame
    malformed: DataFrame

    def counts(self) -> DataFrame:
        """``(table, rows)``: nothing that was landed goes uncounted."""
        parts = [
            df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
            for name, df in self.tables().items()
        ]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def tables(self) -> dict[str, DataFrame]:
        return {
            "studies": self.studies,
            "membership": self.membership,
            "refused": self.refused,
            "malformed": self.malformed,
        }


def split_batch(
    pages: DataFrame,
    known_ids: DataFrame | None = None,
    known_membership: DataFrame | None = None,
    pattern: str = V.STUDY_ID_PATTERN,
) -> Batch:
    """Pages, and the ``(entity_id)`` and ``(series, entity_id)`` stored before, to what is new.

    A study that is stored already still becomes a member of the series that lists it now.
    """
    usable, refused = admit(studies_of_pages(pages), "entity_id", pattern)
    fresh = first_writer(usable, "entity_id", SOURCE_ORDER)
    members = series_of_studies(usable)
    if known_ids is not None:
        fresh = fresh.join(known_ids.select("entity_id"), "entity_id", "left_anti")
    if known_membership is not None:
        pair = ["series", "entity_id"]
        members = members.join(known_membership.select(*pair), pair, "left_anti")
    return Batch(fresh, members, refused.select(*SOURCE_ORDER, "series", "entity_id"), malformed_pages(pages))


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Pages as they land."""
    documents = (
        spark.readStream.option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .text(path)
    )
    return parse_pages(documents.select("value", F.col("_metadata.file_path").alias("source")))


def append_new(
    pages: DataFrame, table: str, batch_id: int, pattern: str = V.STUDY_ID_PATTERN, strict: bool = False
) -> None:
    """Append what one batch adds to each table.

    Every batch has its own folders, and a batch that is run again after a failure compares itself
    with earlier batches only and replaces its own, so nothing is stored twice. Of the ids stored
    before, a batch reads the files that may hold its own. ``strict`` fails a
    batch with malformed pages or refused rows, after writing these two tables; its files are then
    read again when the query is started anew.
    """
    spark = pages.sparkSession
    pages = pages.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        listed = studies_of_pages(pages).select("entity_id")
        live = index.live_files(spark, table, batch_id)
        index.clean(spark, table, batch_id, live)
        stored = index.known(listed, table, live)
        ids = members = None
        if stored is not None:
            ids = stored.where(F.col("series").isNull())
            members = stored.where(F.col("series").isNotNull())
        batch = split_batch(pages, ids, members, pattern)

        def write(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{table}/{name}/batch={batch_id}")

        write(batch.malformed, "malformed")
        write(batch.refused, "refused")
        if strict:
            faults = sum(spark.read.parquet(f"{table}/{n}/batch={batch_id}").count() for n in ("malformed", "refused"))
            if faults:
                raise ValueError(f"batch {batch_id} has {faults} malformed pages or refused rows")
        write(batch.studies, "studies")
        write(batch.membership, "membership")
        mine = spark.read.schema("entity_id string").parquet(f"{table}/studies/batch={batch_id}")
        pairs = spark.read.schema("series string, entity_id string").parquet(f"{table}/membership/batch={batch_id}")
        both = mine.select("entity_id", F.lit(None).cast("string").alias("series")).unionByName(pairs)
        index.append(both, table, batch_id, live)
    finally:
        pages.unpersist()


def ingest(
    spark: SparkSession,
    pages: str,
    table: str,
    checkpoint: str,
    pattern: str = V.STUDY_ID_PATTERN,
    strict: bool = False,
):
    """Start a query that ingests what has landed so far and stops.

    First arrival of an id wins. The stored tables are the only state, so nothing grows in memory
    and an id may come back at any later time.
    """
    return (
        stream_pages(spark, pages)
        .writeStream.foreachBatch(
            lambda batch, batch_id: append_new(batch, table, batch_id, pattern, strict)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
