"""The ids that a stream has stored, in levels of sorted files with a filter and a key range for each.

Every batch adds a run: the rows it stored, sorted by id, in files of about ``FILE_ROWS`` rows. When a
level has ``FANOUT`` runs they are merged into one of the next level, so a table of n batches has some
``FANOUT * log(n)`` runs, and a row is rewritten once a level. A batch compares itself with the files
whose key range holds one of its ids and whose filter lets that id through, and opens no others.

Next to the runs, in ``ids/run=<batch>``, lie:

- ``index/versions/version=<batch>``: the files that are live after a batch, with level, range and size;
- ``index/filters/run=<batch>``: the filters, as rows of 64 bits. All bits of an id are in one of its file's
  rows, so a look-up is one equi-join; of ids that were never stored about one in several thousand gets
  through, which costs a file and never a wrong result.

A batch that is run again starts from the version before it and replaces its own run, filters and version.
Runs that the last version no longer names are deleted when the next batch begins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.session import BROADCAST_ROWS, _hadoop, delete_path

FANOUT = 8
FILE_ROWS = 1 << 20
#: Of an id, in its file's filter; a filter has a word of 64 bits for every two rows.
BITS = 8

_VERSION = "run long, name string, level int, low string, high string, rows long, words long"


@dataclass(frozen=True)
class File:
    """A live file: the run it belongs to, and what its version says of it."""

    run: int
    name: str
    level: int
    low: str
    high: str
    rows: int
    words: int

    def path(self, table: str) -> str:
        return f"{table}/ids/run={self.run}/{self.name}"


def _numbers(spark: SparkSession, folder: str, key: str) -> list[int]:
    """The numbers of the folders ``key=<number>`` of a folder."""
    at, files = _hadoop(spark, folder)
    if not files.exists(at):
        return []
    names = [status.getPath().getName() for status in files.listStatus(at)]
    return sorted(int(n.removeprefix(f"{key}=")) for n in names if n.startswith(f"{key}="))


def live_files(spark: SparkSession, table: str, before: int) -> list[File]:
    """The files that a batch compares itself with: those of the last version before it."""
    versions = [v for v in _numbers(spark, f"{table}/index/versions", "version") if v < before]
    if not versions:
        return []
    rows = spark.read.schema(_VERSION).parquet(f"{table}/index/versions/version={versions[-1]}").collect()
    return sorted((File(**r.asDict()) for r in rows), key=lambda f: (f.level, f.run, f.name))


def clean(spark: SparkSession, table: str, before: int, live: list[File]) -> None:
    """Delete the runs of earlier batches that no version will need again."""
    used = {f.run for f in live}
    for run in _numbers(spark, f"{table}/ids", "run"):
        if run < before and run not in used:
            delete_path(spark, f"{table}/ids/run={run}")
            delete_path(spark, f"{table}/index/filters/run={run}")
    for version in [v for v in _numbers(spark, f"{table}/index/versions", "version") if v < before][:-1]:
        delete_path(spark, f"{table}/index/versions/version={version}")


def _word(entity_id: Column, words: Column) -> Column:
    return F.pmod(F.xxhash64(entity_id), words)


def _mask(entity_id: Column) -> Column:
    """The bits of an id in its word."""
    hashed = F.xxhash64(F.lit("bits"), entity_id)
    mask = F.lit(0).cast("long")
    for at in range(BITS):
        bit = F.shiftrightunsigned(hashed, 6 * at).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def candidates(ids: DataFrame, table: str, live: list[File]) -> list[File]:
    """The files that may hold one of ``ids(entity_id)``."""
    if not live:
        return []
    spark = ids.sparkSession
    facts = spark.createDataFrame([(i, f.run, f.name, f.low, f.high, f.words) for i, f in enumerate(live)], "file int, run long, name string, low string, high string, words long")
    facts = F.broadcast(facts) if len(live) <= BROADCAST_ROWS else facts
    ids = ids.where(F.col("entity_id").isNotNull()).select("entity_id").distinct()
    inside = ids.join(facts, F.col("entity_id").between(F.col("low"), F.col("high")))
    asked = inside.select("file", "run", "name", _word(F.col("entity_id"), F.col("words")).alias("word"), _mask(F.col("entity_id")).alias("mask"))
    runs = sorted({f.run for f in live})
    filters = spark.read.schema("name string, word long, bits long, run long").parquet(f"{table}/index/filters").where(F.col("run").isin(runs))
    found = asked.join(filters, ["run", "name", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return [live[r.file] for r in found.select("file").distinct().collect()]


def known(ids: DataFrame, table: str, live: list[File]) -> DataFrame | None:
    """``(entity_id, series)`` of the files that may hold one of ``ids``; None when none does."""
    files = candidates(ids, table, live)
    if not files:
        return None
    return ids.sparkSession.read.schema("entity_id string, series string").parquet(*[f.path(table) for f in files])


def append(rows: DataFrame, table: str, batch_id: int, live: list[File], fanout: int = FANOUT, file_rows: int = FILE_ROWS) -> list[File]:
    """Store ``rows(entity_id, series)``, none of which is stored yet, merging levels that are full."""
    spark = rows.sparkSession
    rows, level, merged = rows.select("entity_id", "series"), 0, []
    while len({f.run for f in live if f.level == level}) >= fanout - 1:
        merged += [f for f in live if f.level == level]
        level += 1
    n = rows.count() + sum(f.rows for f in merged)
    if merged:
        old = spark.read.schema("entity_id string, series string").parquet(*[f.path(table) for f in merged])
        rows = rows.unionByName(old)
    run = f"{table}/ids/run={batch_id}"
    dealt = rows.repartitionByRange(max(1, -(-n // file_rows)), "entity_id").sortWithinPartitions("entity_id", "series")
    dealt.write.mode("overwrite").parquet(run)
    written = spark.read.schema("entity_id string, series string").parquet(run).select("entity_id", F.col("_metadata.file_name").alias("name"))
    facts = written.groupBy("name").agg(F.min("entity_id").alias("low"), F.max("entity_id").alias("high"), F.count("*").alias("rows"))
    made = [File(batch_id, r.name, level, r.low, r.high, r.rows, 1 << (max(1, r.rows // 2) - 1).bit_length()) for r in facts.collect()]
    sizes = spark.createDataFrame([(f.name, f.words) for f in made], "name string, words long")
    bits = (
        written.join(F.broadcast(sizes) if len(made) <= BROADCAST_ROWS else sizes, "name")
        .groupBy("name", _word(F.col("entity_id"), F.col("words")).alias("word"))
        .agg(F.bit_or(_mask(F.col("entity_id"))).alias("bits"))
    )
    bits.write.mode("overwrite").parquet(f"{table}/index/filters/run={batch_id}")
    now = [f for f in live if f.level >= level] + made
    version = spark.createDataFrame([(f.run, f.name, f.level, f.low, f.high, f.rows, f.words) for f in now], _VERSION)
    version.coalesce(1).write.mode("overwrite").parquet(f"{table}/index/versions/version={batch_id}")
    return now
