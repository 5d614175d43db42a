"""Cutting lineage and numbering rows at any size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, BooleanType, DateType, NumericType, StringType, TimestampType

#: A table may be broadcast when it is known to have no more rows than this, none of them wide.
BROADCAST_ROWS = 100_000
#: What a table that is broadcast may take, and what each of its values counts beside its text.
BROADCAST_BYTES, VALUE_BYTES = 8 << 20, 16
#: What a task of a kept table reads of files and of shuffled bytes, which are compressed and take up to forty
#: times as much when they are sorted; and the parts of a shuffle, of which small ones are read together.
TASK_SETTINGS = {
    "spark.sql.files.maxPartitionBytes": 16 << 20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20,
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": 1024,
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor reach, as ``spark.checkpoint.dir`` names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor reach")
    return folder.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """``path`` and its file system, as Hadoop objects of the driver."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends if not before."""
    path = f"{shared_folder(spark)}/tallyproof-{name}-{uuid.uuid4().hex}"
    at, files = _hadoop(spark, path)
    files.deleteOnExit(at)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    at, files = _hadoop(spark, path)
    files.delete(at, True)


_collecting: list[list[str]] = []


@contextmanager
def collected(made: list[str]) -> Iterator[None]:
    """Note in ``made`` the paths of all tables that are written meanwhile. On an error they are
    deleted; else their owner deletes them with `delete_paths`, or the end of the application does."""
    _collecting.append(made)
    try:
        yield
    except BaseException:
        delete_paths(made)
        raise
    finally:
        _collecting.pop()


def delete_paths(made: list[str]) -> None:
    spark = SparkSession.getActiveSession()
    while made and spark is not None:
        delete_path(spark, made.pop())


def stored(df: DataFrame, name: str = "table", made: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back. It is computed once,
    survives a lost executor and is noted in ``made``, whose paths `delete_path` removes."""
    path = scratch_path(df.sparkSession, name)
    for noted in _collecting[-1:]:
        noted.append(path)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """What is computed meanwhile is cut into more tasks the larger it is, so that none holds more of a larger
    table. Settings that the caller has made stay."""
    ours = {name: value for name, value in TASK_SETTINGS.items() if spark.conf.get(name, None) is None}
    for name, value in ours.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in ours:
            spark.conf.unset(name)


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, in small tasks, and read it from the shared folder from then on."""
    with small_tasks(df.sparkSession):
        return stored(df, "kept")


def keep(df: DataFrame, held: list[DataFrame]) -> DataFrame:
    """Persist a table that is read several times, unless its owner already did. What is
    persisted here is noted in ``held``, for unpersisting."""
    level = df.storageLevel
    if not (level.useMemory or level.useDisk):
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def kept(df: DataFrame) -> DataFrame:
    """A table that is read several times: as it is when its owner persisted it, else written."""
    level = df.storageLevel
    return df if level.useMemory or level.useDisk else durable(df)


def bytes_of(df: DataFrame) -> Column:
    """About how many bytes a row takes: its texts, and some for each value."""
    size = F.lit(VALUE_BYTES * len(df.columns))
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif not isinstance(field.dataType, AtomicType):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return size


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast ``df``, which is best a written table, when its bytes are counted to be few enough."""
    total = df.agg(F.coalesce(F.sum(bytes_of(df).cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` when ``rows``, a proven bound on its rows, and their bytes allow it. Tables of
    numbers alone are not counted."""
    if rows > BROADCAST_ROWS:
        return df
    wide = any(not isinstance(f.dataType, (NumericType, BooleanType, DateType, TimestampType)) for f in df.schema.fields)
    return broadcast_if_small(df) if wide else F.broadcast(df)


def _partition_and_row():
    mid = F.monotonically_increasing_id()
    return F.shiftright(mid, 33), mid.bitwiseAND(F.lit((1 << 33) - 1))


def number_rows(
    df: DataFrame, *order: Column | str, name: str = "position", made: list[str] | None = None
) -> DataFrame:
    """1-based position of every row in the total order ``order``, without a one-task window.

    A range-partitioned sort is written with each row's partition and place in it, so that the
    places hold whoever reads them; a row's position is its place plus the sizes of the partitions
    before it. Only that list of sizes, one row per partition, is broadcast.
    """
    part, row = _partition_and_row()
    ordered = stored(df.orderBy(*order).withColumns({"_part": part, "_row": row}), "numbered", made)
    sizes = ordered.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    return (
        ordered.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_row") + 1)
        .drop("_part", "_row", "_start")
    )


def number_report_rows(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """1-based position in a report whose size is bounded by a top-N or a closed vocabulary."""
    rank = F.row_number().over(Window.orderBy(*order))
    return df.withColumn(name, rank.cast("bigint"))


def one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row tables with different columns side by side, without joining them."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])
