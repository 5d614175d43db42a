"""Rows by rank, against sorting all of them."""

import datetime
import random

import pytest
from conftest import values
from pyspark.sql import functions as F

from tallyproof import session
from tallyproof.operators import selection
from tallyproof.operators.citations import cite


def ordered(rows, columns):
    return sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in columns])


@pytest.mark.parametrize("most_sorted", [1, 20, 100_000])
@pytest.mark.parametrize(
    "schema, draw",
    [
        ("a int, b string", lambda r: (r.choice([None, 0, 0, 1, 7, 2**31 - 1]), r.choice(["", "x", "xé", "xy" * 9, "xy" * 9 + "z", None]))),
        ("a bigint, b int", lambda r: (r.choice([2**62, 2**62 + 1, -(2**63), 5]), r.randrange(9))),
        ("a string, b int", lambda r: (f"NCT{r.randrange(300):08d}", r.randrange(9))),
        ("a date, b timestamp", lambda r: (datetime.date(2000, 1, 1 + r.randrange(3)), datetime.datetime(1999, 5, 1, r.randrange(3)))),
        ("a double, b int", lambda r: (r.choice([0.5, float("inf"), -1e300]), r.randrange(5))),
    ],
)
def test_first_rows(spark, schema, draw, most_sorted):
    rng = random.Random(len(schema))
    rows = [draw(rng) for _ in range(120)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    for n in (0, 1, 2, 37, 119, 120, 500):
        found = values(selection.first_rows(df, ["a", "b"], n, 4, most_sorted), "a", "b")
        assert sorted(found, key=repr) == sorted(ordered(rows, [0, 1])[:n], key=repr), n


def test_a_cap_sorts_one_range(spark, monkeypatch):
    """Of 50,000 rows only the range of the last one is sorted, and nothing is written."""
    sizes = []
    real = selection.DataFrame.orderBy if hasattr(selection, "DataFrame") else None
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).alias("k"), F.lit(0).alias("search"))
    frame = type(df)
    real = frame.orderBy

    def counted(self, *columns, **more):
        sizes.append(self.count())
        return real(self, *columns, **more)

    monkeypatch.setattr(frame, "orderBy", counted)
    monkeypatch.setattr(session, "stored", lambda *_: pytest.fail("nothing is written"))
    found = selection.first_rows(df, ["search", "k"], 33_333, 64, 100)
    assert [r.k for r in found.select("k").collect() if r.k >= 33_333] == [] and found.count() == 33_333
    assert len(sizes) == 1 and sizes[0] <= 100


@pytest.mark.parametrize("ranges", [1, 7, 1 << 16])
@pytest.mark.parametrize("kind", ["string", "bigint", "double"])
def test_rows_at_ranks(spark, kind, ranges):
    rng = random.Random(3)
    ids = sorted(rng.sample(range(100_000), 400))
    key = {"string": lambda i: f"NCT{i:08d}", "bigint": lambda i: i, "double": float}[kind]
    rows = [(g, s, key(i)) for i in ids for g, s in (("all", None), ("few", "x") if i % 50 == 0 else ("some", "x"))]
    df = spark.createDataFrame(rows, f"g string, s string, id {kind}").repartition(4)
    found = selection.rows_at_ranks(df, ["g", "s"], "id", lambda n: F.array(F.lit(0).cast("long"), F.floor(n / 3), n - 1), ranges=ranges)
    groups = {}
    for g, s, i in rows:
        groups.setdefault((g, s), []).append(i)
    expected = {(g, s, len(v), at, v[r]) for (g, s), v in groups.items() for at, r in enumerate((0, len(v) // 3, len(v) - 1))}
    assert set(values(found, "g", "s", "total", "nth", "id")) == expected


def test_citations_sort_little_of_a_large_datum(spark, monkeypatch):
    """The rows that are ranked are those of a few ranges."""
    df = spark.range(40_000).select(F.lit("all").alias("key"), F.format_string("NCT%08d", F.col("id") * 3).alias("entity_id"))
    near = []
    real = selection.broadcast_if_small

    def seen(table):
        if "_start" in table.columns:
            near.append(table.count())
        return real(table)

    monkeypatch.setattr(selection, "broadcast_if_small", seen)
    found = cite(df, ["key"], 5)
    assert [(r.ordinal, r.entity_id, r.total) for r in found.orderBy("ordinal").collect()] == [
        (i + 1, f"NCT{n * 3:08d}", 40_000) for i, n in enumerate((0, 10_000, 20_000, 29_999, 39_999))
    ]
    assert near == [5]


def test_broadcast_by_bytes(spark):
    """A table of few rows that are wide is not broadcast."""
    wide = spark.range(20).selectExpr("id", "repeat('x', 1000000) as label")
    narrow = spark.range(20).selectExpr("id", "'x' as label", "array(1, 2) as list")

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    assert not hinted(session.small(wide, 20)) and hinted(session.small(narrow, 20))
    assert not hinted(session.small(narrow, session.BROADCAST_ROWS + 1))
    assert hinted(session.small(spark.range(5), 5))


def test_kept_tables_are_computed_in_small_tasks(spark, monkeypatch):
    advisory, files = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
    coalesce = "spark.sql.adaptive.coalescePartitions"
    small = {advisory: 1024, f"{coalesce}.minPartitionSize": 1, f"{coalesce}.initialPartitionNum": 32}
    monkeypatch.setattr(session, "TASK_SETTINGS", {**session.TASK_SETTINGS, **small})
    rows = spark.range(20_000).withColumn("g", F.col("id") % 5_000)
    counts = session.durable(rows.groupBy("g").agg(F.collect_list("id").alias("ids")))
    assert len(counts.inputFiles()) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.conf.get(advisory, None) is None
    spark.conf.set(files, "1m")
    try:
        with session.small_tasks(spark):
            assert (spark.conf.get(files), spark.conf.get(advisory)) == ("1m", "1024")
        assert spark.conf.get(files) == "1m"
    finally:
        spark.conf.unset(files)


def test_rows_at_ranks_are_a_written_table(spark):
    found = selection.rows_at_ranks(spark.range(100).withColumn("g", F.lit("a")), ["g"], "id", lambda n: F.array(n - 1))
    assert found.inputFiles() and [tuple(r) for r in found.collect()] == [("a", 100, 0, 99)]
