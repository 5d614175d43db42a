"""Mixing against its SQL, its targets against a direct calculation, and the defined edge cases."""

from collections import defaultdict

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from tallyproof.llm import mixing, queries
from tallyproof.llm.registry import ORACLES

SF = "/root/testdata/sf0.001"


def expected_targets(sizes, weights=(5.0, 2.0, 1.0), repeats=3):
    """Share by weight, cap, share the rest again."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(repeats * sizes[n] for n in capped)
        open_weight = sum(weight[n] for n in names if n not in capped)
        target = {n: repeats * sizes[n] if n in capped else rest * weight[n] / open_weight for n in names}
        above = {n for n in names if n not in capped and target[n] > repeats * sizes[n]}
        if not above:
            return target
        capped |= above


def test_query_equals_sql(spark):
    name = "op5_mixing"
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_shares_at_a_larger_size(spark):
    rows = queries.op5_mixing(spark, "/root/testdata/sf0.01").join(
        queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "source"), "doc_id"
    ).collect()
    sizes, taken, target, largest = (defaultdict(int) for _ in range(4))
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    assert target == pytest.approx(expected_targets(sizes))
    assert sum(taken.values()) <= sum(sizes.values())
    assert all(abs(taken[s] - target[s]) <= 2 * max(largest.values()) for s in sizes)


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"a": 1, "b": 1000, "c": 5, "d": 2000, None: 7},
        {"a": 0, "b": 10},
        {"é": 50, "z": 60, "Z": 70, "": 80},
        {None: 3},
    ],
)
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    rows, budget = mixing.targets(table)
    assert {r.source: r.target for r in rows.collect()} == pytest.approx(expected_targets(sizes))
    assert budget == sum(sizes.values())


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (None, "one two", None), (4, "x " * 50, "c"), (4, "x " * 50, "c"), (5, "y " * 30_000, "d")],
        "doc_id long, text string, source string",
    ).withColumns({c: F.lit(1) for c in ("size", "row", "turn", "target", "_copies")})
    rows = mixing.mix(docs).collect()
    assert len(rows) == 6
    by = {(r["_k_id"], r.source): r for r in rows}
    assert (by[1, "a"].size, by[1, "a"].taken, by[1, "a"].target) == (0, 0, 0.0)
    assert by[None, None].source_size == 2
    again = mixing.mix(docs).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    copies = mixing.mixed(docs).collect()
    total = sum(r.taken // r.size for r in rows if r.size)
    assert len(copies) == total and set(copies[0].asDict()) == set(docs.columns)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0
