"""Levels, filters and key ranges of the stream's ids."""

import pytest
from conftest import values

from tallyproof.streaming import index


def batch(spark, ids, series="A"):
    return spark.createDataFrame([(i, s) for i in ids for s in (None, series)], "entity_id string, series string")


def names(numbers):
    return [f"NCT{n:08d}" for n in numbers]


def stored(spark, table, live):
    return sorted(values(spark.read.parquet(*[f.path(table) for f in live]), "entity_id", "series"), key=repr)


def test_fifty_batches_open_few_files(spark, tmp_path):
    table, live, expected, most = str(tmp_path), [], [], 0
    for number in range(50):
        ids = names(range(number, 2000, 50)) if number % 2 else names(range(2000 + 40 * number, 2040 + 40 * number))
        assert index.live_files(spark, table, number) == live
        index.clean(spark, table, number, live)
        if number in (3, 17, 49):
            rows = batch(spark, ids)
            assert index.candidates(rows, table, live) == [], "new ids open nothing"
            again = names([1, 2000, 2001])  # of batches 1 and 0
            opened = index.candidates(batch(spark, again), table, live)
            held = {i for i, _ in values(index.known(batch(spark, again), table, live), "entity_id", "series")}
            assert held >= set(again) and len(opened) <= 2
            # a batch that is run again replaces its own
            index.append(rows.where("entity_id > 'NCT00000100'"), table, number, live, 4, 700)
        live = sorted(index.append(batch(spark, ids), table, number, live, 4, 700), key=lambda f: (f.level, f.run, f.name))
        expected += [(i, s) for i in ids for s in (None, "A")]
        most = max(most, len({f.run for f in live}))
    assert stored(spark, table, live) == sorted(expected, key=repr)
    assert most <= 3 * 3 and max(f.level for f in live) == 2
    assert sum(f.rows for f in live) == 4000 and all(f.rows < 2000 for f in live)
    # of the runs on disk, only those of the last two versions are left
    assert len(index._numbers(spark, f"{table}/ids", "run")) <= most + 4
    by_run = {}
    for f in live:
        by_run.setdefault(f.run, []).append((f.low, f.high))
    for ranges in by_run.values():
        assert all(a[1] < b[0] for a, b in zip(sorted(ranges), sorted(ranges)[1:])), "files of a run do not overlap"


def test_filters_let_every_stored_id_through(spark, tmp_path):
    table = str(tmp_path)
    ids = names(range(0, 30_000, 10))
    live = index.append(batch(spark, ids), table, 0, [], file_rows=2000)
    assert len(live) == 3 and {f.level for f in live} == {0}
    for some in (ids[:1], ids[-1:], ids[1000:1003]):
        found = index.known(batch(spark, some), table, live)
        assert {i for (i,) in values(found, "entity_id")} >= set(some)
    between = names(range(5, 30_000, 10))
    alone = [i for i in between[:40] if index.candidates(batch(spark, [i]), table, live)]
    assert len(alone) <= 1
    assert index.known(batch(spark, ["ZZZ"]), table, live) is None
    assert index.known(batch(spark, [None]), table, live) is None


def test_nothing_stored(spark, tmp_path):
    table = str(tmp_path)
    assert index.live_files(spark, table, 5) == [] and index.known(batch(spark, ["a"]), table, []) is None
    live = index.append(batch(spark, []), table, 0, [])
    assert sum(f.rows for f in live) == 0
    live = index.append(batch(spark, ["a"]), table, 1, index.live_files(spark, table, 1))
    assert stored(spark, table, [f for f in live if f.rows]) == [("a", "A"), ("a", None)] or len(live) == 1


@pytest.mark.parametrize("before", [0, 1])
def test_versions_before_a_batch(spark, tmp_path, before):
    table = str(tmp_path)
    index.append(batch(spark, ["a"]), table, 0, [])
    index.append(batch(spark, ["b"]), table, 1, index.live_files(spark, table, 1))
    assert [f.low for f in index.live_files(spark, table, before)] == ["a"][:before]
