"""Exact deduplication against its SQL and brute force, and the defined edge cases."""

import hashlib
import re
from collections import defaultdict

from compare import connect, difference
from pyspark.sql import functions as F

from tallyproof.llm import exact_dedup, queries
from tallyproof.llm.registry import ORACLES

SF = "/root/testdata/sf0.001"


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def expected(rows):
    groups = defaultdict(list)
    for ident, text in rows:
        groups[plain(text)].append((-len(text or ""), ident is None, ident or 0))
    result = []
    for ident, text in rows:
        group = groups[plain(text)]
        best = min(group)
        keep = None if best[1] else best[2]
        result.append((ident, keep, len(group), hashlib.sha256(plain(text).encode()).hexdigest()))
    return sorted(result, key=repr)


def test_query_equals_sql(spark):
    name = "op7_exact_dedup"
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


ROWS = [
    (1, None),
    (2, " \n"),
    (None, ""),
    (3, "abc"),
    (4, "a b c"),
    (5, "a b\tc"),
    (6, "x" * 40),
    (7, "x" * 41),
    (8, "x" * 39 + " x"),
    (9, "xy" * 37),
    (9, "xy" * 37),
    (None, "null id"),
    (None, "null id"),
    (10, "é" * 33),
    (11, "long text " * 30_000),
    (12, "long  text" * 30_000),
]


def check(spark, **options):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("row", "pos", "n", "name", "block", "kept", "h1")})
    rows = exact_dedup.groups(docs, **options).collect()
    assert sorted([(r["_k_id"], r.keep_id, r.group_size, r.text_sha256) for r in rows], key=repr) == expected(ROWS)
    kept = defaultdict(int)
    for r in rows:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    return docs


def test_edges(spark):
    docs = check(spark, block_bytes=8)
    whole = exact_dedup.one_of_each(docs)
    assert whole.columns == docs.columns
    assert sorted([r.doc_id for r in whole.collect()], key=repr) == sorted([2, 4, 7, 8, 9, None, 10, 11], key=repr)
    assert exact_dedup.groups(docs.limit(0)).count() == 0
    assert exact_dedup.one_of_each(docs.limit(0)).count() == 0


def test_identity_does_not_rest_on_hashes(spark):
    """With hashes that always collide, the bytes themselves are named."""

    def poor(block):
        return [F.octet_length(block).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")]

    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    rows = exact_dedup.identities(docs, block_bytes=8, hashes=poor).collect()
    names = defaultdict(set)
    for r in rows:
        names[r["round"], r["name"]].add(r.text_sha256)
    assert all(len(v) == 1 for v in names.values())
    assert len(names) == len({plain(t) for _, t in ROWS}) and len(rows) == len(ROWS)
