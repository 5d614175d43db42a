"""Collocations against brute force, tiles against plain counts, and the defined cases."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyproof.llm import collocations as C
from tallyproof.llm import queries


def brute(rows, longest=3, least=10, percent=50, most=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    found = {}
    for (lang, words), a in counts.items():
        if len(words) < 2 or a < least:
            continue
        longer = [c for (x, w), c in counts.items() if x == lang and len(w) > len(words) and c >= least
                  and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if any(100 * c >= percent * a for c in longer):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return {
        (lang, rank + 1, p.decode(), -a, x, y, totals[lang], -score)
        for lang, some in found.items()
        for rank, (score, a, p, x, y) in enumerate(sorted(some)[:most])
    }


def texts(seed, n, words, size):
    rng = np.random.default_rng(seed)
    names = [f"W{i}" if i % 3 else f"w{i}é" for i in range(words)]
    ends = np.array([" ", " ", " ", "  \t", ". ", "\n", "! "])
    result = []
    for i in range(n):
        some = np.minimum(rng.zipf(1.5, size) - 1, words - 1)
        result.append((["en", "fr", None, "und"][i % 4], "".join(names[w] + e for w, e in zip(some, rng.choice(ends, size)))))
    return result


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def rows_of(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("settings", [{}, {"longest": 4, "least": 5}, {"longest": 2}, {"least": 40, "percent": 90, "most": 7}])
def test_equals_brute_force(spark, settings):
    rows = texts(1, 60, 50, 300)
    found = C.collocations(frame(spark, rows).repartition(5), **settings)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(found) == brute(rows, **settings) != set()


def test_words_and_phrases_without_addresses(spark):
    """The same with next to no addresses, tiny tiles and slices, and counts passed on often."""
    rows = texts(2, 40, 80, 250)
    sizes = C.Sizes(words=6, grams=5, word_bytes=2, side=1, buffer=64, passed=10, filter_bits=64, held_words=20, slice=40)
    assert rows_of(C.collocations(frame(spark, rows), sizes=sizes)) == brute(rows)


def test_tiles():
    rng = np.random.default_rng(3)
    left, right = np.minimum(rng.zipf(1.3, 200_000), 60_000), np.minimum(rng.zipf(1.3, 200_000), 9_000)
    for side in (1, 4, 9):
        a, b, n = C.tile_counts(left, right, side)
        assert Counter(dict(zip(zip(a.tolist(), b.tolist()), n.tolist()))) == Counter(zip(left.tolist(), right.tolist()))
    assert len(C.tile_counts(left[:0], right[:0], 9)[2]) == 0


def test_numbers_of_words_are_those_of_spark(spark):
    rows = [("en", b"word"), ("", b"\xc3\xa9"), ("a:1", b"x" * 100), ("é", b"")]
    df = spark.createDataFrame(rows, "lang string, word binary").withColumn("id", C._hash_number(7))
    assert [r.id for r in df.collect()] == [C._number(w, C._prefix(lang, 7)) for lang, w in rows]


def test_colliding_words_get_another_seed(spark, monkeypatch):
    rows = [("en", f"first{i % 3} second{i % 2} third. " * 3) for i in range(60)]
    real = C._hash_number
    tried = []

    def hashed(seed):
        tried.append(seed)
        return F.lit(C._HASHED) if seed == 0 else real(seed)

    monkeypatch.setattr(C, "_hash_number", hashed)
    assert rows_of(C.collocations(frame(spark, rows), sizes=C.Sizes(words=1))) == brute(rows)
    assert tried == [0, 1]


def test_edges(spark):
    long = "word " * 4000 + "é " * 2000
    rows = [("en", None), (None, ""), ("en", " \t. ,"), ("fr", long), ("fr", long), ("x\0", "a\0b c. " * 12), ("", "one two " * 9)]
    clash = {c: F.lit("clash") for c in ("word", "c", "id", "w1", "a", "n", "rank", "_text")}
    assert rows_of(C.collocations(frame(spark, rows).withColumns(clash))) == brute(rows)
    assert C.collocations(frame(spark, rows[:3])).count() == 0
    assert C.collocations(frame(spark, rows).limit(0)).count() == 0


def test_exact_beyond_64_bits(spark):
    df = spark.sql("select 900000000000000 as a, 900000000000001 as l1, 900000000000007 as r1").select(C._score(1, 1_000_000).alias("s"))
    assert df.first().s == 1_000_000 * 900000000000000**2 // (900000000000001 * 900000000000007)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in queries.table(spark, sf, "documents").collect()]
    assert rows_of(queries.op13_collocations(spark, sf)) == brute(rows)
