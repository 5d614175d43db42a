"""Nearest-neighbour voting: features and votes against plain versions, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyproof.llm import quality_knn, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    rows = queries.op8_quality_knn(spark, SF).collect()
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    return {r.doc_id: r for r in rows}, texts, labels


def plain_features(text):
    kinds = quality_knn._CLASS
    counts, words = {}, text.encode().split()
    for i, w in enumerate(words):
        cell = int(kinds[w[0]]) * 16 + int(kinds[w[-1]])
        counts[cell] = counts.get(cell, 0) + 1
        if i + 1 < len(words):
            cell = 256 + int(kinds[w[-1]]) * 16 + int(kinds[words[i + 1][0]])
            counts[cell] = counts.get(cell, 0) + 1
    if words:
        share = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        counts[quality_knn.BLOCKS[-1][0] + sum(share > b for b in quality_knn.REPEATS)] = 1
    return counts


def test_features_equal_a_plain_version():
    texts = ["", "One, two two two! |", " \n", "É ÀB x y 12%", "a a a b", "THE!! END###"]
    rows = quality_knn.features([t.encode() for t in texts])
    first = quality_knn.BLOCKS[2][0]
    for text, row in zip(texts, rows):
        found = {i: int(row[i]) for i in np.flatnonzero(row) if not first <= i < first + quality_knn.WORDS}
        assert found == plain_features(text)
        assert row[first : first + quality_knn.WORDS].sum() == len(text.encode().split())
    together = quality_knn.features([b"alpha beta", b"beta alpha"])
    assert (together[0, first:] == together[1, first:]).all()


def test_hash_does_not_depend_on_the_place():
    data = np.frombuffer(b"word other word", np.uint8)
    hashes = quality_knn.word_hashes(data, np.array([0, 5, 11]), np.array([4, 10, 15]))
    assert hashes[0] == hashes[2] != hashes[1]


def test_votes_equal_brute_force(spark, scored):
    _, texts, labels = scored
    learn = [i for i in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    all_counts = quality_knn.features([t.encode() for t in texts.values()])
    rarity = np.log((len(texts) + 1) / ((all_counts > 0).sum(axis=0) + 1)).astype(np.float32) + np.float32(1)
    counts = quality_knn.features([texts[i].encode() for i in sorted(learn)])
    y = np.array([labels[i] for i in sorted(learn)], float)
    voters = quality_knn.Voters(counts, y, rarity, 64, 32, 4)
    vectors = quality_knn._unit(quality_knn._weighted(all_counts, rarity) @ voters.basis)
    for (ident, text), vector in zip(texts.items(), vectors):
        products = voters.voters @ vector
        nearest = np.argsort(-products)[:32]
        weight = np.maximum(products[nearest], 0).astype(float) ** 4
        want = (weight * y[nearest]).sum() / weight.sum() if text.split() else y.mean()
        assert scored[0][ident].score == pytest.approx(want, abs=2e-3)


def test_held_out_accuracy(scored):
    rows, _, labels = scored
    held = [i for i in labels if rows[i].held_out]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    assert len(held) > 50 and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.predicted == (r.score >= 0.7) for r in rows.values())
    assert np.mean([rows[i].predicted == labels[i] for i in held]) > 0.95


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, "Some good words."), (1, "Some good words."), (2, "bad### bad###"), (3, None), (4, ""), (None, "x " * 200_000), (5, "other")],
        "doc_id long, text string",
    ).withColumns({c: F.lit("clash") for c in ("score", "label", "id", "quality", "counts")})
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (2, 0), (5, None), (77, 1), (None, 0)], "doc_id long, quality int"
    ).withColumn("text", F.lit("clash"))
    voters = quality_knn.fit(docs, labels)
    assert len(voters.labels) == 2 and voters.prior == 0.5
    rows = quality_knn.score(docs, voters).collect()
    assert len(rows) == 7
    score = {r.doc_id: r.score for r in rows}
    assert score[3] == score[4] == 0.5 and score[1] > 0.9 > 0.1 > score[2]
    bounded = quality_knn.fit(docs, labels, most_labelled=1)
    assert len(bounded.labels) == 1
    nothing = quality_knn.fit(docs, labels.limit(0))
    assert {r.score for r in quality_knn.score(docs, nothing).collect()} == {0.5}
    empty = docs.limit(0)
    assert quality_knn.score(empty, quality_knn.fit(empty, labels)).count() == 0


def test_words_carry_the_space():
    """Of texts of equal shapes those with the same words are nearer; without shapes nothing else counts."""
    one, same, other = (quality_knn.features([t]) for t in (b"red apples and green pears.", b"green apples and red pears.", b"tin soldiers can catch trams."))
    rarity = np.ones(quality_knn.Space().features, dtype=np.float32)
    a, b, c = (quality_knn._unit(quality_knn._weighted(x, rarity)) for x in (one, same, other))
    assert (a @ b.T).item() > 0.99 > 0.5 > (a @ c.T).item() - 0.1
    squares = [w**2 for _, w in quality_knn.BLOCKS]
    assert squares[2] / sum(squares) > 0.5
    few = quality_knn.Space(words=64, shape_weight=0.0, repeat_weight=0.0)
    counts = quality_knn.features([b"THE!!", b"the"], few)
    assert counts.shape == (2, few.features)
    assert (quality_knn._weighted(counts, np.ones(few.features, np.float32), few)[:, :512] == 0).all()
