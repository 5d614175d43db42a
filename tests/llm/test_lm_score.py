"""Language-model scores: the unigram part against brute force, the model against its own definition."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyproof.llm import lm_score, maxent, queries

SF = "/root/testdata/sf0.001"


def tokens_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def expected(rows):
    train = Counter(t for i, x in rows for t in tokens_of(x) if zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1)
    n, v = sum(train.values()), len(train)
    result = {}
    for ident, text in rows:
        tokens = tokens_of(text)
        base = sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        result[ident] = (len(tokens), sum(train[t] > 0 for t in tokens), n, base)
    return result


def test_base_scores_equal_brute_force(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    want = expected([tuple(r) for r in docs])
    rows = queries.op2_lm_score(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)


def test_model_beats_the_unigrams_on_held_out_texts(spark):
    held = queries.op2_lm_score(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1] * 0.99 > held[1] * 1.2 or held[0] > 0.98 * held[1]


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame(
        [(i, "the cat sat on the mat" if i % 2 else "le chat est sur le tapis rouge") for i in range(40)], "doc_id long, text string"
    )
    return docs, lm_score.fit(docs, most_words=9)


def test_probabilities_add_up(small):
    """Over the vocabulary and all other words together, in any context."""
    _, fitted = small
    model, vocabulary = fitted.model, fitted.vocabulary
    assert vocabulary.size <= 10 and fitted.rare > 0
    texts = [b"the cat", b"le chat est unknown words", b"", b"on the the"]
    for text in texts:
        tokens = np.array(vocabulary.read(text)[0])
        one, two = model.contexts(tokens, np.array([0]))
        classes = np.exp(model.classes(model.buckets(one, two)))
        assert classes.sum(axis=1) == pytest.approx(np.ones(len(tokens)), abs=1e-5)
        for row, before in zip(classes, model.class_of[one]):
            own = model.class_of[: vocabulary.size]
            total = (row[own] * np.exp(model.of_word[before])).sum() + row[model.unknown]
            assert total == pytest.approx(1, abs=1e-4)
    unigrams = 10 ** fitted.log10(vocabulary.counts[vocabulary.counts > 0])
    assert unigrams.sum() + fitted.rare == pytest.approx(1)


def test_the_model_grows_with_the_training_tokens(spark, monkeypatch):
    for name, value in (("LEAST_TOKENS", 1000), ("MOST_WORDS", 20)):
        monkeypatch.setattr(lm_score, name, value, raising=False)
    sizes = []
    for n in (40, 640):
        docs = spark.range(n).selectExpr("id as doc_id", "array_join(transform(sequence(1, 24), x -> 'w' || hash(id, x) % 7 * x * x), ' ') as text")
        fitted = lm_score.fit(docs)
        sizes.append((fitted.vocabulary.size, fitted.vocabulary.hashes, fitted.model.weights.shape[1]))
        tokens = np.array(fitted.vocabulary.read(b"w1 w4 unknown w9")[0])
        one, two = fitted.model.contexts(tokens, np.array([0]))
        assert max(k.max() for k in fitted.model.buckets(one, two)) < sizes[-1][2]
        row, after = np.exp(fitted.model.classes(fitted.model.buckets(one, two))), fitted.model.class_of[one]
        own = fitted.model.class_of[: fitted.vocabulary.size]
        for p, before in zip(row, after):
            assert (p[own] * np.exp(fitted.model.of_word[before])).sum() + p[fitted.model.unknown] == pytest.approx(1, abs=1e-4)
        assert lm_score.score(docs, fitted).filter("score > 1e-9 or isnan(score)").count() == 0
    assert sizes[0][0] <= 21 and sizes[0][1:] == (maxent.RARE_HASHES, maxent.BUCKETS)
    assert sizes[1][0] > sizes[0][0] and sizes[1][1:] == (4 * maxent.RARE_HASHES, 4 * maxent.BUCKETS)


def test_score_is_the_models(spark, small):
    """The sum over tokens, with rare words sharing their class by smoothed counts."""
    docs, fitted = small
    model, vocabulary = fitted.model, fitted.vocabulary
    counts = {bytes(r.word): r.c for r in fitted.words.collect()}
    some = spark.createDataFrame([(1, "The cat sat on le tapis"), (2, None), (3, "never seen")], "doc_id long, text string")
    for r in lm_score.score(some, fitted).join(some, "doc_id").collect():
        ids, rare = vocabulary.read((r.text or "").encode())
        total = model.score(np.array(ids), np.array([0])).sum() / math.log(10)
        for word, n in rare.items():
            total += n * (float(fitted.log10(counts.get(word, 0))) - math.log10(fitted.rare))
        assert r.score == pytest.approx(total, rel=1e-6)
    seen = lm_score.score(docs.limit(2), fitted).collect()
    assert all(r.score > r.base_score for r in seen)


def test_gradient_is_that_of_the_likelihood():
    """Observed minus expected counts is the slope of the log-probability of the classes."""
    rng = np.random.default_rng(0)
    words = [maxent.END] + [f"w{i}".encode() for i in range(60)]
    vocabulary = maxent.Vocabulary(words, np.arange(61, 0, -1))
    model = maxent.Model(vocabulary, rng.integers(0, 9, (61, 8)).astype(float), 5.0)
    model.weights = rng.normal(0, 0.3, model.weights.shape).astype(np.float32)
    tokens, starts = rng.integers(0, 61, 400), np.array([0, 100, 101, 250])
    gradient = maxent.Gradient(61)
    model.gradient(tokens, starts, gradient)
    one, two = model.contexts(tokens, starts)
    own = model.class_of[tokens]

    def likelihood():
        rows = model.classes(model.buckets(one, two))
        return rows[np.arange(len(own)), own].sum(dtype=np.float64)

    for kind in range(maxent.FEATURES):
        bucket, label = int(model.buckets(one, two)[kind][7]), int(own[7])
        observed, expected_ = gradient.observed[kind, bucket], gradient.expected[kind, bucket]
        model.weights[kind][bucket][label] += 0.01
        up = likelihood()
        model.weights[kind][bucket][label] -= 0.02
        down = likelihood()
        model.weights[kind][bucket][label] += 0.01
        assert (up - down) / 0.02 == pytest.approx(observed[label] - expected_[label], abs=0.05)
    of_kind, summed = maxent.BUCKETS // maxent.SHARD, maxent.Gradient(61)
    for shard, data in [*gradient.shards(), *gradient.shards()]:
        kind, number = divmod(shard, of_kind)
        if kind >= maxent.FEATURES:
            maxent.add_shard(data, summed.words[shard - maxent.FEATURES * of_kind])
        else:
            both = np.zeros((maxent.SHARD, 2 * maxent.CLASSES), np.float32)
            maxent.add_shard(data, both)
            some = slice(number * maxent.SHARD, (number + 1) * maxent.SHARD)
            summed.observed[kind, some] += both[:, : maxent.CLASSES]
            summed.expected[kind, some] += both[:, maxent.CLASSES :]
    assert summed.words.sum() == 2 * gradient.words.sum() == 800
    assert (summed.observed == 2 * gradient.observed).all() and (summed.expected == 2 * gradient.expected).all()


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (None, "one two"), (4, "one two"), (4, "one two"), (5, "é É " * 60_000)], "doc_id long, text string"
    ).withColumns({c: F.lit("clash") for c in ("row", "rare", "word", "c", "score", "slice")})
    rows = lm_score.score(docs, lm_score.fit(docs)).collect()
    assert len(rows) == 6
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_tokens, by[2].n_tokens, by[4].n_tokens, by[5].n_tokens) == (1, 1, 3, 120_001)
    assert by[1].score == by[2].score and by[None].score == by[4].score
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in rows)
    nothing = lm_score.fit(docs, lambda ident: F.lit(False))
    rows = lm_score.score(docs, nothing).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)
    assert lm_score.score(docs.limit(0), nothing).count() == 0
