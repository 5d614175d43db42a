"""License scans against brute force on words, planted notices, and the defined cases."""

import re

import pytest
from pyspark.sql import functions as F

from tallyproof.llm import license_scan, queries

SF = "/root/testdata/sf0.001"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def base_of(text):
    words = words_of(text)
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(texts[r.doc_id]), r.doc_id
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)


def test_base_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    check(queries.op12_license_scan(spark, SF).collect(), texts)


def scanned(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return license_scan.labels(*license_scan.scan(docs, **more))


def test_notices(spark):
    notice = next(t.text for t in license_scan.TEMPLATES if t.label == "bsd" and len(t.text) > 60)
    words = notice.split()
    texts = {
        1: f"some words before {notice.upper()} and after",
        2: " ".join(["lead"] * 50 + words[:9] + ["kindly", "inserted"] + words[9:]),  # words put in
        3: " ".join(words[:6] + words[7:]),  # a word left out
        4: " ".join(words[:8]),  # less than half of it
        5: " ".join(w if i % 3 else "changed" for i, w in enumerate(words)),
        6: " ".join(w for x in words for w in (x, "between")),
        7: f"{notice} {' '.join(['filler'] * 30)} {notice}",
        8: "released under the mit license or the MIT-License, CC BY-NC 4.0; gnu lesser general public license",
        9: " ".join(reversed(words)),
    }
    rows = scanned(spark, list(texts.items())).collect()
    check(rows, texts)
    by = {r.doc_id: r for r in rows}
    assert sorted(i for i, r in by.items() if r.labels == "bsd") == [1, 2, 3, 7]
    assert by[1].score == by[2].score == 1 and 0.8 <= by[3].score < 1
    assert by[8].labels == "cc-by,cc-by-nc,lgpl,mit" and by[8].base_labels == "cc-by,mit" and by[8].n_base == 3
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = license_scan.scan(docs)[1].filter("label = 'bsd'").collect()
    assert len(spans) == 5 and sorted((s.first, s.last) for s in spans if s.score == 1) == [(0, 20), (3, 23), (50, 72), (51, 71)]


def test_edges(spark):
    long = "é " * 3000 + "mit license " + "x1 " * 5000 + "Apache License"
    texts = {1: None, 2: "", 3: "***", 4: "MIT License", 5: "mit\x00license", 6: long, 7: "mit license " * 3000, 8: "mit"}
    rows = [*texts.items(), (None, "cc by"), (7, texts[7])]
    clash = {c: F.lit("clash") for c in ("row", "_id", "at", "gram", "template", "label", "first", "n_words", "score")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)
    texts[None] = "cc by"
    whole = license_scan.labels(*license_scan.scan(docs)).collect()
    assert len(whole) == 10
    for r in whole:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(texts[r.doc_id])
    assert base_of(texts[7])[1] == 3000 and base_of(texts[4])[1] == 0
    texts_, spans = license_scan.scan(docs.filter("doc_id in (6, 8)"), piece=64)  # pieces are cut anywhere
    assert sorted(license_scan.labels(texts_, spans).collect()) == sorted(r for r in whole if r.doc_id in (6, 8))
    assert license_scan.labels(*license_scan.scan(docs.limit(0))).count() == 0
    assert [r.labels for r in license_scan.labels(*license_scan.scan(docs, templates=())).collect()] == [""] * 10
    with pytest.raises(ValueError):
        license_scan.scan(docs, templates=(license_scan.Template("x", "..."),))


@pytest.mark.parametrize("most", [1, 7, 64])
def test_pieces_have_all_words_and_hashes(most):
    text = ("word " * 10 + "a,b;c " * 20 + "longer-words é中 ").encode() * 3
    assert [w for some in license_scan.word_pieces(text, most) for w in some] == license_scan.words_of(text)
