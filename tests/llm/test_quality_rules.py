"""Quality rules against brute force, and the defined edge cases."""

import re
from collections import Counter

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from tallyproof.llm import quality_rules, queries
from tallyproof.llm.registry import ORACLES

SF = "/root/testdata/sf0.001"
SENTENCE = "Many readers enjoy long stories about ships, storms and distant islands. "
PROSE = "\n".join(" ".join(f"w{a}x{b}" for b in range(12)) + "." for a in range(9))


def expected(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "base_failed": len(words) < 50 or 100 * len(inside) > 50 * len(words),
    }


def test_query_counts_equal_brute_force(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    rows = queries.op1_quality_rules(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for row in rows:
        want = expected(texts[row.doc_id])
        assert {k: row[k] for k in want} == want
        assert not (row.base_failed and row.kept)


def test_query_equals_sql(spark):
    name = "op1_quality_rules"
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_labelled_documents(spark):
    """Documents labelled good are kept unless a base rule rejects them; bad ones are not."""
    rows = queries.op1_quality_rules(spark, "/root/testdata/sf0.01").join(
        queries.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id"
    )
    assert rows.filter("kept != (quality = 1 and not base_failed)").count() == 0


@pytest.mark.parametrize(
    "line, rule",
    [
        ("and### the&&& of$$$ with***", "symbols"),
        ("BUY NOW!! THE!! BEST!! PRICES!! EVER!!", "shouting"),
        ("THE BEST PRICES OF THE WHOLE YEAR ARE HERE", "shouting"),
        ("Home | News | Sport | Contact", "navigation"),
        ("go " * 30, "repetition"),
        ("Home › Shop › Cart › Pay", "navigation"),
        (" ".join(f"word{chr(97 + i)}" for i in range(25)), "unpunctuated"),
        ("Please enable JavaScript to continue.", "boilerplate"),
        (SENTENCE, None),
        ("A price of $5 & 10% off, she said!", None),
        ("ПРИВЕТ ДОРОГИЕ ДРУЗЬЯ И ГОСТИ ГОРОДА", "shouting"),
    ],
)
def test_rules(line, rule):
    found = quality_rules.failing_rule(line.encode(), line.encode().split(), quality_rules.Rules())
    assert found == rule


@pytest.mark.parametrize(
    "letters, mark",
    [
        ("कखगघचछजझटठडढतथद", "।"),
        ("কখগঘচছজঝটঠডঢতথদ", "।"),
        ("ابتثجحخدذرزسشصض", "۔"),
        ("ابتثجحخدذرزسشصض", "،"),
        ("ابتثجحخدذرزسشصض", "؟"),
        ("ሀለሐመሠረሰሸቀበተቸኀነኘ", "።"),
        ("ကခဂဃငစဆဇညဋဌဍဎဏတ", "။"),
        ("កខគឃងចឆជឈញដឋឌឍណ", "។"),
        ("աբգդեզէըթժիլխծկ", "։"),
        ("的一是不了人我在有他这为之大来", "，"),
        ("กขคฆงจฉชซฌญฎฏฐฑ", ""),
    ],
)
def test_clean_documents_of_other_scripts_are_kept(letters, mark):
    words = [a + b for a in letters for b in letters]
    text = "\n".join(" ".join(words[at : at + 25]) + mark for at in range(0, 225, 25))
    found = quality_rules.judge(text.encode())
    assert found["kept"] and found["failed_lines"] == 0
    if mark:
        assert quality_rules.judge(text.replace(mark, "").encode())["failed_lines"] == 9


def test_lines_are_removed_before_the_verdict():
    mixed = quality_rules.judge(f"{PROSE}\nHome | News | Sport | Contact\n\n".encode())
    assert mixed["kept"] and mixed["clean_text"] == f"{PROSE}\n\n".encode()
    menu = "Home | News | Sport | Contact | Shop | Help | About\n"
    spoiled = quality_rules.judge((PROSE + "\n" + menu * 20).encode())
    assert not spoiled["kept"]


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (None, PROSE, "x"), (4, PROSE, None), (4, PROSE, None), (5, PROSE * 3000, "x")],
        "doc_id long, text string, kept string",
    ).withColumn("n_words", F.lit("clash"))
    rows = {(r.doc_id, r.n_words): r.kept for r in quality_rules.verdicts(docs).collect()}
    n = len(PROSE.split())
    assert rows == {(1, 0): False, (2, 0): False, (None, n): True, (4, n): True, (5, len((PROSE * 3000).split())): False}
    kept = quality_rules.clean(docs, length_col="absent").collect()
    assert [(r.doc_id, r.text, r.kept, r.n_words) for r in kept] == [(None, PROSE, "x", "clash"), *2 * [(4, PROSE, None, "clash")]]
    assert quality_rules.verdicts(docs.limit(0)).count() == 0


def test_clean_sets_the_length(spark):
    docs = spark.createDataFrame([(1, PROSE + "\nHome | Ä | Sport | Contact", 0)], "doc_id long, text string, n_chars long")
    row = quality_rules.clean(docs).collect()[0]
    assert (row.text, row.n_chars) == (PROSE, len(PROSE))


SCRIPTS = [
    ("कखगघचछजझटठडढतथद", "।"),
    ("ابتثجحخدذرزسشصض", "۔"),
    ("ሀለሐመሠረሰሸቀበተቸኀነኘ", "።"),
    ("កខគឃងចឆជឈញដឋឌឍណ", "។"),
    ("的一是不了人我在有他这为之大来", "，"),
    ("กขคฆงจฉชซฌญฎฏฐฑ", ""),
    ("abcdefghijklmno", "."),
]


def test_other_scripts_equal_sql(spark, tmp_path):
    """Rows of seven scripts, with their marks and without, and lines that many documents have."""
    rows = []
    for letters, mark in SCRIPTS:
        words = [a + b for a in letters for b in letters]
        for sign in (mark, ""):
            rows.append("\n".join(" ".join(words[at : at + 25]) + sign for at in range(0, 225, 25)))
    for i in range(60):
        own = [[chr(97 + i // 26) + chr(97 + i % 26) + chr(97 + a) + chr(97 + b) for b in range(24)] for a in range(6)]
        rows.append("\n".join([*(f"Line of {' '.join(some)}." for some in own), f"Shared footer, page {10 + i}."]))
    rows += [rows[-1]] * 30  # copies
    rows += ["We love cookies and JavaScript books, dear reader.", "Accept cookies.\n" * 9, "a\nlicensed under x\n" * 30]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    name = "op1_quality_rules"
    import duckdb

    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = queries.QUERIES[name](spark, str(tmp_path))
    assert difference(found, connection, ORACLES[name]) is None
    by = {r.doc_id: r for r in found.collect()}
    for at, (_, mark) in enumerate(SCRIPTS):
        assert by[2 * at].kept and by[2 * at].failed_lines == 0
        assert by[2 * at + 1].kept == (not mark)
    # The footer is boilerplate, the lines of a text with thirty copies are not.
    assert all(by[i].failed_lines == 1 and by[i].kept for i in range(14, 104))
    assert by[104].failed_lines == 0 and by[105].failed_lines == 9


def test_hot_lines(spark):
    footer, text = "All About Us 2020", "\n".join(f"some text {i}" for i in range(5))
    rows = [f"{footer if i % 2 else footer.replace('2020', '1999').upper()}\nown line number {chr(97 + i)}, the longest of all" for i in range(22)]
    docs = spark.createDataFrame([(t,) for t in [*rows, *[text] * 50, None, "", " \n"]], "text string")
    found = quality_rules.hot_lines(docs)
    assert found == {quality_rules.line_hash(b"all about us 0000".split())}
    assert quality_rules.hot_lines(docs, rules=quality_rules.Rules(hot_documents=23)) == frozenset()
    assert quality_rules.hot_lines(docs, rules=quality_rules.Rules(hot_share=0.99)) == frozenset()
    assert quality_rules.hot_lines(docs.limit(0)) == frozenset()
