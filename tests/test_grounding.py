import random
import re
from difflib import SequenceMatcher

from conftest import values

from tallyproof.operators import grounding


def tables(spark, texts, candidates):
    return (
        spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"),
        spark.createDataFrame(list(enumerate(candidates)), "candidate_id int, candidate string"),
    )


def pairs(df):
    return sorted(values(df, "text_id", "candidate_id"))


def written(text, candidate):
    return re.search(rf"(?<!\w){re.escape(candidate.strip().lower())}(?!\w)", text.lower())


def alike(text, candidate):
    words = lambda s: re.findall("[a-z0-9]+", s.lower())
    name, tokens = words(candidate), words(text)
    joined = " ".join(name)
    for i in range(len(tokens) - len(name) + 1):
        run = " ".join(tokens[i : i + len(name)])
        if min(len(run), len(joined)) >= 6 and SequenceMatcher(None, joined, run).ratio() >= 0.87:
            return True
    return False


def brute(texts, candidates, match):
    return [(i, j) for i, t in enumerate(texts) for j, c in enumerate(candidates) if match(t, c)]


TEXTS = [
    "Small-cell lung cancer and NSCLC in all patients",
    "5-FU for sarcomas, not 5 FU",
    "lung cancers",
    "Élan vital (été) a.b \\E c++ end",
    "one two three four five six seven eight nine ten eleven",
    "one two three four five six seven eight nine ten twelve",
    "",
    "Pembrolizumab",
    "ONE TWO",
]
CANDIDATES = [
    "ALL", "SCLC", "nsclc", "5-fu", "5 fu", "lung cancer", "sarcoma", " élan ", "été", "a.b", "axb", "\\E c++",
    "one two three four five six seven eight nine ten eleven", "one two", "pembrolizumab", "cell lung", "ONE two", "six seven eight nine ten",
]


def test_exact_matches_equal_brute_force(spark):
    texts, candidates = tables(spark, TEXTS, CANDIDATES)
    expected = brute(TEXTS, CANDIDATES, written)
    assert pairs(grounding.exact_matches(texts, candidates)) == expected
    assert pairs(grounding.exact_matches(texts, candidates, anchor=1)) == expected
    assert pairs(grounding.exact_matches(texts, candidates, broadcast_bytes=0)) == expected
    gone = {j for j in range(len(CANDIDATES))} - {j for _i, j in expected}
    matches = grounding.exact_matches(texts, candidates)
    assert {c for (c,) in values(grounding.dropped(candidates, matches), "candidate_id")} == gone


def test_dropped_per_text(spark):
    texts, candidates = tables(spark, TEXTS, CANDIDATES)
    proposed = spark.createDataFrame([(0, 0), (0, 1), (7, 14)], "text_id int, candidate_id int")
    lost = grounding.dropped_of_text(proposed, grounding.exact_matches(texts, candidates))
    assert pairs(lost) == [(0, 1)]


def spelled(rng, name):
    """One or two random edits."""
    for _ in range(rng.randint(1, 2)):
        at = rng.randrange(len(name))
        name = rng.choice([name[:at] + name[at + 1 :], name[:at] + rng.choice("aeos") + name[at:], name + "s"])
    return name


def test_inflected_matches_equal_brute_force(spark):
    rng = random.Random(7)
    syllables = ["pem", "bro", "li", "zu", "mab", "nivo", "lu", "cel", "kin", "ase", "ti", "nib", "or", "an"]
    names = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(40)]
    names += [f"{a} {b}" for a, b in zip(names[:15], names[15:30], strict=True)]
    texts = [
        "the " + " and ".join(spelled(rng, n) if rng.random() < 0.7 else n for n in rng.sample(names, 3)) for _ in range(60)
    ] + ["lung cancers", "sarcomas", "SCLC", "NSCLC"]
    names += ["lung cancer", "sarcoma", "nsclc"]
    text_table, name_table = tables(spark, texts, names)
    expected = brute(texts, names, alike)
    assert len(expected) > 100
    assert pairs(grounding.inflected_matches(text_table, name_table)) == expected
    assert pairs(grounding.inflected_matches(text_table, name_table, broadcast_bytes=0)) == expected
    assert pairs(grounding.inflected_matches(text_table, name_table, part=9)) == expected
    both = sorted({*expected, *brute(texts, names, written)})
    assert pairs(grounding.grounded(text_table, name_table, fuzzy=True)) == both


def test_no_candidates(spark):
    texts, candidates = tables(spark, TEXTS, CANDIDATES)
    none = candidates.where("false")
    assert grounding.exact_matches(texts, none).count() == 0
    assert grounding.inflected_matches(texts, none).count() == 0


def test_long_names_in_prose_of_few_syllables(spark):
    """Names whose 3-grams are everywhere in the texts: only runs near enough to one leave a row."""
    rng = random.Random(3)
    syllables = [a + b + c for a in "bcdfglmnprst" for b in "aeiou" for c in ("", "n", "r")][::3]

    def prose(n):
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))

    names = [prose(rng.randint(2, 9)) for _ in range(12)] + [prose(12) for _ in range(12)]
    texts = []
    for i in range(48):
        name = names[i % 24]
        for _ in range(i // 12):
            name = spelled(rng, name)
        texts.append(f"{prose(60)}, {name}; {prose(40)}")
    expected = brute(texts, names, alike)
    assert len(expected) >= 18
    text_table, name_table = tables(spark, [*texts, ""], names)
    assert pairs(grounding.inflected_matches(text_table, name_table)) == expected
    wanted = grounding._Names([(n, len(n.split())) for n in names[12:]], 6)
    tokens = [re.findall("[a-z0-9]+", t) for t in texts]
    assert 12 <= sum(len(wanted.runs(t)) for t in tokens) < sum(12 * len(t) for t in tokens) / 50


def test_only_hits_are_shuffled(spark):
    """Of n-grams of texts, next to none but those of names pass the filter."""
    names = spark.range(500).selectExpr("xxhash64('name', id) as _gram")
    passes = grounding._filter(names)
    grams = spark.range(20_000).selectExpr("array(xxhash64('text', id)) as g").unionByName(names.selectExpr("array(_gram) as g"))
    kept = grams.select(grounding.F.size(grounding.F.filter("g", passes)).alias("n")).groupBy().sum("n").first()[0]
    assert 500 <= kept < 500 + 20_000 / 8
