"""Grounding: which candidate names really occur in which texts.

Texts and candidates meet in an equi-join on token n-grams, never by comparing all with all. While
the candidates are few enough, by their bytes, to be broadcast, a pair is verified in the row of its
text and no text moves. Beyond that a filter of fixed size, made of all candidates, is tested in the row;
only n-grams that pass are shuffled, and only texts that have one are kept for the pairs that met.

Inflected names are looked for in the row too: runs of words that cannot reach the similarity, by the
places of their 3-grams, never leave it.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.functions import fixed_values as V
from tallyproof.functions.text import strip
from tallyproof.session import durable

#: Words of a candidate hashed into its join key. Longer candidates are verified in full.
ANCHOR_TOKENS = 8


#: Names are broadcast when they, with some bytes for each row, take no more than this.
BROADCAST_BYTES = 8 << 20
_ROW_BYTES = 64
#: Places of the filter of names that are too many to broadcast: for each name, and at most.
PLACES, MOST_PLACES = 16, 1 << 22


def tokens(text: Column) -> Column:
    """Lower-case Latin words and numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _words(text: Column) -> Column:
    """Runs of word characters of any script."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def _distinct_numbers(column: Column, df: DataFrame) -> list[int]:
    """The few distinct lengths occurring in a table, combined map-side."""
    return sorted(row[0] for row in df.select(column).distinct().collect())


def _runs(words: Column, n: int, build) -> Column:
    """``build`` of every run of ``n`` words; none when there are fewer."""
    last = F.size(words) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: build(F.slice(words, i, n)))


def _anchored(names: DataFrame, anchor: int) -> DataFrame:
    """``(name, _n, _gram)``: one run of words per name, hashed, to look it up by.

    Of all its runs of ``anchor`` words (or all its words, when there are fewer) a name gets the
    one that the fewest names share, so that names opening with the same boilerplate do not all
    meet the same texts.
    """
    cut = names.withColumn("_words", _words(F.col("name"))).where(F.size("_words") > 0)
    cut = cut.withColumn("_n", F.least(F.size("_words"), F.lit(anchor)))
    starts = F.sequence(F.lit(1), F.size("_words") - F.col("_n") + 1)
    runs = cut.select(
        "name",
        "_n",
        F.explode(
            F.array_distinct(
                F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, F.col("_n"))))
            )
        ).alias("_gram"),
    )
    shared = runs.groupBy("_n", "_gram").agg(F.count("*").alias("_names"))
    rarest = F.min(F.struct("_names", "_gram")).alias("_rarest")
    return (
        runs.join(shared, ["_n", "_gram"])
        .groupBy("name", "_n")
        .agg(rarest)
        .select("name", "_n", F.col("_rarest._gram").alias("_gram"))
    )


def _filter(names: DataFrame):
    """A test of an n-gram's hash that all ``names(_gram)`` pass, and few others. The filter has a place
    for each of at most ``MOST_PLACES`` remainders of a hash, and travels as one constant of the plan."""
    wanted = PLACES * max(1, names.count())
    size = min(MOST_PLACES, 1 << max(16, (wanted - 1).bit_length()))

    def place(gram: Column) -> Column:
        return gram.bitwiseAND(F.lit(size - 1)).cast("int")

    places = bytearray(size)
    for row in names.select(place(F.col("_gram")).alias("place")).distinct().toLocalIterator():
        places[row.place] = 1
    constant = F.lit(bytes(places))
    return lambda gram: F.substring(constant, place(gram) + 1, F.lit(1)) == F.lit(b"\x01")


def exact_matches(
    texts: DataFrame,
    candidates: DataFrame,
    anchor: int = ANCHOR_TOKENS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(text_id, candidate_id)`` where the candidate occurs in the text between non-word
    characters, any case. ``texts(text_id, text)``, ``candidates(candidate_id, candidate)``.

    An occurrence is bounded by non-word characters, so its words are whole words of the text:
    meeting on the hash of some of them loses nothing. Equal candidates are looked up once.
    """
    wanted = candidates.select("candidate_id", F.lower(strip(F.col("candidate"))).alias("name"))
    names = durable(_anchored(wanted.select("name").distinct(), anchor))
    words = F.col("_words")
    grams = [_runs(words, n, F.xxhash64) for n in _distinct_numbers(F.col("_n"), names)]
    if not grams:
        grams = [F.array().cast("array<bigint>")]
    grams_of = F.explode(F.array_distinct(F.concat(*grams))).alias("_gram")
    lowered = texts.select("text_id", F.lower("text").alias("_text"))
    looked_up = names.select("_gram", "name")
    size = F.coalesce(F.sum(F.octet_length("name") + _ROW_BYTES), F.lit(0))
    if looked_up.agg(size).first()[0] <= broadcast_bytes:
        runs = lowered.select("text_id", "_text", _words(F.col("_text")).alias("_words"))
        met = runs.select("text_id", "_text", grams_of).join(F.broadcast(looked_up), "_gram")
    else:
        passes = _filter(names)
        runs = lowered.select("text_id", "_text", _words(F.col("_text")).alias("_words"))
        found = F.filter(F.array_distinct(F.concat(*grams)), passes)
        # As a list of at most one list: a test of its size would be moved below, where words are cut.
        some = F.filter(F.array(found), lambda g: F.size(g) > 0)
        hits = durable(runs.select("text_id", "_text", F.explode(some).alias("_grams")))
        met = hits.select("text_id", F.explode("_grams").alias("_gram")).join(looked_up, "_gram")
        met = met.join(hits.select("text_id", "_text"), "text_id")
    # \Q..\E takes the candidate literally.
    literal = F.concat(
        F.lit(r"(?U)(?<!\w)\Q"),
        F.replace("name", F.lit(r"\E"), F.lit(r"\E\\E\Q")),
        F.lit(r"\E(?!\w)"),
    )
    return (
        met.where(F.contains("_text", "name") & F.rlike(F.col("_text"), literal))
        .select("text_id", "name")
        .join(wanted, "name")
        .select("text_id", "candidate_id")
    )


def similarity() -> Column:
    """Ratcliff-Obershelp ratio of two strings, as a vectorised function.

    Marked as not deterministic, so that the optimizer leaves it above the removal of repeated pairs.
    """

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(
            [SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)],
            dtype="float64",
        )

    return ratio.asNondeterministic()


def _trigrams(text: Column) -> Column:
    return F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))
        )
    )


class _Names:
    """Names to look for in texts: their 3-grams, and what a run of words must have to be similar.

    With similarity 2M/T >= 0.87 for M matching of T characters, the matching blocks number at most
    1 + (T - 2M), so at least M - 2(1 + T - 2M) >= 0.175 T - 2 places of the run hold a 3-gram of the
    name; and such a place is at most T - 2M <= 0.13 T characters away from where the name has it.
    """

    SYMBOLS = 37  # blank, digits, letters

    def __init__(self, names: list[tuple[str, int]], shortest: int):
        self.names, self.shortest = names, shortest
        self.symbol = np.zeros(256, dtype=np.int64)
        self.symbol[[ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyz"]] = np.arange(1, self.SYMBOLS)
        self.length = np.array([len(name) for name, _ in names], dtype=np.int64)
        self.words = np.array([n for _, n in names], dtype=np.int64)
        self.away = np.floor(0.13 * (self.length + np.ceil(1.3 * self.length))).astype(np.int64) + 1
        self.least = self.bound(self.length + np.maximum(shortest, np.floor(0.769 * self.length)))
        grams = [self.codes(name) for name, _ in names]
        of = np.repeat(np.arange(len(names)), [len(g) for g in grams])
        places = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        codes = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        order = np.argsort(codes, kind="stable")
        self.name_of, self.place_of = of[order], places[order]
        self.first = np.searchsorted(codes[order], np.arange(self.SYMBOLS**3 + 1))

    @staticmethod
    def bound(total):
        """The places that must hold a 3-gram, for so many characters of both together."""
        return np.maximum(1, np.ceil(0.175 * total - 2 - 1e-9)).astype(np.int64)

    def codes(self, text: str) -> np.ndarray:
        s = self.symbol[np.frombuffer(text.encode("ascii"), np.uint8)]
        return (s[:-2] * self.SYMBOLS + s[1:-1]) * self.SYMBOLS + s[2:] if len(s) > 2 else np.zeros(0, np.int64)

    def runs(self, tokens: list[str]) -> set[tuple[str, str, int]]:
        """``(run, name, words)`` of the runs that may be similar to a name."""
        text = " ".join(tokens)
        codes = self.codes(text)
        met = self.first[codes + 1] - self.first[codes]
        if not met.any():
            return set()
        at = np.repeat(np.arange(len(codes)), met)
        which = np.repeat(self.first[codes], met) + np.arange(len(at)) - np.repeat(np.cumsum(met) - met, met)
        name, place = self.name_of[which], self.place_of[which]
        # Hits by name and bin: a bin is as wide as a 3-gram may be away, so a run's are in three.
        away = self.away[name]
        bins = len(text) + int(self.length.max()) + 4
        key, n = np.unique(name * bins + (at - place + int(self.length.max())) // away + 1, return_counts=True)
        near = np.unique(np.concatenate([key - 1, key, key + 1]))
        total = np.zeros(len(near), dtype=np.int64)
        for step in (-1, 0, 1):
            found = np.minimum(np.searchsorted(key, near + step), len(key) - 1)
            total += np.where(key[found] == near + step, n[found], 0)
        near = near[total >= self.least[near // bins]]
        if not len(near):
            return set()
        ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
        starts = ends - [len(t) for t in tokens]
        order = np.lexsort((at, name))
        held = np.unique(name[order] * bins + at[order])  # a place counts once for a name
        result = set()
        for number, bin_ in zip((near // bins).tolist(), (near % bins - 1).tolist()):
            wide, low = int(self.away[number]), bin_ * int(self.away[number]) - int(self.length.max())
            first, last = np.searchsorted(starts, [low, low + wide])
            length, words = int(self.length[number]), int(self.words[number])
            for start in range(first, min(last, len(tokens) - words + 1)):
                begin, end = int(starts[start]), int(ends[start + words - 1])
                run = end - begin
                if run < self.shortest or max(run, length) * 0.435 > min(run, length) * 0.565 + 1e-6:
                    continue
                inside = np.searchsorted(held, [number * bins + begin, number * bins + end - 2])
                if inside[1] - inside[0] >= math.ceil(0.175 * (run + length) - 2 - 1e-9):
                    result.add((text[begin:end], self.names[number][0], words))
        return result


#: Characters of a text that are searched at a time.
PART = 1 << 19


def _parts(text: str, overlap: int, size: int) -> Iterator[list[str]]:
    """The tokens of a text, so many characters at a time; a part begins with the last ``overlap``
    tokens of the one before."""
    start, before = 0, []
    while start < len(text):
        end = start + size
        while end < len(text) and text[end].isalnum():
            end += 1
        found = before + re.findall("[a-z0-9]+", text[start:end])
        yield found
        start, before = end, found[len(found) - overlap :] if overlap else []


def _runs_in_rows(texts: DataFrame, names: DataFrame, shortest: int, part: int) -> DataFrame:
    """``(text_id, run, name, _n)``: the runs of each text that may be similar to a name. The names are
    broadcast, after their size was checked."""
    context = texts.sparkSession.sparkContext
    shared = context.broadcast([(r.name, r["_n"]) for r in names.select("name", "_n").collect()])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _Names(shared.value, shortest)
        overlap = max((n for _, n in shared.value), default=1) - 1
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                found = set()
                for tokens_ in _parts(text or "", overlap, part):
                    found |= wanted.runs(tokens_)
                if found:
                    ids = batch.column(0).slice(row, 1).take(pa.array([0] * len(found)))
                    runs, alike, n = (list(c) for c in zip(*sorted(found)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(runs), pa.array(alike), pa.array(n, pa.int32())], ["text_id", "run", "name", "_n"])

    lowered = texts.select("text_id", F.lower("text").alias("_text"))
    kind = lowered.schema["text_id"].dataType.simpleString()
    return lowered.mapInArrow(find, f"text_id {kind}, run string, name string, _n int")


def _similar(pairs: DataFrame) -> DataFrame:
    """The pairs ``(run, name, _n)`` that are similar. The edit distance is at most T - 2M, so this spares
    the slow function most pairs."""
    edits = F.levenshtein("name", "run") <= (F.length("name") + F.length("run")) * 0.13 + 1e-6
    return pairs.where(edits).where(similarity()(F.col("name"), F.col("run")) >= V.FUZZY_THRESHOLD)


def inflected_matches(
    texts: DataFrame,
    candidates: DataFrame,
    shortest: int = V.MIN_FUZZY_LENGTH,
    broadcast_bytes: int = BROADCAST_BYTES,
    part: int = PART,
) -> DataFrame:
    """``(text_id, candidate_id)`` where some run of as many tokens as the candidate has is at
    least 0.87 similar to it, both of ``shortest`` or more characters.

    While the names take at most ``broadcast_bytes``, a run leaves its text's row only when enough of its
    places hold 3-grams of one name, near where the name has them (`_Names`). Beyond that, runs meet names
    by shuffled 3-grams. Equal runs are compared once, whatever texts they stand in.
    """
    name = F.concat_ws(" ", "_words")
    wanted = (
        candidates.select("candidate_id", tokens(F.col("candidate")).alias("_words"))
        .select("candidate_id", name.alias("name"), F.size("_words").alias("_n"))
        .where(F.length("name") >= shortest)
    )
    names = durable(wanted.select("name", "_n").distinct())
    size = names.agg(F.coalesce(F.sum(F.octet_length("name") * _ROW_BYTES), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _shuffled_matches(texts, wanted, names, size, shortest)
    met = durable(_runs_in_rows(texts, names, shortest, part))
    alike = _similar(met.select("run", "name", "_n").distinct())
    found = met.join(alike, ["run", "name", "_n"]).select("text_id", "name", "_n")
    return found.join(wanted, ["name", "_n"]).select("text_id", "candidate_id").distinct()


def _shuffled_matches(texts: DataFrame, wanted: DataFrame, names: DataFrame, size: int, shortest: int) -> DataFrame:
    """As `inflected_matches`, for names that are too many to broadcast.

    Pairs are found through shared 3-grams, of which at least 0.175 T - 2 of a candidate's positions are
    shared, T >= 1.769 times the candidate's length. It is enough to look up all of its 3-grams but that
    many less one, and the commonest are the ones left out.
    """
    words = F.col("_words")
    # How long a run of so many tokens can usefully be: one row for each number of tokens among the
    # names, and one constant for all of them.
    length = F.length("name")
    spans = names.groupBy("_n").agg(
        F.greatest(F.lit(shortest), F.floor(F.min(length) * 0.769)).cast("int").alias("low"),
        F.ceil(F.max(length) * 1.3).cast("int").alias("high"),
    )
    listed = json.dumps([row.asDict() for row in spans.orderBy("_n").collect()])
    wanted_runs = F.from_json(F.lit(listed), "array<struct<_n:int,low:int,high:int>>")

    def runs_of(span: Column) -> Column:
        last = F.size(words) - span["_n"] + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        found = F.transform(
            starts, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i, span["_n"])).alias("run"), span["_n"].alias("_n"))
        )
        return F.filter(found, lambda r: F.length(r["run"]).between(span["low"], span["high"]))

    runs = (
        texts.select("text_id", tokens(F.col("text")).alias("_words"))
        .select("text_id", F.inline(F.flatten(F.transform(wanted_runs, runs_of))))
    )
    vocabulary = durable(runs.select("run", "_n").distinct())
    places = F.sequence(F.lit(1), F.length("name") - 2)
    positions = names.select(
        "name",
        "_n",
        F.posexplode(F.transform(places, lambda i: F.substring(F.col("name"), i, F.lit(3)))).alias("_at", "gram"),
    )
    # Only 3-grams of names are of use; the others are gone before anything is shuffled.
    useful = positions.select("gram").distinct()
    run_grams = durable(
        vocabulary.select("run", "_n", F.explode(_trigrams(F.col("run"))).alias("gram")).join(
            F.broadcast(useful) if size <= BROADCAST_BYTES else useful, "gram", "left_semi"
        )
    )
    frequency = run_grams.groupBy("gram").agg(F.count("*").alias("_f"))
    positions = positions.join(frequency, "gram")
    least = F.greatest(F.ceil(F.lit(0.175 * 1.769) * F.length("name") - 2), F.lit(1))
    common_first = Window.partitionBy("name", "_n").orderBy(F.desc("_f"), "_at")
    looked_up = (
        positions.withColumn("_rank", F.row_number().over(common_first))
        .where(F.col("_rank") >= least)
        .select("name", "_n", "gram")
        .distinct()
    )
    longer = F.greatest(F.length("run"), F.length("name"))
    close = longer * 0.435 <= F.least(F.length("run"), F.length("name")) * 0.565 + 1e-6
    pairs = run_grams.join(looked_up, ["gram", "_n"]).where(close).select(
        "run", "name", "_n"
    ).distinct()
    alike = _similar(pairs)
    matched = alike.join(wanted, ["name", "_n"]).select("run", "_n", "candidate_id")
    return runs.join(matched, ["run", "_n"]).select("text_id", "candidate_id").distinct()


def grounded(texts: DataFrame, candidates: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Matches, exact and optionally inflected."""
    exact = exact_matches(texts, candidates)
    if not fuzzy:
        return exact
    return exact.unionByName(inflected_matches(texts, candidates)).distinct()


def dropped(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Candidates found in no text."""
    return candidates.join(matches.select("candidate_id").distinct(), "candidate_id", "left_anti")


def dropped_of_text(proposed: DataFrame, matches: DataFrame) -> DataFrame:
    """``(text_id, candidate_id)`` pairs proposed for a text that does not contain them."""
    return proposed.join(matches, ["text_id", "candidate_id"], "left_anti")
