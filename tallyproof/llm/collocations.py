"""Phrase collocations by direct-address tiling.

Words are counted first, by language. The most frequent ones are numbered by falling frequency, and those
numbers are their addresses; every other word is named by a hash that is verified to be without collisions
over the whole corpus. A task turns its texts into numbers and counts neighbouring pairs in tiles of
addresses: a tile that is well filled by dense ``numpy.bincount``, the others as sorted coordinates. Pairs
of words without an address are sorted coordinates too. Spark adds up what the tasks counted. The frequent
pairs are ranked again and take addresses in their turn, so that phrases of three words are pairs of a
frequent pair and a word, and so on up to the longest phrases.

A phrase is never more frequent than any part of it, so words and shorter phrases below the least count
are left out of longer ones. What the tasks know of that is bounded whatever the corpus: the ranked words
and phrases, and for all others a filter of a fixed number of bits (`Sizes`), which lets some
through in vain but keeps none back, so all counts are exact. What is shuffled are counts of different
phrases, combined in each task, so a phrase that fills a third of the corpus is one row a task.

Defined cases: a null text counts as empty; a null language is ``und``, as is that string; texts without
words, or without phrases that are frequent enough, give no rows; an empty table gives an empty table;
repeated rows count each time; very long texts are read in slices; ids are not read, and only the text and
the language are taken from the table, so other columns never clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.llm.common import as_bytes, runs, text_of
from tallyproof.session import stored

UNKNOWN = "und"
SEED = 42
#: Parts of a language that are ranked apart before the whole.
PARTS = 16

_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(10 if b in _ENDS else 32 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_HASHED = 1 << 62  # set in the number of a word without an address
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Sizes:
    """What bounds the memory of a task; results are the same with any sizes."""

    words: int = 1 << 16  # that have an address
    grams: int = 1 << 17  # of each length that have one
    word_bytes: int = 64  # of a word that may have one, so the table of those is bounded in bytes
    side: int = 9  # bits of an address on each side of a tile
    buffer: int = 1 << 20  # neighbours that are counted at a time
    passed: int = 1 << 16  # counts that are passed on at a time
    filter_bits: int = 1 << 26
    held_words: int = 200_000  # different words that a task counts before it passes the counts on
    slice: int = 1 << 20  # bytes of a text that are cut into words at a time


def slices(text: bytes, size: int) -> Iterator[bytes]:
    """The text, A-Z lowered and with pieces ending at newlines, in parts that begin between words."""
    text = text.translate(_PLAIN)
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            cuts = [at for at in (text.find(b" ", end), text.find(b"\n", end)) if at >= 0]
            end = min(cuts, default=len(text))
        yield text[start:end]
        start = end


def _language(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(UNKNOWN)).alias("lang")


def word_counts(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """``(lang, word, c)`` of ``docs(lang, _text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                own = found.setdefault(lang, Counter())
                for part in slices(text, sizes.slice):
                    before = len(own)
                    own.update(part.split())
                    held += len(own) - before
                    if held > sizes.held_words:
                        yield from counted(found)
                        found, held = {}, 0
                        own = found.setdefault(lang, Counter())
        yield from counted(found)

    def counted(found: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in found.items():
            if own:
                words, counts = pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), words, counts], ["lang", "word", "c"])

    return docs.mapInArrow(run, "lang string, word binary, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))


def most_frequent(rows: DataFrame, most: int, count: str) -> DataFrame:
    """The rows with the highest counts, at most so many: all whose count is in the bins of a histogram
    that together hold no more."""
    bin_of = F.floor(F.log2(count) * 8).cast("int")
    total, least = 0, None
    for r in sorted(rows.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n")).collect(), reverse=True):
        total += r.n
        if total > most:
            break
        least = r.bin
    return rows.filter(F.lit(False) if least is None else bin_of >= least)


def _prefix(lang: str, seed: int) -> bytes:
    """What a word's hash begins with, so that words of two languages differ."""
    name = lang.encode()
    return b"%d:%d:%s" % (seed, len(name), name)


def _hash_number(seed: int) -> Column:
    """The number of a word without an address, as `_number` gives it."""
    name = F.col("lang").cast("binary")
    begin = F.concat(F.lit(f"{seed}:"), F.octet_length("lang").cast("string"), F.lit(":")).cast("binary")
    return F.shiftrightunsigned(F.xxhash64(F.concat(begin, name, F.col("word"))), 2).bitwiseOR(F.lit(_HASHED))


def _number(word: bytes, prefix: bytes) -> int:
    return xxhash.xxh64_intdigest(prefix + word, SEED) >> 2 | _HASHED


def mixed(ids: np.ndarray) -> np.ndarray:
    """A hash of each row of numbers."""
    total = np.zeros(len(ids), dtype=np.uint64)
    for column in ids.T:
        total = (total ^ column.astype(np.uint64)) * _FACTOR
        total ^= total >> np.uint64(31)
    return total


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes >> np.uint64(7)).astype(np.int64) & (size - 1)


def filter_of(rows: DataFrame, columns: list[str], size: int) -> np.ndarray:
    """The filter of all rows of numbers: ``size`` bits in words of 64, set by an aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits(mixed(np.stack([c.to_numpy() for c in batch.columns], axis=1)), size)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(1, at & 63))], ["at", "bits"])

    sums = rows.select(*columns).mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    found = np.zeros(size >> 6, dtype=np.int64)
    found[sums.column("at").to_numpy()] = sums.column("bits").to_numpy()
    return found


def passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = _bits(hashes, len(bits) << 6)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


class Vocabulary:
    """Numbers for words: addresses for the most frequent, hashes for the others that may be frequent."""

    def __init__(self, langs: list[str], words: list[bytes], seed: int, others: np.ndarray, size: int):
        self.of: dict[str, dict[bytes, int]] = {}
        for number, (lang, word) in enumerate(zip(langs, words)):
            self.of.setdefault(lang, {})[word] = number
        self.seed, self.others, self.slice = seed, others, size

    def read(self, langs: list[str], texts: list[bytes]) -> np.ndarray:
        """The numbers of the words of some texts; -1 ends a piece and stands for words too rare."""
        found: list[np.ndarray] = []
        for lang, text in zip(langs, texts):
            get, prefix = self.of.get(lang, {}).get, _prefix(lang, self.seed)
            for part in slices(text, self.slice):
                ids: list[int] = []
                words: list[bytes] = []
                for number, piece in enumerate(part.split(b"\n")):
                    if number:
                        ids.append(-1)
                        words.append(b"")
                    some = piece.split()
                    ids.extend(map(get, some, repeat(-2)))
                    words += some
                numbers = np.array(ids, dtype=np.int64)
                rest = np.flatnonzero(numbers == -2)
                if len(rest):
                    own = np.array([_number(words[i], prefix) for i in rest.tolist()], dtype=np.int64)
                    numbers[rest] = np.where(passes(mixed(own[:, None]), self.others), own, -1)
                found.append(numbers)
            found.append(np.array([-1]))
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


class Grams:
    """Frequent phrases of one length: ranks are the addresses of the most frequent."""

    def __init__(self, ids: np.ndarray, others: np.ndarray):
        hashes = mixed(ids)
        self.ids, self.others = ids, others
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def ranks(self, ids: np.ndarray) -> np.ndarray:
        """The address of each phrase, -2 without one if it may be frequent, else -1."""
        hashes = mixed(ids)
        found = np.where(passes(hashes, self.others), -2, -1)
        if len(self.order):
            rank = self.order[np.minimum(np.searchsorted(self.hashes, hashes), len(self.order) - 1)]
            same = (self.ids[rank] == ids).all(axis=1)
            found[same] = rank[same]
        return found


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of a sorted array, and how often each occurs."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def tile_counts(left: np.ndarray, right: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of addresses and their counts: tiles that are well filled are dense."""
    if not len(left):
        return left, right, left
    mask, cells = (1 << side) - 1, 1 << 2 * side
    across = int(right.max() >> side) + 1
    tile = (left >> side) * across + (right >> side)
    cell = (left & mask) << side | (right & mask)
    if int(tile.max()) < 1 << 16:
        tile = tile.astype(np.uint16)  # sorted by digits
    order = np.argsort(tile, kind="stable")
    tile, cell = tile[order].astype(np.int64), cell[order]
    first = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
    sizes = np.diff(np.append(first, len(tile)))
    dense = sizes >= cells >> 3
    found = []
    for at, size in zip(first[dense].tolist(), sizes[dense].tolist()):
        counts = np.bincount(cell[at : at + size], minlength=cells)
        some = np.flatnonzero(counts)
        found.append((tile[at] << 2 * side | some, counts[some]))
    sparse = np.repeat(~dense, sizes)
    if sparse.any():
        found.append(_runs(np.sort(tile[sparse] << 2 * side | cell[sparse])))
    keys, counts = (np.concatenate(x) for x in zip(*found))
    tile = keys >> 2 * side
    return tile // across << side | (keys >> side & mask), tile % across << side | (keys & mask), counts


def _coordinates(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbers and their counts, sorted by a hash; equal rows may come twice if hashes collide."""
    hashes = mixed(ids)
    order = np.argsort(hashes, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]).any(axis=1))))
    return ids[first], np.diff(np.append(first, len(ids)))


def gram_counts(docs: DataFrame, words, shorter: list, length: int, sizes: Sizes) -> DataFrame:
    """``(w1, ..., c)``: phrases of ``length`` words whose parts may be frequent. ``words`` is a broadcast
    `Vocabulary`, ``shorter`` broadcast `Grams` of two words and more, up to ``length - 1``."""
    columns = [f"w{i + 1}" for i in range(length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # numbers of phrases, addresses of their first part
        filled = 0
        for rows in runs(batches, "_text"):
            ids = words.value.read(rows.column(0).to_pylist(), as_bytes(rows.column(1)))
            for at in range(0, len(ids), sizes.buffer):
                held.append(phrases(ids[at : at + sizes.buffer + length - 1]))
                filled += len(held[-1][1])
                if filled >= sizes.buffer:
                    yield from counted(held)
                    held, filled = [], 0
        yield from counted(held)

    def phrases(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that lie in a piece and whose parts, one word shorter, may all be frequent."""
        n = max(0, len(ids) - length + 1)
        inside = np.ones(n, dtype=bool)
        for at in range(length):
            inside &= ids[at : at + n] >= 0
        starts = np.flatnonzero(inside)
        found = ids[starts[:, None] + np.arange(length)]
        if length == 2:
            return found, np.where(found[:, 0] < _HASHED, found[:, 0], -2)
        grams = shorter[-1].value
        first, last = grams.ranks(found[:, :-1]), grams.ranks(found[:, 1:])
        kept = (first != -1) & (last != -1)
        return found[kept], first[kept]

    def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        found, first = (np.concatenate(x) for x in zip(*held))
        held.clear()
        near = (first >= 0) & (found[:, -1] < _HASHED)
        left, right, counts = tile_counts(first[near], found[near, -1], sizes.side)
        if len(left):
            begin = left[:, None] if length == 2 else shorter[-1].value.ids[left]
            yield from passed_on(np.concatenate([begin, right[:, None]], axis=1), counts)
        if not near.all():
            yield from passed_on(*_coordinates(found[~near]))

    def passed_on(ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), sizes.passed):
            some = slice(at, at + sizes.passed)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*ids[some].T, counts[some].astype(np.int64))], [*columns, "c"])

    schema = ", ".join(f"{c} long" for c in [*columns, "c"])
    return docs.mapInArrow(run, schema).groupBy(*columns).agg(F.sum("c").alias("c"))


def _numbered(words: DataFrame, least: int, sizes: Sizes) -> tuple[DataFrame, Vocabulary]:
    """``(lang, word, c, id)`` of the frequent words, and the vocabulary for tasks."""
    spark = words.sparkSession
    frequent = words.filter(F.col("c") >= least)
    short = frequent.filter(F.octet_length("word") <= sizes.word_bytes)
    head = sorted(most_frequent(short, sizes.words, "c").collect(), key=lambda r: (-r.c, r.lang, bytes(r.word)))
    langs, texts = [r.lang for r in head], [bytes(r.word) for r in head]
    known = spark.createDataFrame([(x, y, i) for i, (x, y) in enumerate(zip(langs, texts))], "lang string, word binary, address long")
    named = words.join(F.broadcast(known), ["lang", "word"], "left")
    for seed in range(100):
        numbered = named.withColumn("id", F.coalesce("address", _hash_number(seed)))
        twice = numbered.filter("address is null").groupBy("id").agg(F.count("*").alias("n"), F.max("c").alias("c"))
        if twice.filter((F.col("n") > 1) & (F.col("c") >= least)).isEmpty():
            break
    else:
        raise ValueError("no seed names the words without collisions")
    numbered = stored(numbered.filter(F.col("c") >= least).drop("address"), "phrase-words")
    others = filter_of(numbered.filter(F.col("id") >= _HASHED), ["id"], sizes.filter_bits)
    return numbered, Vocabulary(langs, texts, seed, others, sizes.slice)


def _ranked(grams: DataFrame, columns: list[str], sizes: Sizes) -> Grams:
    """The frequent phrases of one length, for tasks."""
    head = most_frequent(grams, sizes.grams, "c").select(*columns, "c").toArrow()
    ids = np.stack([head.column(c).to_numpy() for c in columns], axis=1) if head.num_rows else np.zeros((0, len(columns)), np.int64)
    order = np.lexsort((*ids.T, -head.column("c").to_numpy()))
    return Grams(ids[order], filter_of(grams, columns, sizes.filter_bits))


def frequent_phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 3,
    least: int = 10,
    sizes: Sizes = Sizes(),
) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The counts of all words, ``(lang, word, c)``, and by length the phrases with at least ``least``
    occurrences: ``(lang, word, c, w1)`` of one word, ``(w1, ..., c)`` of more, words by number."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(_language(lang_col), text_of(text_col).alias("_text"))
    words = stored(word_counts(texts, sizes), "phrase-counts")
    numbered, vocabulary = _numbered(words, least, sizes)
    shared = context.broadcast(vocabulary)
    tables, shorter = {1: numbered.withColumnRenamed("id", "w1")}, []
    for length in range(2, longest + 1):
        counts = gram_counts(texts, shared, shorter, length, sizes).filter(F.col("c") >= least)
        tables[length] = stored(counts, f"phrases-{length}")
        if length < longest:
            shorter.append(context.broadcast(_ranked(tables[length], [f"w{i + 1}" for i in range(length)], sizes)))
    for one in (shared, *shorter):
        one.unpersist()
    return words, tables


def _cut(grams: DataFrame, tables: dict[int, DataFrame], length: int) -> DataFrame:
    """The phrases with the counts of both parts of each cut: ``l1, r1, l2, ...``."""
    for k in range(1, length):
        left = tables[k].select(*[F.col(f"w{i + 1}") for i in range(k)], F.col("c").alias(f"l{k}"))
        rest = length - k
        right = tables[rest].select(*[F.col(f"w{i + 1}").alias(f"w{k + i + 1}") for i in range(rest)], F.col("c").alias(f"r{k}"))
        grams = grams.join(left, [f"w{i + 1}" for i in range(k)]).join(right, [f"w{k + i + 1}" for i in range(rest)])
    return grams


def _score(k: int, scale: int) -> Column:
    """``floor(scale * a * a / (l * r))`` of a cut, in whole numbers of up to 38 digits."""
    whole = "decimal(15,0)"
    return F.expr(f"(cast({scale} as decimal(8,0)) * (cast(a as {whole}) * cast(a as {whole}))) div (cast(l{k} as {whole}) * cast(r{k} as {whole}))")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 3,
    least: int = 10,
    scale: int = 1_000_000,
    percent: int = 50,
    most: int = 2000,
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``most`` best phrases of 2 to ``longest``
    words with at least ``least`` occurrences, but those that a longer phrase holds ``percent`` of."""
    words, tables = frequent_phrases(docs, text_col, lang_col, longest, least, sizes)
    kinds = []
    for length in range(2, longest + 1):
        columns = [f"w{i + 1}" for i in range(length)]
        grams = _cut(tables[length], tables, length).withColumnRenamed("c", "a")
        if length < longest:  # a phrase inside a much longer one is inside one that is a word longer
            longer, names = tables[length + 1], [f"w{i + 1}" for i in range(length + 1)]
            parts = [longer.select(*[F.col(c).alias(w) for c, w in zip(some, columns)], "c") for some in (names[:-1], names[1:])]
            holding = parts[0].unionByName(parts[1]).groupBy(*columns).agg(F.max("c").alias("_holding"))
            grams = grams.join(holding, columns, "left").filter(F.col("_holding").isNull() | (100 * F.col("_holding") < percent * F.col("a")))
        cuts = [
            F.struct(_score(k, scale).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
            for k in range(1, length)
        ]
        grams = grams.withColumn("_cut", F.array_min(F.array(*cuts)))
        for number, column in enumerate(columns):
            spelt = tables[1].select(F.col("w1").alias(column), F.col("word").cast("string").alias(f"s{number + 1}"), *([] if number else ["lang"]))
            grams = grams.join(spelt, column)
        phrase = F.concat_ws(" ", *[f"s{i + 1}" for i in range(length)])
        kinds.append(grams.select("lang", phrase.alias("phrase"), "a", "_cut.l", "_cut.r", "_cut.score"))
    found = kinds[0]
    for more in kinds[1:]:
        found = found.unionByName(more)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A part of each language first, so that what one task ranks does not grow with the number of tasks.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    found = found.withColumn("_part", part).withColumn("_rank", best).filter(F.col("_rank") <= most).drop("_part", "_rank")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
