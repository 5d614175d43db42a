"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A document is a vector of counts in four blocks: its words, hashed into ``words`` buckets, which carry the
space with weight 1; and, with weight 0.5 each, the shapes of its words (classes of their first and last
character), the shapes of their junctions, and a class of the share of its words that repeat the one
before (`Space`). Counts are damped by a logarithm and weighted by how few documents of the whole corpus
have the feature; each block has unit length times its weight.
The leading singular vectors of the labelled documents span the latent space. Every document is projected
and compared, by exact cosine products in blocks, with all labelled vectors; its nearest ``neighbours``
vote with their labels, weighted by a power of their similarity.

``most_labelled`` bounds the labelled rows that are fitted and broadcast: those with the smallest hash of
their id. The document frequencies cover all documents. Labels, language, source and id are no inputs of a
score.

Defined cases: a null text counts as empty; a document without words scores the share of label 1 among
the labelled; several labels of an id are averaged, null labels and labels without a document are not
used, and without any label all scores are 0.5; of rows with the same id one is fitted; a null id is
scored and never held out; equal texts score equally; an empty table gives an empty table; only the named
columns are read from the tables, so other columns never clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.llm.common import BLANKS, as_bytes, runs, text_of
from tallyproof.session import stored

SHAPES, WORDS = 16, 2047
#: Upper bounds of the classes of repeating words, as shares.
REPEATS = (0.0, 0.02, 0.1, 0.3)


@dataclass(frozen=True)
class Space:
    """The features: buckets of words, and the weights of the blocks."""

    words: int = WORDS
    word_weight: float = 1.0
    shape_weight: float = 0.5
    repeat_weight: float = 0.5

    @property
    def blocks(self) -> tuple[tuple[int, float], ...]:
        """The first feature of each block, and its weight."""
        after = 2 * SHAPES**2
        return ((0, self.shape_weight), (SHAPES**2, self.shape_weight), (after, self.word_weight), (after + self.words, self.repeat_weight))

    @property
    def features(self) -> int:
        return self.blocks[-1][0] + len(REPEATS) + 1


BLOCKS = Space().blocks
DIMENSIONS = 64
MOST_LABELLED = 4096
NEIGHBOURS = 32
POWER = 4
#: Documents whose products with all labelled vectors are held at a time.
BLOCK = 256
#: Bytes of texts, and documents, whose counts are held at a time.
RUN_BYTES, RUN_ROWS = 1 << 20, 1 << 10

_CLASS = np.full(256, 1, dtype=np.uint8)  # letters, and all beyond ASCII
for _signs, _number in (
    (BLANKS, 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (".", 4), (",", 5), ("!?", 6), ("#", 7),
    ("$", 8), ("%", 9), ("&", 10), ("*", 11), ("|", 12), ("<>", 13), ("-_/\\'\"()[]", 14), (":;=+@^~`{}", 15),
):
    _CLASS[list(_signs.encode())] = _number
_PRIME = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    powers = np.full(n, base, dtype=np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch ``data[start:end]``, that does not depend on where it stands: differences
    of one running sum of bytes times powers, taken back by the inverse power of the start."""
    inverse = pow(_PRIME, -1, 1 << 64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), _PRIME), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(len(data) + 1, inverse)[starts]
    hashes ^= hashes >> np.uint64(32)
    return hashes * np.uint64(0xD6E8FEB86659FD93)


def features(texts: list[bytes], space: Space = Space()) -> np.ndarray:
    """A row of counts for each text."""
    width = space.features
    joined = b"\n".join([*texts, b""])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = np.frombuffer(joined, np.uint8)
    kind = _CLASS[data]
    edge = np.diff(np.concatenate(([0], (kind > 0).astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(np.cumsum(sizes), starts, side="right")
    first, last = kind[starts].astype(np.int64), kind[np.maximum(ends - 1, 0)].astype(np.int64)
    hashes = word_hashes(data, starts, ends)
    same_text = row[1:] == row[:-1]
    junction = SHAPES * SHAPES + last[:-1] * SHAPES + first[1:]
    again = same_text & (hashes[1:] == hashes[:-1])
    words = 2 * SHAPES * SHAPES + ((hashes >> np.uint64(33)) % np.uint64(space.words)).astype(np.int64)
    cells = np.concatenate(
        [
            row * width + first * SHAPES + last,
            (row[1:] * width + junction)[same_text],
            row * width + words,
        ]
    )
    counts = np.bincount(cells, minlength=len(texts) * width).reshape(len(texts), width)
    n_words = np.bincount(row, minlength=len(texts))
    repeating = np.bincount(row[1:][again], minlength=len(texts)) / np.maximum(n_words, 1)
    some = np.flatnonzero(n_words)
    counts[some, space.blocks[-1][0] + np.searchsorted(REPEATS, repeating[some])] = 1
    return counts


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches, text, RUN_BYTES):
        for at in range(0, batch.num_rows, RUN_ROWS):
            yield batch.slice(at, RUN_ROWS)


def _weighted(counts: np.ndarray, rarity: np.ndarray, space: Space = Space()) -> np.ndarray:
    values = np.log1p(counts).astype(np.float32) * rarity
    ends = [start for start, _ in space.blocks[1:]] + [space.features]
    for (start, weight), end in zip(space.blocks, ends):
        values[:, start:end] = _unit(values[:, start:end]) * np.float32(weight)
    return values


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-12)


class Voters:
    """The fitted space and the labelled vectors in it; its size is bounded by ``most_labelled``."""

    def __init__(
        self, counts: np.ndarray, labels: np.ndarray, rarity: np.ndarray, dimensions: int, neighbours: int, power: float, space: Space = Space()
    ):
        self.space = space
        self.rarity, self.labels, self.neighbours, self.power = rarity, labels.astype(np.float32), neighbours, power
        self.prior = float(labels.mean()) if len(labels) else 0.5
        products = np.zeros((space.features, space.features))
        for at in range(0, len(counts), BLOCK):  # a block at a time, so that the counts are held once
            values = _weighted(counts[at : at + BLOCK], rarity, space).astype(np.float64)
            products += values.T @ values
        _, vectors = np.linalg.eigh(products)
        self.basis = np.ascontiguousarray(vectors[:, -dimensions:]).astype(np.float32)
        del products, vectors
        projected = [_weighted(counts[at : at + BLOCK], rarity, space) @ self.basis for at in range(0, len(counts), BLOCK)]
        self.voters = _unit(np.concatenate(projected)) if projected else np.zeros((0, self.basis.shape[1]), np.float32)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Between 0 and 1 for each row of counts."""
        found = np.full(len(counts), self.prior)
        if not len(self.labels):
            return found
        k = min(self.neighbours, len(self.labels))
        for at in range(0, len(counts), BLOCK):
            some = counts[at : at + BLOCK]
            products = _unit(_weighted(some, self.rarity, self.space) @ self.basis) @ self.voters.T
            nearest = np.argpartition(-products, k - 1, axis=1)[:, :k]
            weights = np.maximum(np.take_along_axis(products, nearest, axis=1), 0).astype(np.float64) ** self.power
            total = weights.sum(axis=1)
            votes = (weights * self.labels[nearest]).sum(axis=1)
            usable = (total > 0) & (some.sum(axis=1) > 0)
            found[at : at + BLOCK] = np.where(usable, votes / np.maximum(total, 1e-300), self.prior)
        return np.clip(found, 0.0, 1.0)


def remainder(ident: Column, of: int) -> Column:
    """crc32 of an id as text, modulo ``of``; of a null id that of the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % of


def _frequencies(docs: DataFrame, space: Space) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(space.features + 1, dtype=np.int64), 0
        for batch in _slices(batches, "_text"):
            total[:-1] += (features(as_bytes(batch.column("_text")), space) > 0).sum(axis=0)
            rows += batch.num_rows
        total[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(space.features + 1)), pa.array(total)], ["feature", "n"])

    sums = docs.select("_text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    n = np.zeros(space.features + 1, dtype=np.int64)
    for r in sums.collect():
        n[r.feature] = r.n
    return n[:-1], int(n[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_labelled: int = MOST_LABELLED,
    dimensions: int = DIMENSIONS,
    neighbours: int = NEIGHBOURS,
    power: float = POWER,
    learn: Column | None = None,
    space: Space = Space(),
) -> Voters:
    """Fit on the labelled documents that ``learn``, a condition on the labels' ``id_col``, admits."""
    known = labels.filter(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    if learn is not None:
        known = known.filter(learn)
    known = known.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.avg(F.col(f"`{label_col}`").cast("double")).alias("label"))
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("_text"))
    known = known.join(plain.select("id").distinct(), "id", "left_semi")
    chosen = stored(known.orderBy(F.xxhash64("id"), "id").limit(most_labelled), "labelled")
    one = Window.partitionBy("id").orderBy(F.xxhash64("_text"), "_text")
    of_chosen = plain.join(F.broadcast(chosen), "id")
    fitted = of_chosen.withColumn("_n", F.row_number().over(one)).filter("_n = 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "_text"):
            counts = [zlib.compress(c.astype("<u4").tobytes(), 1) for c in features(as_bytes(batch.column("_text")), space)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(counts, pa.binary())], ["id", "label", "counts"])

    kind = fitted.schema["id"].dataType.simpleString()
    rows = fitted.select("id", "label", "_text").mapInArrow(run, f"id {kind}, label double, counts binary")
    rows = sorted(rows.collect(), key=lambda r: r.id)
    counts = np.empty((len(rows), space.features), dtype="<u4")
    for row, r in zip(counts, rows):
        row[:] = np.frombuffer(zlib.decompress(r.counts), "<u4")
    in_documents, n_documents = _frequencies(plain, space)
    rarity = np.log((n_documents + 1) / (in_documents + 1)).astype(np.float32) + np.float32(1)
    return Voters(counts, np.array([r.label for r in rows]), rarity, dimensions, neighbours, power, space)


def score(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "_text"):
            scores = shared.value.scores(features(as_bytes(batch.column(1)), shared.value.space))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    wanted = docs.select(F.col(f"`{id_col}`"), text_of(text_col).alias("_text"))
    kind = wanted.schema[0].dataType.simpleString()
    return wanted.mapInArrow(run, f"`{id_col}` {kind}, score double")
