"""The hashed maximum-entropy model of `lm_score`, in numpy.

The probability of a token given the two before it is that of its class times that of the token in its
class. The class is a softmax over the weights of hashed features: the word before (a 2-gram), the word
before that (a skip feature) and both together (a 3-gram). The token in its class is a softmax over a
weight of the token and one of the token with the class of the word before, normalised over the tokens of
the class, so a table holds all of it. Words outside the vocabulary share a class; how they divide its
probability is the caller's matter.
"""

from __future__ import annotations

import io
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np

CLASSES = 32
#: Features of each kind, a power of two, unless the caller asks for more.
BUCKETS = 1 << 12
#: Words outside the vocabulary are features by one of so many hashes, likewise.
RARE_HASHES = 1 << 10
FEATURES = 3
#: Tokens whose class probabilities are made at a time, few enough for a processor's cache.
BLOCK = 1 << 12
#: Rows that are added together before they are added up by bucket.
AT_ONCE = 8
#: Buckets of a kind that are summed and stored together.
SHARD = 1 << 10
END = b""


@dataclass
class Vocabulary:
    """Frequent words with their counts, most frequent first; the end of a text is one of them."""

    words: list[bytes]
    counts: np.ndarray
    hashes: int = RARE_HASHES

    def __post_init__(self):
        self.size = len(self.words)
        self.end = self.words.index(END)
        self.begin = self.size + self.hashes  # stands before a text

    @cached_property
    def number(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def read_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """The tokens of some texts, ends included, where each text begins, and the places and the words
        of those outside the vocabulary."""
        words: list[bytes] = []
        starts = []
        for text in texts:
            starts.append(len(words))
            words += text.lower().split()
            words.append(END)
        tokens = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        places = np.flatnonzero(tokens < 0)
        rare = [words[at] for at in places.tolist()]
        tokens[places] = self.size + np.fromiter(map(zlib.crc32, rare), np.int64, len(rare)) % self.hashes
        return tokens, np.array(starts, dtype=np.int64), places, rare

    def read(self, text: bytes) -> tuple[list[int], dict[bytes, int]]:
        """The tokens of a text, end included, and its words outside the vocabulary with counts."""
        tokens, _, _, rare = self.read_all([text])
        return tokens.tolist(), dict(Counter(rare))


def _scatter(index: np.ndarray, values: np.ndarray, into: np.ndarray) -> None:
    """Add the rows of ``values`` to the rows ``index`` of ``into``; ``values`` has one row more, of zeros,
    which fills each row's share up to a multiple of ``AT_ONCE``, so that most of the adding is done on
    whole arrays."""
    if len(into) <= 1 << 16:
        index = index.astype(np.uint16)  # sorted by digits
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    sizes = np.diff(np.append(first, len(index)))
    filled = -(-sizes // AT_ONCE)
    begins = np.cumsum(filled) - filled
    places = np.full(int(filled.sum()) * AT_ONCE, len(values) - 1)
    places[np.arange(len(index)) + np.repeat(begins * AT_ONCE - first, sizes)] = order
    places = places.reshape(-1, AT_ONCE)
    total = values.take(places[:, 0], axis=0)
    for at in range(1, AT_ONCE):
        total += values.take(places[:, at], axis=0)
    into[index[first]] += np.add.reduceat(total, begins, axis=0)


def largest(rows: np.ndarray) -> np.ndarray:
    """The largest number of each row, whose length is a power of two."""
    while rows.shape[1] > 1:
        half = rows.shape[1] // 2
        rows = np.maximum(rows[:, :half], rows[:, half:])
    return rows


def add_counts(cells: np.ndarray, into: np.ndarray) -> None:
    """Add 1 to a cell of the flat ``into`` for each time it is named."""
    np.add.at(into, cells, into.dtype.type(1))


def _points(contexts: np.ndarray) -> np.ndarray:
    """The square roots of the shares of each context."""
    points = contexts.astype(np.float32)
    points /= np.maximum(contexts.sum(axis=1, keepdims=True, dtype=np.float64), 1).astype(np.float32)
    return np.sqrt(points, out=points)


def centres(contexts: np.ndarray, counts: np.ndarray, groups: int, turns: int = 15) -> np.ndarray:
    """Centres of words by what stands near them: k-means, which begins with words far from all before."""
    points = _points(contexts)
    groups = min(groups, len(points))
    weight = np.sqrt(counts).astype(np.float32)
    chosen = [points[0]]
    distance = np.full(len(points), np.inf, dtype=np.float32)
    for _ in range(groups - 1):
        distance = np.minimum(distance, ((points - chosen[-1]) ** 2).sum(axis=1))
        chosen.append(points[int((distance * weight).argmax())])
    centre = np.array(chosen)
    for _ in range(turns):
        nearest = (points @ centre.T - 0.5 * (centre**2).sum(axis=1)).argmax(axis=1)
        total = np.bincount(nearest, weight, groups)
        for axis in range(points.shape[1]):
            sums = np.bincount(nearest, weight * points[:, axis], groups)
            centre[:, axis] = np.where(total > 0, sums / np.maximum(total, 1e-9), centre[:, axis])
    return centre


def nearest(contexts: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The group of each word."""
    return (_points(contexts) @ centre.T - 0.5 * (centre**2).sum(axis=1)).argmax(axis=1)


class Model:
    """Classes and weights; its size is set by the vocabulary and the number of buckets. ``groups`` are
    the classes of the vocabulary's words; without them they come from ``contexts``."""

    def __init__(
        self, vocabulary: Vocabulary, contexts: np.ndarray | None, rare_count: float, buckets: int = BUCKETS, groups: np.ndarray | None = None
    ):
        size = vocabulary.size
        if groups is None:
            groups = nearest(contexts, centres(contexts, vocabulary.counts, CLASSES - 2))
        self.unknown, self.ending = CLASSES - 1, CLASSES - 2
        self.class_of = np.full(vocabulary.begin + 1, self.unknown, dtype=np.int64)
        self.class_of[:size] = groups
        self.class_of[[vocabulary.end, vocabulary.begin]] = self.ending
        self.size, self.begin = size, vocabulary.begin
        self.bits = buckets.bit_length() - 1
        self.weights = np.zeros((FEATURES, buckets, CLASSES), dtype=np.float32)
        counts = vocabulary.counts + 0.5
        of_class = np.bincount(self.class_of[:size], counts, CLASSES)
        of_class[self.unknown] += rare_count + 0.5
        self.used = of_class > 0
        with np.errstate(divide="ignore"):
            self.bias = np.log(of_class / of_class.sum()).astype(np.float32)
        self.word_bias = np.log(counts / of_class[self.class_of[:size]])
        ids = np.arange(vocabulary.begin + 1, dtype=np.uint64)
        self.mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    @cached_property
    def of_word(self) -> np.ndarray:
        """The logarithm of each word's probability in its class, after each class."""
        return np.tile(self._normal(np.zeros(self.size)).astype(np.float32), (CLASSES, 1))

    @cached_property
    def _ordered(self) -> tuple[np.ndarray, np.ndarray]:
        """The words by class, and where each class begins."""
        own = self.class_of[: self.size]
        order = np.argsort(own, kind="stable")
        return order, np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1])))

    def _by_class(self, values: np.ndarray) -> np.ndarray:
        """The sum of ``values`` over the words of each class, given to each of its words."""
        order, first = self._ordered
        total = np.zeros(CLASSES)
        total[self.class_of[order[first]]] = np.add.reduceat(values[order], first)
        return total[self.class_of[: self.size]]

    def _normal(self, weights: np.ndarray) -> np.ndarray:
        """The logarithm of each word's probability in its class, after one class."""
        raw = self.word_bias + weights
        return raw - np.log(self._by_class(np.exp(raw)))

    def contexts(self, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two tokens before each; texts begin at ``starts``."""
        one, two = np.empty_like(tokens), np.empty_like(tokens)
        one[1:], two[2:] = tokens[:-1], tokens[:-2]
        one[starts] = self.begin
        two[starts] = self.begin
        after = starts[starts + 1 < len(tokens)] + 1
        two[after] = self.begin
        return one, two

    def buckets(self, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
        """The feature of each kind."""
        shift = np.uint64(64 - self.bits)
        a, b = self.mixed[one], self.mixed[two]
        both = (a ^ (b >> np.uint64(7)) ^ (b << np.uint64(13))) * np.uint64(0xD6E8FEB86659FD93)
        return [(x >> shift).astype(np.int64) for x in (a, b, both)]

    def logits(self, buckets: list[np.ndarray]) -> np.ndarray:
        """What the classes' probabilities are proportional to, as logarithms of no great size."""
        logits = self.weights[0].take(buckets[0], axis=0)
        for kind in range(1, FEATURES):
            logits += self.weights[kind].take(buckets[kind], axis=0)
        logits += self.bias
        return logits

    def classes(self, buckets: list[np.ndarray]) -> np.ndarray:
        """The logarithms of the classes' probabilities, a row for each context."""
        logits = self.logits(buckets)
        logits -= largest(logits)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return logits

    def score(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The natural logarithm of each token's probability; for words outside the vocabulary that of
        their class alone."""
        found = np.empty(len(tokens))
        one, two = self.contexts(tokens, starts)
        own, before = self.class_of[tokens], self.class_of[one]
        ones = np.ones(CLASSES, dtype=np.float32)
        rows = np.arange(BLOCK)
        for at in range(0, len(tokens), BLOCK):
            some = slice(at, at + BLOCK)
            logits = self.logits(self.buckets(one[some], two[some]))
            logits -= largest(logits)
            chosen = logits[rows[: len(logits)], own[some]]
            found[some] = chosen - np.log(np.exp(logits, out=logits) @ ones)
        known = np.flatnonzero(tokens < self.size)
        found[known] += self.of_word[before[known], tokens[known]]
        return found

    def gradient(self, tokens: np.ndarray, starts: np.ndarray, into: Gradient) -> None:
        """Add what these texts say of the weights: observed and expected counts."""
        one, two = self.contexts(tokens, starts)
        own, before = self.class_of[tokens], self.class_of[one]
        buckets = self.buckets(one, two)
        expected = np.empty((len(tokens) + 1, CLASSES), dtype=np.float32)
        expected[-1] = 0
        ones = np.ones(CLASSES, dtype=np.float32)
        for at in range(0, len(tokens), BLOCK):
            some = slice(at, at + BLOCK)
            logits = self.logits([b[some] for b in buckets])
            logits -= largest(logits)
            np.exp(logits, out=logits)
            np.divide(logits, (logits @ ones)[:, None], out=expected[at : at + len(logits)])
        for kind in range(FEATURES):
            add_counts(buckets[kind] * CLASSES + own, into.observed[kind].reshape(-1))
            _scatter(buckets[kind], expected, into.expected[kind])
        known = tokens < self.size
        add_counts(before[known] * self.size + tokens[known], into.words.reshape(-1))

    def move(self, observed: np.ndarray, expected: np.ndarray, rate: float = 1.0, damping: float = 2.0) -> np.ndarray:
        """How one update moves the weights of some buckets: each by the difference of the logarithms of
        its observed and expected counts, its gradient scaled by its own curvature, over the features of
        a context."""
        floor = damping * np.exp(self.bias) + 1e-9
        return (rate / FEATURES) * (np.log((observed + floor) / (expected + floor)) * self.used).astype(np.float32)

    def fit_words(self, seen: np.ndarray, turns: int = 20, damping: float = 5.0) -> np.ndarray:
        """The row of `of_word` after a class, from how often each word follows it: the counts hold all
        that the corpus says of them."""
        seen, weights = seen.astype(np.float64), np.zeros(self.size)
        of_word, of_class = self._normal(weights), self._by_class(seen)
        for _ in range(turns):
            expected = of_class * np.exp(of_word)
            weights += (seen - expected - damping * 0.1 * weights) / (expected + damping)
            np.clip(weights, -3, 3, out=weights)
            of_word = self._normal(weights)
        return of_word.astype(np.float32)


class Gradient:
    """Observed and expected counts of class features, and counts of words after classes."""

    def __init__(self, size: int, buckets: int = BUCKETS):
        self.observed = np.zeros((FEATURES, buckets, CLASSES), dtype=np.float32)
        self.expected = np.zeros((FEATURES, buckets, CLASSES), dtype=np.float32)
        self.words = np.zeros((CLASSES, size), dtype=np.int64)

    def shards(self) -> Iterator[tuple[int, bytes]]:
        """What is not zero, in parts that can be summed apart: by kind and range of buckets, and after
        those by the class before."""
        buckets = self.observed.shape[1]
        of_kind = -(-buckets // SHARD)
        for kind in range(FEATURES):
            for number in range(of_kind):
                some = slice(number * SHARD, (number + 1) * SHARD)
                both = np.concatenate([self.observed[kind, some], self.expected[kind, some]], axis=1)
                rows = np.flatnonzero(both[:, CLASSES:].any(axis=1)).astype(np.int32)
                if len(rows):
                    yield kind * of_kind + number, _packed(rows, both[rows])
        for number, counts in enumerate(self.words):
            rows = np.flatnonzero(counts).astype(np.int32)
            if len(rows):
                yield FEATURES * of_kind + number, _packed(rows, counts[rows])


def _packed(rows: np.ndarray, values: np.ndarray) -> bytes:
    return zlib.compress(len(rows).to_bytes(4, "little") + rows.tobytes() + values.tobytes(), 1)


def add_shard(data: bytes, into: np.ndarray) -> None:
    """Add a part of a gradient to the dense ``into``, which has its rows and type."""
    raw = zlib.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    rows = np.frombuffer(raw, np.int32, n, 4)
    into[rows] += np.frombuffer(raw, into.dtype, offset=4 + 4 * n).reshape(n, *into.shape[1:])


def to_file(arrays: dict[str, np.ndarray], out) -> None:
    data = io.BytesIO()
    np.savez(data, **arrays)
    out.write(data.getbuffer())


def from_file(file) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(file.read())))
