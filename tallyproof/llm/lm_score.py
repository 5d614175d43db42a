"""Language-model scores: a hashed maximum-entropy model beside a smoothed unigram model.

`fit` reads every training text. Words are counted by an aggregate that combines in each task. The most
frequent ones are the model's vocabulary; how many, and how many features it has, grows with the root of
the training tokens, while the number of classes is fixed; a histogram of the counts finds the
bound, so no task ranks all words. The vocabulary's classes come from counts of frequent neighbours:
their centres from its ``CENTRED`` most frequent words, each word's class in a task. Then the weights of
the class features are trained: in each round the tasks add up gradients over one slice of the training
texts, every text being in one slice. A task's gradient leaves it in parts, by range of buckets, of what
is not zero; the parts of a range are summed by one task, which makes the step and writes the range's new
weights to the shared folder, where the next round's tasks read them. The driver holds the vocabulary,
and of the weights nothing but the paths of their files; nothing of the model's size is broadcast.

`score` reads every text once. Sums over the vocabulary's words are made in the task with numpy blocks; a
text's other words are joined with their counts, which no broadcast could hold. In the model these words
share the probability of the class of unknown words in proportion to their smoothed counts, so its
probabilities add up to 1 over all training words and one unknown word, as those of the unigram model do.

Defined cases: a null text counts as empty; an empty text has its end as only token; a null id counts as
the empty text when texts are divided; equal rows score equally; without training texts every unigram
probability is 1; an empty table gives an empty table; only the id and the text are read from the table,
so other columns never clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import as_bytes, runs, text_of
from tallyproof.llm.files import new_folder, open_to_read, open_to_write, own_name
from tallyproof.llm.maxent import (
    BUCKETS,
    CLASSES,
    END,
    FEATURES,
    RARE_HASHES,
    SHARD,
    Gradient,
    Model,
    Vocabulary,
    add_counts,
    add_shard,
    centres,
    from_file,
    nearest,
    to_file,
)
from tallyproof.session import delete_path, stored

MOST_WORDS = 1 << 15
#: Up to so many training tokens the model has its least size; beyond, it grows with their square root.
LEAST_TOKENS = 1 << 22
#: Frequent words whose nearness tells words apart.
ANCHORS = 32
RATES = (1.5, 1.0, 0.7, 0.5)
#: The most frequent words, from which the centres of the classes are made.
CENTRED = 1 << 16
#: Different words that a task counts before it passes the counts on.
HELD_WORDS = 200_000
_BINS = 8  # of the histogram, for each doubling of the count


def grown(least: int, tokens: int) -> int:
    """A size of the model for so many training tokens; as a language's different words, about their root."""
    return int(least * math.sqrt(max(1.0, tokens / LEAST_TOKENS)))


def remainder(ident: Column, of: int) -> Column:
    """crc32 of an id as text, modulo ``of``; of a null id that of the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % of


_held: dict[tuple, Any] = {}


def _once(kind: str, of: Any, make: Callable) -> Any:
    """What a worker, or the driver, made of some files; the last one of a kind is kept."""
    if (kind, of) not in _held:
        for known in [k for k in _held if k[0] == kind]:
            del _held[known]
        _held[kind, of] = make()
    return _held[kind, of]


@dataclass(frozen=True)
class Files:
    """Where a model lies in the shared folder: its vocabulary, classes, weights by range of buckets and,
    when it is complete, words by the class before."""

    folder: str
    buckets: int
    rare_count: float
    classes: str = ""
    weights: tuple[tuple[int, str], ...] = ()
    words: tuple[tuple[int, str], ...] = ()

    def vocabulary(self) -> Vocabulary:
        return _once("vocabulary", self.folder, self._vocabulary)

    def _vocabulary(self) -> Vocabulary:
        with open_to_read(f"{self.folder}/vocabulary.npz") as file:
            found = from_file(file)
        return Vocabulary(found["words"].tobytes().split(b"\n"), found["counts"], int(found["hashes"]))

    def model(self) -> Model:
        return _once("model", self, self._model)

    def _model(self) -> Model:
        with open_to_read(self.classes) as file:
            groups = from_file(file)["classes"]
        model = Model(self.vocabulary(), None, self.rare_count, self.buckets, groups)
        of_kind = -(-self.buckets // SHARD)
        for shard, path in self.weights:
            kind, number = divmod(shard, of_kind)
            with open_to_read(path) as file:
                model.weights[kind, number * SHARD : (number + 1) * SHARD] = from_file(file)["weights"]
        if self.words:
            model.of_word = np.empty((CLASSES, model.size), dtype=np.float32)
            for before, path in self.words:
                with open_to_read(path) as file:
                    model.of_word[before] = from_file(file)["of_word"]
        return model


@dataclass
class Fitted:
    """The model's files, and the table ``words(word, c)`` of the training counts of all words."""

    words: DataFrame
    files: Files
    tokens: int  # N
    different: int  # V
    texts: int

    @property
    def vocabulary(self) -> Vocabulary:
        return self.files.vocabulary()

    @property
    def model(self) -> Model:
        return self.files.model()

    def log10(self, count: np.ndarray | float):
        """The smoothed unigram probability of a token with such a count."""
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.different + 1)))

    @property
    def rare(self) -> float:
        """The unigram probability of all words outside the vocabulary, one unseen word included."""
        count = self.tokens - self.vocabulary.counts.sum()
        kinds = self.different - int((self.vocabulary.counts > 0).sum())
        return (count + 0.5 * (kinds + 1)) / (self.tokens + 0.5 * (self.different + 1))


def _word_counts(texts: DataFrame) -> DataFrame:
    """``(word, c)`` of all texts. The empty word stands for the texts' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in as_bytes(batch.column("_text")):
                found.update(text.lower().split())
                found[END] += 1
                if len(found) > HELD_WORDS:
                    yield _counted(found)
                    found = Counter()
        yield _counted(found)

    def _counted(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"]
        )

    return texts.select("_text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _vocabulary(words: DataFrame, most: int, hashes: int) -> Vocabulary:
    """The most frequent words: all with at least the count that admits no more than ``most``."""
    bin_of = F.floor(F.log2("c") * _BINS).cast("int")
    histogram = {r.bin: r.n for r in words.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, None
    for number in sorted(histogram, reverse=True):
        total += histogram[number]
        if total > most:
            break
        least = number
    chosen = words.filter((F.lit(False) if least is None else bin_of >= least) | (F.octet_length("word") == 0)).toArrow()
    found, counts = chosen.column("word").to_pylist(), chosen.column("c").to_numpy()
    if END not in found:
        found, counts = [*found, END], np.append(counts, 0)
    order = sorted(range(len(found)), key=lambda i: (-counts[i], found[i]))
    return Vocabulary([found[i] for i in order], counts[order].astype(np.int64), hashes)


def _token_runs(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of runs of texts, and where each text begins."""
    for rows in runs(batches, "_text"):
        tokens, starts, _, _ = vocabulary.read_all(as_bytes(rows.column("_text")))
        yield tokens, starts


def _classes(texts: DataFrame, files: Files, size: int) -> str:
    """The file of the classes of the vocabulary's words, by how often each word stands within two tokens
    of each anchor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = files.vocabulary()
        anchors = [i for i in range(words.size) if i != words.end][:ANCHORS]
        number = np.full(words.begin + 1, -1)
        number[anchors] = np.arange(len(anchors))
        total = np.zeros(words.size * ANCHORS, dtype=np.int64)
        for tokens, _ in _token_runs(batches, words):
            known, anchor = tokens < words.size, number[tokens]
            for distance in (1, 2):
                for word, near in ((slice(None, -distance), slice(distance, None)), (slice(distance, None), slice(None, -distance))):
                    some = known[word] & (anchor[near] >= 0)
                    add_counts(tokens[word][some] * ANCHORS + anchor[near][some], total)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells // ANCHORS), pa.array(cells % ANCHORS), pa.array(total[cells])], ["word", "anchor", "n"])

    sums = texts.select("_text").mapInArrow(count, "word long, anchor long, n long").groupBy("word", "anchor").agg(F.sum("n").alias("n"))
    sums = stored(sums, "neighbours")
    rows = sums.filter(F.col("word") < CENTRED).toArrow()
    contexts = np.zeros((min(size, CENTRED), ANCHORS), dtype=np.float32)
    contexts[rows.column("word").to_numpy(), rows.column("anchor").to_numpy()] = rows.column("n").to_numpy()
    centre = centres(contexts, files.vocabulary().counts[: len(contexts)], CLASSES - 2)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if held:
            word, anchor, n = (np.concatenate(x) for x in zip(*held))
            own, row = np.unique(word, return_inverse=True)
            contexts = np.zeros((len(own), ANCHORS), dtype=np.float32)
            contexts[row, anchor] = n
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(nearest(contexts, centre))], ["word", "class"])

    placed = sums.repartition(max(1, size >> 14), F.shiftright("word", 10)).mapInArrow(place, "word long, class long").toArrow()
    alone = nearest(np.zeros((1, ANCHORS)), centre)[0]
    classes = np.full(size, alone, dtype=np.uint8)
    classes[placed.column("word").to_numpy()] = placed.column("class").to_numpy()
    path = f"{files.folder}/classes.npz"
    with open_to_write(path) as out:
        to_file({"classes": classes}, out)
    return path


def _round(texts: DataFrame, files: Files, size: int, rate: float) -> tuple[dict[int, str], dict[int, str]]:
    """A step over some texts: the files of the ranges of weights that moved, and those of how often each
    word follows a class. No more tasks than there are cores make gradients, because what each passes on
    has up to the model's size however few its texts are."""
    spark, buckets = texts.sparkSession, files.buckets
    partitions, cores = texts.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    of_kind = -(-buckets // SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model, own = files.vocabulary(), files.model(), Gradient(size, buckets)
        for tokens, starts in _token_runs(batches, words):
            model.gradient(tokens, starts, own)
        for shard, data in own.shards():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([data], pa.binary())], ["shard", "data"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard not in sums:
                    counted = shard >= FEATURES * of_kind
                    sums[shard] = np.zeros(size, np.int64) if counted else np.zeros((min(SHARD, buckets), 2 * CLASSES), np.float32)
                add_shard(data.as_py(), sums[shard])
        for shard, total in sums.items():
            kind, number = divmod(shard, of_kind)
            path = own_name(files.folder, "npz")
            if kind >= FEATURES:
                found = {"counts": total}
            else:
                model = files.model()
                old = model.weights[kind, number * SHARD : (number + 1) * SHARD]
                found = {"weights": old + model.move(*np.split(total, 2, axis=1), rate)}
            with open_to_write(path) as out:
                to_file(found, out)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path])], ["shard", "path"])

    parts = texts.select("_text").coalesce(max(1, min(partitions, cores))).mapInArrow(run, "shard int, data binary")
    made = {r.shard: r.path for r in parts.repartition(2 * cores, "shard").mapInArrow(step, "shard int, path string").collect()}
    first = FEATURES * of_kind
    return {s: p for s, p in made.items() if s < first}, {s - first: p for s, p in made.items() if s >= first}


def _fit_words(spark, files: Files, counts: list[dict[int, str]]) -> tuple[tuple[int, str], ...]:
    """The files of the words' probabilities after each class; a task for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before in batch.column(0).to_pylist():
                model = files.model()
                seen = np.zeros(model.size, dtype=np.int64)
                for paths in counts:
                    if before in paths:
                        with open_to_read(paths[before]) as file:
                            seen += from_file(file)["counts"]
                path = own_name(files.folder, "npz")
                with open_to_write(path) as out:
                    to_file({"of_word": model.fit_words(seen)}, out)
                yield pa.RecordBatch.from_arrays([pa.array([before], pa.int32()), pa.array([path])], ["before", "path"])

    tasks = min(CLASSES, 2 * spark.sparkContext.defaultParallelism)
    rows = spark.range(0, CLASSES, 1, tasks).mapInArrow(run, "before int, path string").collect()
    return tuple(sorted((r.before, r.path) for r in rows))


def fit(
    docs: DataFrame,
    learn: Callable[[Column], Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_words: int | None = None,
    rates: tuple[float, ...] = RATES,
) -> Fitted:
    """Fit on the rows whose id ``learn`` admits; one round for each of ``rates``, on a slice of them.
    Buckets, hashes and, without ``most_words``, the vocabulary grow with the training tokens."""
    ident = F.col(f"`{id_col}`")
    kept = docs if learn is None else docs.filter(learn(ident))
    texts = kept.select(text_of(text_col).alias("_text"), (F.floor(remainder(ident, 1 << 20) / 5) % len(rates)).alias("slice"))
    words = stored(_word_counts(texts), "word-counts")
    totals = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.expr("if(octet_length(word) = 0, c, 0)")), F.lit(0))
    ).first()
    most = grown(MOST_WORDS, totals[0]) if most_words is None else most_words
    vocabulary = _vocabulary(words, most, grown(RARE_HASHES, totals[0]))
    buckets = 1 << (grown(BUCKETS, totals[0]) - 1).bit_length()
    kinds = totals[1] - int((vocabulary.counts > 0).sum())
    rare_count = float(totals[0] - vocabulary.counts.sum() + 0.5 * kinds)
    files = Files(new_folder(docs.sparkSession, "model"), buckets, rare_count)
    with open_to_write(f"{files.folder}/vocabulary.npz") as out:
        names = np.frombuffer(b"\n".join(vocabulary.words), np.uint8)
        to_file({"words": names, "counts": vocabulary.counts, "hashes": np.array(vocabulary.hashes)}, out)
    size = vocabulary.size
    files = replace(files, classes=_classes(texts, files, size))
    counts: list[dict[int, str]] = []
    for number, rate in enumerate(rates):
        moved, seen = _round(texts.filter(F.col("slice") == number), files, size, rate)
        files = replace(files, weights=tuple(sorted({**dict(files.weights), **moved}.items())))
        counts.append(seen)
    files = replace(files, words=_fit_words(docs.sparkSession, files, counts))
    return Fitted(words, files, int(totals[0]), int(totals[1]), int(totals[2]))


def score(docs: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every row."""
    made: list[str] = []
    files, trained, different = fitted.files, fitted.tokens, fitted.different

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = files.vocabulary(), files.model()
        known = vocabulary.counts > 0
        unigram = np.log10((vocabulary.counts + 0.5) / (trained + 0.5 * (different + 1)))
        for rows in runs(batches, "_text"):
            ids, begins, places, rare = vocabulary.read_all(as_bytes(rows.column(2)))
            counted = Counter(zip((np.searchsorted(begins, places, side="right") - 1).tolist(), rare))
            of_text = np.fromiter((t for t, _ in counted), np.int64, len(counted))  # in the texts' order
            ends = np.searchsorted(of_text, np.arange(len(begins) + 1))
            frequent = ids < vocabulary.size
            base, found = np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
            base[frequent], found[frequent] = unigram[ids[frequent]], known[ids[frequent]]
            pairs = pa.StructArray.from_arrays(
                [pa.array([w for _, w in counted], pa.binary()), pa.array(list(counted.values()), pa.int64())], ["word", "n"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(1),
                    pa.array(np.diff(np.append(begins, len(ids)))),
                    pa.array(np.add.reduceat(found, begins)),
                    pa.array(np.add.reduceat((~frequent).astype(np.int64), begins)),
                    pa.array(np.add.reduceat(base, begins)),
                    pa.array(np.add.reduceat(model.score(ids, begins), begins) / math.log(10)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                ],
                ["row", id_col, "n_tokens", "known", "n_rare", "base", "model", "rare"],
            )

    wanted = docs.select(F.monotonically_increasing_id(), F.col(f"`{id_col}`"), text_of(text_col).alias("_text"))
    kind = wanted.schema[1].dataType.simpleString()
    rows = stored(
        wanted.mapInArrow(
            run,
            f"row long, `{id_col}` {kind}, n_tokens long, known long, n_rare long, base double, model double, "
            "rare array<struct<word: binary, n: long>>",
        ),
        "frequent-words",
        made,
    )
    uses = rows.select("row", F.explode("rare").alias("rare")).select("row", "rare.word", "rare.n")
    counts = fitted.words.withColumnRenamed("c", "count")
    joined = uses.join(counts, "word", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = fitted.tokens + 0.5 * (fitted.different + 1)
    sums = joined.groupBy("row").agg(
        F.sum(F.expr("if(count > 0, n, 0)")).alias("known_rare"),
        F.sum(F.col("n") * F.log10((F.col("count") + 0.5) / F.lit(total))).alias("base_rare"),
    )
    of_rare = math.log10(fitted.rare)
    base_rare = F.coalesce("base_rare", F.lit(0.0))
    result = rows.drop("rare").join(sums, "row", "left").select(
        F.col(f"`{id_col}`"),
        "n_tokens",
        (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        (F.col("base") + base_rare).alias("base_score"),
        (F.col("model") + base_rare - F.col("n_rare") * of_rare).alias("score"),
    )
    result = stored(result, "scores")
    for path in made:
        delete_path(docs.sparkSession, path)
    return result
