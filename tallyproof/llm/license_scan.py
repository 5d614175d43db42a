"""License scans by diagonal voting.

Templates are phrases and notices. Every text's rolling hashes of k words, for each k that a template uses,
are joined by Spark with the templates' places; a hit votes for a diagonal, the word where the template
would begin in the text. Votes are counted for each text, template and diagonal. Diagonals of a notice
that are at most ``SHIFT`` words apart are merged, because words left out or put in move a copy from one
diagonal to the next; a phrase keeps its diagonals apart, so it is found only where its words stand
consecutively. A merged span is verified by the words themselves: each hit's words are compared with the
template's, then the share of the template's words that are covered and the density of the span decide.

What moves: texts never do. A task hashes its texts in pieces and meets the templates, which are broadcast
after a check of their size; what is written is a row for each text and one for each hit. Words travel only
with hashes that a template has too. Groups are of one text and one template, so no key is hot.

Defined cases: a null text counts as empty and has no words; an empty table gives an empty table; a null id
and repeated rows are rows as any; very long texts are hashed piece by piece; texts without labels have
empty strings and score 0; no templates give no labels; a template without words is refused; only the id
and the text are read from the table, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyproof.llm.common import as_bytes, runs, text_of
from tallyproof.session import stored

#: Words of a rolling hash: of phrases, and of templates with at least twice ``NOTICE_WORDS``.
PHRASE_WORDS, NOTICE_WORDS = 2, 4
#: Diagonals of a notice that are no further apart are one span.
SHIFT = 3
#: What a notice's span must cover of the template, and of itself.
SHARE, DENSITY = 0.8, 0.5
#: The templates that may be broadcast have at most so many words together.
MOST_TEMPLATE_WORDS = 200_000
#: Bytes of a text that are cut into words at a time, and words that are hashed together.
PIECE, TOGETHER = 1 << 20, 1 << 16

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 32 for b in range(256))
_FACTOR = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Template:
    """A phrase or notice and the label it stands for; base templates are told apart in the result."""

    label: str
    text: str
    base: bool = False


#: Phrases of the contract, names and notices of public licenses.
TEMPLATES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
    Template("agpl", "gnu affero general public license"),
    Template("bsd", "bsd license"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("epl", "eclipse public license"),
    Template("gfdl", "gnu free documentation license"),
    Template("isc", "isc license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mpl", "mozilla public license"),
    Template(
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software",
    ),
)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lowered."""
    return text.translate(_PLAIN).split()


def word_pieces(text: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, so many bytes at a time; no word is cut."""
    text = text.translate(_PLAIN)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + most) if start + most < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The rolling hash of each ``size`` consecutive words, from the words' hashes."""
    n = max(0, len(hashes) - size + 1)
    total = np.full(n, size, dtype=np.uint64)
    for at in range(size):
        total = total * np.uint64(_FACTOR) + hashes[at : at + n]
    return (total ^ (total >> np.uint64(29))).view(np.int64)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_size(words: int) -> int:
    """How many words a template of so many is hashed by."""
    return min(words, NOTICE_WORDS if words >= 2 * NOTICE_WORDS else PHRASE_WORDS)


def template_places(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """``(_gram, _words, template, place, label, base, size, span, exact)``: each place of each template."""
    rows = []
    for number, one in enumerate(templates):
        words = words_of(one.text.encode())
        if not words:
            raise ValueError(f"the template for {one.label!r} has no words")
        size = gram_size(len(words))
        for place, gram in enumerate(gram_hashes(_hashes(words), size).tolist()):
            phrase = b" ".join(words[place : place + size])
            rows.append((gram, phrase, number, place, one.label, one.base, len(words), size, size < NOTICE_WORDS))
    if sum(r[7] for r in rows) > MOST_TEMPLATE_WORDS * NOTICE_WORDS:
        raise ValueError(f"the templates have over {MOST_TEMPLATE_WORDS} words, too many to broadcast")
    return spark.createDataFrame(
        rows, "_gram long, _words binary, template int, place int, label string, base boolean, size int, span int, exact boolean"
    )


def rolling(
    docs: DataFrame, id_col: str, text_col: str, sizes: list[int], wanted: np.ndarray, piece: int = PIECE, together: int = TOGETHER
) -> DataFrame:
    """A row ``(row, _id, n_words)`` for each text and one ``(row, at, gram, words)`` for each rolling hash
    of ``sizes`` words; the words themselves come with the hashes that are in ``wanted`` (sorted)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(wanted)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text"))
    kind = texts.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in runs([batch], "_text"):
                yield from grams(rows)

    def grams(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        id_type, totals = rows.column(1).type, []
        held: list[tuple[int, int, int, list[bytes]]] = []  # row, first word's number, words seen before, words
        filled = 0
        for row, text in zip(rows.column(0).to_pylist(), as_bytes(rows.column(2))):
            before: list[bytes] = []
            n = 0
            for words in word_pieces(text, piece):
                held.append((row, n - len(before), len(before), before + words))
                n, filled = n + len(words), filled + len(words)
                before = (before + words)[-(longest - 1) :] if longest > 1 else []
                if filled >= together:
                    yield from emit(held, id_type)
                    held, filled = [], 0
            totals.append(n)
        yield from emit(held, id_type)
        nothing = [pa.nulls(len(totals), k) for k in (pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(totals, pa.int64()), *nothing], names)

    def emit(held: list[tuple[int, int, int, list[bytes]]], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        words = [w for *_, some in held for w in some]
        if not words:
            return
        hashes, known = _hashes(words), shared.value
        lengths = np.array([len(some) for *_, some in held])
        row, first, seen = (np.repeat(np.array(x), lengths) for x in list(zip(*held))[:3])
        inside = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        left = np.repeat(lengths, lengths) - inside
        for size in sizes:
            # what lies in the words seen before was hashed with them
            places = np.flatnonzero((left >= size) & (inside + size > seen))
            found = gram_hashes(hashes, size)[places]
            at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
            hit = known[at] == found if len(known) else np.zeros(len(places), dtype=bool)
            for chosen in (~hit, hit):
                some = places[chosen]
                if len(some):
                    said = [b" ".join(words[i : i + size]) for i in some.tolist()] if chosen is hit else None
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row[some]),
                            pa.nulls(len(some), id_type),
                            pa.nulls(len(some), pa.int64()),
                            pa.array(first[some] + inside[some]),
                            pa.array(found[chosen]),
                            pa.nulls(len(some), pa.binary()) if said is None else pa.array(said, pa.binary()),
                        ],
                        names,
                    )

    longest = max(sizes, default=1)
    names = ["row", "_id", "n_words", "at", "gram", "words"]
    return texts.mapInArrow(run, f"row long, _id {kind}, n_words long, at long, gram long, words binary")


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    share: float = SHARE,
    density: float = DENSITY,
    shift: int = SHIFT,
    piece: int = PIECE,
) -> tuple[DataFrame, DataFrame]:
    """The texts ``(row, _id, n_words)``, and the spans found in them ``(row, template, label, base, first,
    last, score)``: first and last word, from 0, and the share of the template's words that are covered."""
    spark = docs.sparkSession
    places = template_places(spark, templates).persist()
    wanted = np.array(sorted({r[0] for r in places.select("_gram").collect()}), dtype=np.int64)
    sizes = sorted({r[0] for r in places.select("span").distinct().collect()})
    grams = rolling(docs, id_col, text_col, sizes, wanted, piece)
    same = (grams["gram"] == places["_gram"]) & (grams["words"] == places["_words"])
    met = grams.join(F.broadcast(places), same, "left").filter(F.col("at").isNull() | F.col("template").isNotNull())
    met = stored(met.drop("gram", "words", "_gram", "_words"), "license-hits")
    places.unpersist()
    texts = met.filter(F.col("at").isNull()).select("row", "_id", "n_words")
    facts = ["row", "template", "label", "base", "size", "span", "exact"]
    diagonals = (
        met.filter(F.col("at").isNotNull())
        .groupBy(*facts, (F.col("at") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.when(F.col("exact"), 0).otherwise(shift)
    numbered = diagonals.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn(
        "band", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
    spans = numbered.groupBy(*facts, "band").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.min("first").alias("first"),
        (F.max("last") + F.first("span") - 1).alias("last"),
    )
    words = F.transform("places", lambda p: F.sequence(p, p + F.col("span") - 1))
    covered = F.size(F.array_distinct(F.flatten(words)))
    spans = spans.withColumn("covered", covered).withColumn("score", F.col("covered") / F.col("size"))
    enough = F.when(F.col("exact"), F.col("covered") == F.col("size")).otherwise(
        (F.col("score") >= share) & (F.col("covered") >= density * (F.col("last") - F.col("first") + 1))
    )
    return texts, spans.filter(enough).select("row", "template", "label", "base", "first", "last", "score")


def labels(texts: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` and
    ``score`` of every text of `scan`."""
    of_text = spans.groupBy("row").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("_base"),
        F.collect_set("label").alias("_all"),
        F.max("score").alias("score"),
    )
    joined = texts.join(of_text, "row", "left")

    def listed(name: str):
        return F.coalesce(F.array_join(F.array_sort(name), ","), F.lit(""))

    return joined.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        listed("_base").alias("base_labels"),
        listed("_all").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
