"""Helpers that the corpus operators share: words, Arrow batches, picking rows by content."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words; ``bytes.split()`` without arguments splits at exactly these.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows are handled in runs of about so many bytes of text, whatever the size of an Arrow batch.
RUN_BYTES = 1 << 21


def text_of(name: str) -> Column:
    """A text column of any type; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    wide = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(wide).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], text: str, most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose texts have about ``most`` bytes together; a longer
    text is a slice of its own."""
    for batch in batches:
        start = taken = 0
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        for row, size in enumerate(sizes):
            if row > start and taken + (size or 0) > most:
                yield batch.slice(start, row - start)
                start, taken = row, 0
            taken += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def content_keys(id_col: str, text_col: str, prefix: str = "_k") -> list[Column]:
    """What tells rows apart without numbering them: id and two independent hashes of the text."""
    text = text_of(text_col)
    return [
        F.col(f"`{id_col}`").alias(f"{prefix}_id"),
        F.xxhash64(text).alias(f"{prefix}_a"),
        F.xxhash64(F.lit("second"), text).alias(f"{prefix}_b"),
    ]


def pick(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole row of ``docs`` for each row of ``chosen``, whose columns are ``_k_id, _k_a, _k_b``
    (`content_keys`), ``_k_n`` (how many rows of ``docs`` have this key) and, if a row may be wanted
    more than once, ``_k_copies``. Rows equal in id and text are repeats: any one of them is taken.

    Only keys that occur more than once, if there are any, are reduced by an aggregate; it combines
    before its shuffle, so that a row repeated very often stays small. Whole rows travel as one
    struct, so that no column of ``docs`` can clash with a key.
    """
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *content_keys(id_col, text_col, "_d"))
    same = (F.col("_d_a") == F.col("_k_a")) & (F.col("_d_b") == F.col("_k_b")) & F.col("_d_id").eqNullSafe(F.col("_k_id"))
    if chosen.filter("_k_n > 1").isEmpty():
        rows = mine.join(chosen, same)
    else:
        single = mine.join(chosen.filter("_k_n = 1"), same)
        repeated = mine.join(chosen.filter("_k_n > 1"), same).dropDuplicates(["_d_id", "_d_a", "_d_b"])
        rows = single.unionByName(repeated)
    if "_k_copies" in chosen.columns:
        rows = rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("_k_copies").cast("int"))))
    return rows.select("doc.*")
