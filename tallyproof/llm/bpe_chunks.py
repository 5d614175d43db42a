"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 32 bytes cuts each text into chunks: a cut depends on the bytes before it alone, so
a passage that documents share gives the same chunks in all of them, wherever it stands. A task encodes
each different chunk once and keeps it, within a bounded number of bytes, for the documents after. Chunks
are cut at any character, so the ids at a join may be wrong; they are repaired by encoding a window over
the join again, as one text, with whole words on both sides. When the window's outer words come out with
the ids that the chunks have for them, what lies between is right and replaces the chunks' ids; when not,
the window is widened and encoded again, and at last the whole document. This is exact for tokenizers
whose ids, beyond agreeing outer words, do not depend on what is further away. A word over many chunks, as
in texts without blanks, is one join, so the work stays in proportion to the text.

Nothing is shuffled, and rows are handled in runs of about 2 MB of text. A lost task is run again without
any effect on the others.

Defined cases: a null text counts as empty; an empty text or one of blanks has no ids and decodes to the
empty text; strings of special tokens inside a text are what the library makes of them; equal rows are
encoded alike; an empty table gives an empty table; only the id and the text are read from the table, so
other columns never clash.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.bpe import Encoder, encoder, shared_file
from tallyproof.llm.common import as_bytes, runs, text_of

#: A cut where so many high bits of the hash are zero: 512 bytes apart on average.
CUT_BITS = 9
WINDOW = 32
LEAST, MOST = 128, 4096
#: Bytes of chunks that a worker keeps, and the outer words that it keeps of each.
KEPT_BYTES = 4 << 20
OUTER = 5

_GEAR = np.random.default_rng(42).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of ``gear[byte] << distance`` over the last 32 bytes, modulo 2**32."""
    hashes, width = _GEAR[data], 1
    while width < WINDOW:
        hashes[width:] = hashes[width:] + (hashes[:-width] << np.uint32(width))
        width *= 2
    return hashes


def cut(text: bytes) -> list[bytes]:
    """Content-defined chunks that together are ``text``; cuts lie between characters."""
    if len(text) <= LEAST:
        return [text] if text else []
    data = np.frombuffer(text, np.uint8)
    begins = (data & 0xC0) != 0x80  # not within a character
    wanted = np.flatnonzero(rolling_hashes(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
    chunks, start, last = [], 0, len(text)
    for end in [*wanted.tolist(), last]:
        while end - start > MOST:  # no wanted cut for long
            forced = start + MOST
            while not begins[forced]:
                forced -= 1
            chunks.append(text[start:forced])
            start = forced
        if end == last:
            break
        while end < last and not begins[end]:
            end += 1
        if end - start >= LEAST and end < last:
            chunks.append(text[start:end])
            start = end
    if start < last:
        chunks.append(text[start:])
    return chunks


@dataclass(slots=True)
class Chunk:
    """A chunk's ids, its number of words, and its outer words with the ids of each. The first and
    the last word may be parts of longer ones."""

    ids: bytes
    n_words: int
    first: list[bytes]
    first_ids: list[bytes]
    last: list[bytes]
    last_ids: list[bytes]
    blank_first: bool
    blank_last: bool


class ChunkEncoder:
    """Encodes documents from chunks, keeping those it has encoded."""

    def __init__(self, words: Encoder):
        self.words = words
        self.kept: OrderedDict[bytes, Chunk] = OrderedDict()
        self.bytes = 0
        self.reused = self.encoded = self.whole = 0

    def prepare(self, pieces: list[bytes]) -> dict[bytes, Chunk]:
        """The chunks of some texts: those that are kept, and the others encoded together."""
        found, new = {}, []
        for data in dict.fromkeys(pieces):
            if data in self.kept:
                self.kept.move_to_end(data)
                found[data] = self.kept[data]
            else:
                new.append(data)
        words = [data.split() for data in new]
        ids = self.words.ids_of_words([w for some in words for w in some])
        at, blank = 0, b" \t\n\r\x0b\x0c"
        for data, some in zip(new, words):
            own = ids[at : at + len(some)]
            at += len(some)
            found[data] = self.kept[data] = Chunk(
                b"".join(own), len(some), some[:OUTER], own[:OUTER], some[-OUTER:], own[-OUTER:], data[0] in blank, data[-1] in blank
            )
            self.bytes += len(data)
        while self.bytes > KEPT_BYTES:
            self.bytes -= len(self.kept.popitem(last=False)[0])
        self.encoded += len(new)
        self.reused += len(pieces) - len(new)
        return found

    def documents(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        cuts = [cut(text) for text in texts]
        chunks = self.prepare([data for pieces in cuts for data in pieces])
        return [self.assemble(text, [chunks[data] for data in pieces]) for text, pieces in zip(texts, cuts)]

    def document(self, text: bytes) -> bytes:
        return self.documents([text])[0]

    def assemble(self, text: bytes, chunks: list[Chunk]) -> bytes:
        """The ids of a text from its chunks, with repaired joins. A word that goes over several chunks
        is encoded once, at its end."""
        parts: list[bytes] = []
        words: list[bytes] = []  # the last few, and their ids
        ids: list[bytes] = []
        open_end = False  # the last word may go on
        more: list[bytes] = []  # how it went on so far
        for chunk in [*chunks, _NOTHING]:
            goes_on = open_end and chunk.n_words > 0 and not chunk.blank_first
            if goes_on:
                more.append(chunk.first[0])
                if chunk.n_words == 1 and not chunk.blank_last:
                    continue
            if more:
                middle = words[-1] + b"".join(more)
                repaired = self.join(words[:-1], ids[:-1], middle, chunk if goes_on else _NOTHING)
                if repaired is None:
                    self.whole += 1
                    return self.words.ids(text)
                if ids[-1]:  # the part of the word that was encoded before
                    parts[-1] = parts[-1][: len(parts[-1]) - len(ids[-1])]
                parts.append(repaired)
                words[-1], ids[-1] = middle, repaired
                more = []
            if not chunk.n_words:
                open_end = False
                continue
            rest, last, last_ids = chunk.ids, chunk.last, chunk.last_ids
            if goes_on:
                rest = rest[len(chunk.first_ids[0]) :]
                if chunk.n_words <= OUTER:
                    last, last_ids = last[1:], last_ids[1:]
            if rest:
                parts.append(rest)
            words, ids = (words + last)[-OUTER:], (ids + last_ids)[-OUTER:]
            open_end = not chunk.blank_last
        return b"".join(parts)

    def join(self, words: list[bytes], ids: list[bytes], middle: bytes, chunk: Chunk) -> bytes | None:
        """The ids of the word that goes over a join, from a window that agrees with the chunks on
        both sides; None when no window up to ``OUTER`` words does."""
        reach = 1
        while reach < OUTER:
            left, right = b"".join(ids[-reach:]), b"".join(chunk.first_ids[1 : 1 + reach])
            text = b" ".join([*words[-reach:], middle, *chunk.first[1 : 1 + reach]])
            window = self.words.ids(text) if len(text) <= MOST else self.words.ids_of_texts([text])[0]
            if len(window) >= len(left) + len(right) and window.startswith(left) and window.endswith(right):
                return window[len(left) : len(window) - len(right)]
            reach *= 2
        return None


#: What stands after the last chunk.
_NOTHING = Chunk(b"", 0, [], [], [], [], True, True)

_encoders: dict[str, ChunkEncoder] = {}


def _chunk_encoder(shared) -> ChunkEncoder:
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = ChunkEncoder(encoder(shared))
    return _encoders[shared.id]


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decoded: bool = False
) -> DataFrame:
    """Id and ``ids`` (binary: little-endian unsigned 32-bit integers) of every row and, when
    ``decoded``, ``decoded``: the text that the ids give back."""
    shared = shared_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunk_encoder(shared)
        for rows in runs(batches, "_text"):
            ids = chunks.documents(as_bytes(rows.column(1)))
            arrays = [rows.column(0), pa.array(ids, pa.binary())]
            if decoded:
                arrays.append(pa.array([chunks.words.decode(x).decode() for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = [id_col, "ids", "decoded"][: 2 + decoded]
    wanted = docs.select(F.col(f"`{id_col}`"), text_of(text_col).alias("_text"))
    kind = wanted.schema[0].dataType.simpleString()
    return wanted.mapInArrow(run, f"`{id_col}` {kind}, ids binary" + ", decoded string" * decoded)


def decode(rows: DataFrame, ids_col: str = "ids", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """Id and ``decoded`` of every row of ids; null ids give the empty text."""
    shared = shared_file(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(shared)
        for batch in batches:
            texts = [words.decode(x or b"").decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "decoded"])

    wanted = rows.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`"))
    return wanted.mapInArrow(run, f"`{id_col}` {wanted.schema[0].dataType.simpleString()}, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of rows of `encode`, and the columns to keep."""
    return encoded.select(
        F.col(f"`{id_col}`"),
        *(keep or []),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
