"""Token ids in files: static rANS blocks with one shared frequency table.

`write` encodes every text, appends the end id, counts all ids for the table that all blocks share,
sorts the documents by id across the cluster and lets each task write one file of its range. `read`
decodes groups of blocks in any number of tasks.

**Format.** A folder holds ``table.rns`` (the compressed frequencies) and files of groups. A group is a
run of blocks that begins with a document's first id; it is found by path and offset in the index, one
row per group, and needs nothing before it to be read. A block is a length, a table of its pieces of
documents (id, ids in this block, whether it ends here), and the coded ids (`rans`), with checkpoints and
checksums. A document longer than a block goes over several blocks of its group, and is never held whole
by the reader.

Places are sums in two levels: over files in the driver's sort order, one row per file, and over the
groups within a file.

Defined cases: a null text counts as empty and has the end id alone; null ids come last; rows with equal
ids come in the order of a hash of their ids; an empty table gives no files and an empty table; document
ids are integers; only the id and the text are read from the table, so other columns never clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.llm import rans
from tallyproof.llm.bpe import encoder, shared_file
from tallyproof.llm.common import as_bytes, runs, text_of
from tallyproof.llm.files import new_folder, open_to_read, open_to_write, own_name, qualified
from tallyproof.session import delete_path, stored

BLOCK_IDS = 1 << 18
GROUP_IDS = 1 << 20
#: Texts of so many bytes are cut into pre-tokens together: the larger the run, the fewer are looked up.
RUN_BYTES = 4 << 20
END_ID = 2
_PIECE = np.dtype([("doc", "<i8"), ("ids", "<u4"), ("has_id", "u1"), ("ends", "u1")])
_FRAME = struct.Struct("<III")  # bytes of the pieces, bytes of the block, checksum of the pieces


@dataclass
class TokenFiles:
    """What `write` made: the folder, and ``index(part, number, path, offset, bytes, docs, ids)``."""

    folder: str
    index: DataFrame


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str | None, end_id: int) -> DataFrame:
    """``doc`` and ``ids`` (binary: little-endian, two bytes each where the vocabulary allows)."""
    shared = shared_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(shared)
        width = _width(len(words.tokens))
        end = np.array([end_id], width).tobytes()
        for rows in runs(batches, "_text", RUN_BYTES):
            ids = words.ids_of_texts(as_bytes(rows.column(1)))
            found = [np.frombuffer(x, "<u4").astype(width).tobytes() + end for x in ids]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.binary())], ["doc", "ids"])

    wanted = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text_of(text_col).alias("_text"))
    return wanted.mapInArrow(run, "doc long, ids binary")


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs: summed in each task, then by id; one row per id comes back."""
    width = _width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            joined = b"".join(batch.column("ids").to_pylist())
            total += np.bincount(np.frombuffer(joined, width), minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, dtype=np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


class GroupWriter:
    """Appends documents to a file and notes its groups."""

    def __init__(self, out, path: str, table: rans.Table):
        self.out, self.path, self.table = out, path, table
        self.groups: list[dict] = []
        self._new_group()

    def _new_group(self) -> None:
        self.offset, self.docs, self.ids = self.out.tell(), 0, 0
        self._new_block()

    def _new_block(self) -> None:
        self.pieces: list[tuple] = []
        self.parts: list[np.ndarray] = []
        self.filled = 0

    def _flush(self) -> None:
        if not self.pieces:
            return
        pieces = zlib.compress(np.array(self.pieces, _PIECE).tobytes(), 1)
        block = rans.encode(np.concatenate(self.parts), self.table)
        self.out.write(_FRAME.pack(len(pieces), len(block), zlib.crc32(pieces)))
        self.out.write(pieces)
        self.out.write(block)
        self._new_block()

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            part = ids[at : at + BLOCK_IDS - self.filled]
            at += len(part)
            self.pieces.append((doc or 0, len(part), doc is not None, at == len(ids)))
            self.parts.append(part)
            self.filled += len(part)
            if self.filled == BLOCK_IDS:
                self._flush()
        self.docs += 1
        self.ids += len(ids)
        if self.ids >= GROUP_IDS:
            self.end_group()

    def end_group(self) -> None:
        self._flush()
        if self.docs:
            size = self.out.tell() - self.offset
            self.groups.append(
                {"number": len(self.groups), "path": self.path, "offset": self.offset, "bytes": size, "docs": self.docs, "ids": self.ids}
            )
            self._new_group()


_INDEX = "part long, number long, path string, offset long, bytes long, docs long, ids long"


def write(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    end_id: int = END_ID,
    folder: str | None = None,
) -> TokenFiles:
    """Encode and write all documents in ascending order of id. ``folder`` is where the files go: by
    default one of the shared folder that goes when the application ends."""
    spark = docs.sparkSession
    folder = qualified(spark, folder) if folder else new_folder(spark, "tokens")
    vocabulary = len(encoder(shared_file(spark, path)).tokens)
    made: list[str] = []
    tokens = stored(encoded(docs, id_col, text_col, path, end_id), "token-ids", made)
    table = rans.Table.of_counts(_counts(tokens, vocabulary))
    with open_to_write(f"{folder}/table.rns") as out:
        out.write(table.to_bytes())
    shared = spark.sparkContext.broadcast(table.to_bytes())
    width = _width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, writer = own_name(folder, "rns"), None
        for batch in batches:
            for doc, ids in zip(batch.column("doc").to_pylist(), batch.column("ids")):
                if writer is None:
                    writer = GroupWriter(open_to_write(name), name, rans.Table.from_bytes(shared.value))
                writer.add(doc, np.frombuffer(ids.as_buffer(), width))
        if writer is not None:
            writer.end_group()
            writer.out.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"part": part, **g} for g in writer.groups])

    ordered = tokens.orderBy(F.col("doc").asc_nulls_last(), F.xxhash64("ids"))
    index = stored(ordered.mapInArrow(run, _INDEX), "token-index")
    for one in made:
        delete_path(spark, one)
    return TokenFiles(folder, index)


def _starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: the ids of all groups before."""
    files = index.groupBy("part").agg(F.sum("ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("_file"))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    groups = index.withColumn("_group", F.coalesce(F.sum("ids").over(within), F.lit(0)))
    return groups.join(files, "part").withColumn("start", F.col("_file") + F.col("_group")).drop("_file", "_group")


def _blocks(path: str, offset: int, size: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """The blocks of a group: pieces, and coded ids."""
    with open_to_read(path) as file:
        file.seek(offset)
        while file.tell() < offset + size:
            n_pieces, n_block, checksum = _FRAME.unpack(file.read(_FRAME.size))
            pieces = file.read(n_pieces)
            if zlib.crc32(pieces) != checksum:
                raise ValueError(f"{path}: pieces at {offset} differ from their checksum")
            yield np.frombuffer(zlib.decompress(pieces), _PIECE), file.read(n_block)


def read(files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids_crc32`` of every
    document, from the files; with ids, also each document's ``ids`` (binary, little-endian unsigned
    32-bit integers), which then are held whole."""
    folder, spark = files.folder, files.index.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            for group in batch.to_pylist():
                if table is None:
                    with open_to_read(f"{folder}/table.rns") as file:
                        table = rans.Table.from_bytes(file.read())
                rows, start, n, crc, whole = [], group["start"], 0, 0, []
                for pieces, block in _blocks(group["path"], group["offset"], group["bytes"]):
                    ids, at = rans.decode(block, table).astype("<u4"), 0
                    for doc, size, has_id, ends in pieces.tolist():
                        part = ids[at : at + size].tobytes()
                        at += size
                        n += size
                        crc = zlib.crc32(part, crc)
                        if with_ids:
                            whole.append(part)
                        if ends:
                            row = (doc if has_id else None, start, n, crc)
                            rows.append((*row, b"".join(whole)) if with_ids else row)
                            start, n, crc, whole = start + n, 0, 0, []
                    if rows:
                        yield _batch(rows, with_ids)
                        rows = []

    def _batch(rows: list[tuple], ids: bool) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.binary()] * ids
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    groups = _starts(files.index)
    tasks = max(1, files.index.count() // 4)  # about four groups each
    groups = groups.repartition(tasks, "path", "number")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return groups.mapInArrow(run, schema)
