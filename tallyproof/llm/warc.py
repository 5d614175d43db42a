"""WARC archives as a table of chunks.

A payload is never held whole outside the row it comes in: Spark cuts it into rows of record and chunk
number, the writing task appends each chunk to the record's gzip member, and the reading task streams
archives back as such rows. Each row that is read carries the bytes and the SHA-1 of its record's payload
so far, so the last row of a record has those of the whole payload, and a record whose digest differs
from its header's stops the job.

Of records with equal payloads of at least ``least_bytes``, that with the largest id is written as a
response and the others as revisits that name it. Equal means equal in SHA-1 and length.

Hot payloads: the groups are aggregated with a combine before the shuffle and joined as a written table,
so Spark can split the rows of a payload that very many records have.

Defined cases: a null payload counts as empty; null ids are written without an id, count as smaller than
any other, and in a group of null ids only, every record is a response; rows with the same, largest id
and the same payload are all responses; an empty table gives no archives and an empty table; only the
id, the payload and the URL, if there is one, are read from the table, so other columns never clash.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.files import new_folder, open_to_read, open_to_write, own_name, qualified
from tallyproof.session import stored

CHUNK_BYTES = 64 << 10
LEAST_BYTES = 1000
#: A new archive is begun after so many compressed bytes.
ARCHIVE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
_LEVEL = 4
_HEADER_BYTES = 1 << 20


def decide(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None, least_bytes: int) -> DataFrame:
    """Each page with its payload, the payload's digest and length, and ``refers_to`` for revisits."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit("").cast("binary"))
    url = F.col(f"`{url_col}`").cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), url.alias("url"), payload.alias("payload"))
    digest, size = F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size")
    large = rows.filter(F.octet_length("payload") >= least_bytes).select("id", digest, size)
    repeated = large.groupBy("digest", "size").agg(F.max("id").alias("largest"), F.count("*").alias("n"))
    repeated = stored(repeated.filter("n > 1 and largest is not null").drop("n"), "repeated")
    revisit = ~F.col("id").eqNullSafe(F.col("largest")) & F.col("largest").isNotNull()
    return rows.select("*", digest, size).join(repeated, ["digest", "size"], "left").select(
        "id", "url", "payload", "digest", "size", F.when(revisit, F.col("largest")).alias("refers_to")
    )


def chunked(decided: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of a record's payload, in order; one without bytes for a revisit."""
    payload = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit("").cast("binary"))
    rows = decided.withColumn("payload", payload)
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("payload") / chunk_bytes) - 1).cast("int")
    cut = rows.select("*", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return cut.select(
        F.col("id").cast("string").alias("id"),
        "url",
        "digest",
        "size",
        F.col("refers_to").cast("string").alias("refers_to"),
        "chunk_no",
        (F.col("chunk_no") == F.col("last")).alias("is_last"),
        F.substring(F.col("payload"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"),
    )


def _record_id(page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _base32(digest: str) -> str:
    import base64

    return base64.b32encode(bytes.fromhex(digest)).decode()


def _head(row: dict, place: str) -> bytes:
    """The header of a record and, for a response, that of its HTTP message."""
    revisit = row["refers_to"] is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["size"]
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(place if row["id"] is None else row["id"])),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (row["url"] or f"urn:page:{row['id']}").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{_base32(row['digest'])}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else row["size"]))),
        ("X-Payload-Length", str(row["size"])),
    ]
    if row["id"] is not None:
        fields.append(("X-Page-Id", row["id"]))
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(row["refers_to"])),
            ("X-Refers-To-Page", row["refers_to"]),
        ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + http


def write(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of `chunked` rows to archives in ``folder``; ``(path, records, bytes)`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records, done, member = None, "", 0, [], None
        for batch in batches:
            heads = batch.drop_columns(["chunk"]).to_pylist()
            for row, chunk in zip(heads, batch.column("chunk")):
                if row["chunk_no"] == 0:
                    if out is not None and out.tell() >= archive_bytes:
                        done.append((path, records, out.tell()))
                        out.close()
                        out, records = None, 0
                    if out is None:
                        path = own_name(folder, "warc.gz")
                        out = open_to_write(path)
                    member = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                    out.write(member.compress(_head(row, f"{path}#{records}")))
                out.write(member.compress(chunk.as_buffer()))
                if row["is_last"]:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    records += 1
        if out is not None:
            done.append((path, records, out.tell()))
            out.close()
        columns = list(zip(*done)) or [[], [], []]
        kinds = [pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "records", "bytes"]
        )

    return chunks.mapInArrow(run, "path string, records long, bytes long")


def _fields(stream: io.BufferedIOBase) -> dict[str, str]:
    """The named fields up to the next empty line."""
    fields, total = {}, 0
    while (line := stream.readline(_HEADER_BYTES)) not in (b"\r\n", b""):
        total += len(line)
        if total > _HEADER_BYTES:
            raise ValueError("a record's header is too long")
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def records(stream: io.BufferedIOBase, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """The records of an archive as chunks, each with the bytes and the digest so far."""
    number = 0
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"record {number} begins with {version[:20]!r}")
        fields = _fields(stream)
        left = int(fields["content-length"])
        http = 0
        while True:  # of the HTTP message
            line = stream.readline(_HEADER_BYTES)
            http += len(line)
            if line in (b"\r\n", b""):
                break
        left -= http
        revisit = fields["warc-type"] == "revisit"
        digest, size, chunk_no = hashlib.sha1(usedforsecurity=False), 0, 0
        want = fields["warc-payload-digest"].partition(":")[2]
        while True:
            data = stream.read(min(chunk_bytes, left))
            if len(data) < min(chunk_bytes, left):
                raise ValueError(f"record {number} is cut off")
            digest.update(data)
            size += len(data)
            left -= len(data)
            if not left and not revisit and _base32(digest.hexdigest()) != want:
                raise ValueError(f"record {number} differs from its digest")
            yield {
                "record_no": number,
                "page_id": fields.get("x-page-id"),
                "record_type": fields["warc-type"],
                "refers_to": fields.get("x-refers-to-page"),
                "header_bytes": int(fields["x-payload-length"]),
                "header_digest": want,
                "chunk_no": chunk_no,
                "chunk": data,
                "bytes_so_far": size,
                "digest_so_far": digest.hexdigest(),
                "is_last": not left,
            }
            chunk_no += 1
            if not left:
                break
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {number} does not end where it should")
        number += 1


_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("record_no", pa.int64()),
        ("page_id", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.string()),
        ("header_bytes", pa.int64()),
        ("header_digest", pa.string()),
        ("chunk_no", pa.int64()),
        ("chunk", pa.binary()),
        ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.string()),
        ("is_last", pa.bool_()),
    ]
)


def read(archives: DataFrame, with_chunks: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of all archives in ``archives(path)``; without chunks, only the last row of each
    record and no bytes. Archives are read one per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with open_to_read(path) as file, gzip.GzipFile(fileobj=file) as member:
                    for row in records(io.BufferedReader(member, 1 << 18), chunk_bytes):
                        if not with_chunks:
                            if not row["is_last"]:
                                continue
                            row["chunk"] = None
                        rows.append({"path": path, **row})
                        held += 300 + len(row["chunk"] or b"")
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    paths = archives.select("path")
    schema = (
        "path string, record_no long, page_id string, record_type string, refers_to string, header_bytes long, "
        "header_digest string, chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, is_last boolean"
    )
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(run, schema)


def archive(
    pages: DataFrame,
    id_col: str = "page_id",
    payload_col: str = "html",
    url_col: str | None = "url",
    least_bytes: int = LEAST_BYTES,
    folder: str | None = None,
) -> DataFrame:
    """Write every row of ``pages`` as a record; the written list of archives. ``folder`` is where they
    go: by default one of the shared folder that goes when the application ends."""
    spark = pages.sparkSession
    folder = qualified(spark, folder) if folder else new_folder(spark, "warc")
    decided = decide(pages, id_col, payload_col, url_col, least_bytes)
    return stored(write(chunked(decided), folder), "archives")


def summary(rows: DataFrame, id_type: str) -> DataFrame:
    """One row per record from its last chunk row: a response's bytes and digest are those of what was
    read, a revisit's are its header's."""
    response = F.col("record_type") == "response"
    return rows.filter("is_last").select(
        F.col("page_id").cast(id_type).alias("page_id"),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("header_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(_hex_of_base32(F.col("header_digest"))).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"),
    )


def _hex_of_base32(text):
    """32 base-32 digits as 40 hexadecimal ones: eight digits are 40 bits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    plain = F.translate(text, alphabet, "0123456789abcdefghijklmnopqrstuv")
    parts = [F.lpad(F.lower(F.conv(F.substring(plain, 1 + 8 * i, 8), 32, 16)), 10, "0") for i in range(4)]
    return F.concat(*parts)
