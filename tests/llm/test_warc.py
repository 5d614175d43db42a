"""WARC archives against SQL, round trips, damage, and the defined edge cases."""

import gzip
import hashlib
import io
import re

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from tallyproof.llm import queries, warc
from tallyproof.llm.registry import ORACLES

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    assert difference(queries.op3_warc(spark, SF), connect(SF), ORACLES["op3_warc"]) is None


LONG = "<p>é</p>" * 40_000
ROWS = [
    (1, "u", None),
    (2, "u", ""),
    (3, None, "short"),
    (4, "a\r\nX: b", "short"),
    (5, "u", "x" * 1000),
    (6, "u", "x" * 1000),
    (7, "u", "x" * 999),
    (8, "u", "x" * 999),
    (None, "u", "x" * 1000),
    (None, "u", "y" * 2000),
    (None, "u", "y" * 2000),
    (9, "u", LONG),
    (10, "u", "WARC/1.1\r\n\r\n\r\n" * 200),
    (11, "u", "z" * 1500),
    (11, "u", "z" * 1500),
]


def pages_of(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    return pages.withColumns({c: F.lit("clash") for c in ("digest", "size", "payload", "chunk", "refers_to", "id")})


def test_round_trip_and_edges(spark, tmp_path):
    pages = pages_of(spark)
    archives = warc.archive(pages, folder=str(tmp_path / "archives"))
    assert archives.agg(F.sum("records")).first()[0] == len(ROWS)
    rows = warc.read(archives, chunk_bytes=1000).collect()
    texts = {}
    for r in sorted(rows, key=lambda r: (r.path, r.record_no, r.chunk_no)):
        texts[r.path, r.record_no] = texts.get((r.path, r.record_no), b"") + r.chunk
        so_far = texts[r.path, r.record_no]
        assert (r.bytes_so_far, r.digest_so_far) == (len(so_far), hashlib.sha1(so_far).hexdigest())
        assert len(r.chunk) <= 1000
    found = sorted(
        [(r.page_id, r.refers_to, texts[r.path, r.record_no].decode()) for r in rows if r.is_last], key=repr
    )
    want = []
    for ident, _, html in ROWS:
        refers = "6" if html == "x" * 1000 and ident != 6 else None
        want.append((None if ident is None else str(ident), refers, "" if refers else html or ""))
    assert found == sorted(want, key=repr)
    for path in tmp_path.glob("archives/*.warc.gz"):  # as any reader of the format sees them
        data = gzip.decompress(path.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            length = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: re") and rest[length : length + 4] == b"\r\n\r\n"
            data = rest[length + 4 :]


def test_summary(spark):
    pages = pages_of(spark)
    rows = warc.summary(warc.read(warc.archive(pages), with_chunks=False), "bigint").collect()
    want = []
    for ident, _, html in ROWS:
        payload = (html or "").encode()
        refers = 6 if html == "x" * 1000 and ident != 6 else None
        kind = "response" if refers is None else "revisit"
        want.append((ident, len(payload), hashlib.sha1(payload).hexdigest(), kind, refers))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    pages = pages_of(spark).limit(0)
    assert warc.summary(warc.read(warc.archive(pages)), "bigint").count() == 0


def test_archives_roll_over(spark):
    decided = warc.decide(pages_of(spark).coalesce(1), "page_id", "html", "url", 1000)
    folder = warc.new_folder(spark, "rolling")
    archives = warc.stored(warc.write(warc.chunked(decided), folder, archive_bytes=1), "archives")
    assert archives.count() == len(ROWS) == warc.read(archives, with_chunks=False).count()


@pytest.mark.parametrize("damage", ["flip", "cut"])
def test_damage_is_found(damage):
    head = {"id": "1", "url": "u", "digest": hashlib.sha1(b"payload").hexdigest(), "size": 7, "refers_to": None}
    record = warc._head(head, "") + b"payload\r\n\r\n"
    assert [r["chunk"] for r in warc.records(io.BytesIO(record), 4)] == [b"payl", b"oad"]
    broken = record.replace(b"payload\r", b"paylaod\r") if damage == "flip" else record[:-6]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(broken)))
