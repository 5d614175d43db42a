"""Token files: coder round trips, damage, the query against the library, and the defined edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyproof.llm import bpe, queries, rans, token_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    with open(bpe.default_path(), encoding="utf-8") as file:
        return bpe.load(file.read())


def expected(tokenizer, rows):
    """(doc_id, start, n, crc) of (doc_id, text) rows in order."""
    result, start = [], 0
    for ident, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        result.append((ident, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return result


def skewed(n, size=300, seed=0):
    return np.minimum(np.random.default_rng(seed).zipf(1.3, n) - 1, size - 1).astype(np.uint32)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 129, 5000, 70_000, rans.LANES * rans.STEPS_PER_CHECKPOINT * 2 + 77])
def test_blocks_round_trip(n):
    ids = skewed(n)
    table = rans.Table.of_counts(np.bincount(skewed(20_000, seed=1), minlength=300))
    assert table.freq.sum() == 1 << rans.BITS and table.freq.min() >= 1
    assert (rans.Table.from_bytes(table.to_bytes()).freq == table.freq).all()
    block = rans.encode(ids, table)
    assert (rans.decode(block, table) == ids).all()
    piece = rans.LANES * rans.STEPS_PER_CHECKPOINT
    if n > piece:  # from any checkpoint to any other
        assert (rans.decode(block, table, 1) == ids[piece:]).all()
        assert (rans.decode(block, table, 0, 1) == ids[:piece]).all()
        assert (rans.decode(block, table, 1, 2) == ids[piece : 2 * piece]).all()


def test_blocks_are_small():
    ids = skewed(200_000)
    counts = np.bincount(ids, minlength=300)
    p = counts[counts > 0] / len(ids)
    states = 8 * rans.LANES * 2  # at the begin and at one checkpoint
    entropy = len(ids) * -(p * np.log2(p)).sum() / 8
    assert len(rans.encode(ids, rans.Table.of_counts(counts))) < 1.01 * entropy + states + 100


def test_damage_is_found():
    table = rans.Table.of_counts(np.ones(300))
    block = bytearray(rans.encode(skewed(1000), table))
    block[len(block) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(block), table)


def test_query(spark, tokenizer):
    docs = queries.table(spark, SF, "documents").orderBy("doc_id").collect()
    rows = queries.op6_token_file(spark, SF).collect()
    assert sorted(map(tuple, rows)) == expected(tokenizer, [(r.doc_id, r.text) for r in docs])


def test_edges(spark, tokenizer, tmp_path, monkeypatch):
    rows = [(5, None), (-3, ""), (None, "last"), (7, "word " * 5000), (6, "a b"), (6, "a b"), (2**40, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("doc", "ids", "part", "path", "start")})
    ordered = [rows[i] for i in (1, 0, 4, 5, 3, 6, 2)]
    files = token_file.write(docs, folder=str(tmp_path / "files"))
    found = token_file.read(files, with_ids=True).orderBy("start").collect()
    assert [tuple(r)[:4] for r in found] == expected(tokenizer, ordered)
    for r, (_, text) in zip(found, ordered):
        assert np.frombuffer(r.ids, "<u4").tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    assert token_file.read(token_file.write(docs.limit(0))).count() == 0


def test_documents_longer_than_a_block(tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_IDS", 100)
    monkeypatch.setattr(token_file, "GROUP_IDS", 250)
    table = rans.Table.of_counts(np.ones(300))
    docs = [(i, skewed(n, seed=i)) for i, n in enumerate([1, 99, 100, 450, 7, 200, 3])]
    path = str(tmp_path / "one.rns")
    with open(path, "wb") as out:
        writer = token_file.GroupWriter(out, path, table)
        for doc, ids in docs:
            writer.add(doc, ids)
        writer.end_group()
    assert len(writer.groups) > 1 and sum(g["ids"] for g in writer.groups) == 860
    found: dict[int, list] = {}
    for g in writer.groups:
        begins = True
        for pieces, block in token_file._blocks(f"file://{path}", g["offset"], g["bytes"]):
            ids, at = rans.decode(block, table), 0
            assert len(ids) <= 100
            for doc, size, _, _ in pieces.tolist():
                assert not begins or doc not in found
                begins = False
                found.setdefault(doc, []).extend(ids[at : at + size].tolist())
                at += size
    assert found == {d: ids.tolist() for d, ids in docs}
