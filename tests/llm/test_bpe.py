"""Token counts, chunked encoding and decoding against the tokenizers library."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyproof.llm import bpe, bpe_chunks, queries, token_count

SF = "/root/testdata/sf0.001"
STRANGE = [
    "",
    " \n\t ",
    "  ",
    "<|endoftext|>",
    "a<|startoftext|>b <|endoftext|><|endoftext|>c",
    "İSTANBUL ΑΣ ς don't I'LL'S we''ve",
    "é Å ́x 한국어 한 日本語テキスト",
    "12,345.67 ½ ² x²y ٣ \x1c\x1f\x85z  q",
    "😀👍🏽 ﬁne ŉ ǅ K Å",
    "no" * 20_000,
    "é" * 9_001,
    ("word " * 300 + "\n") * 20,
    "x\x00y",
]


@pytest.fixture(scope="module")
def tokenizer():
    with open(bpe.default_path(), encoding="utf-8") as file:
        return bpe.load(file.read())


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def table_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns(
        {c: F.lit("clash") for c in ("ids", "decoded", "n_tokens", "n_bytes", "_text")}
    )


def test_count_query(spark, tokenizer):
    docs = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    rows = queries.op4_token_counts(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(expected(tokenizer, docs[r.doc_id])[0])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


def test_chunk_query(spark, tokenizer):
    docs = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    rows = queries.op9_bpe_chunks(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids, text = expected(tokenizer, docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_strange_texts(spark, tokenizer):
    docs = table_of(spark, [*STRANGE, None, None])
    counted = {r.doc_id: r.n_tokens for r in token_count.counts(docs).collect()}
    encoded = bpe_chunks.encode(docs, decoded=True)
    again = {r.doc_id: r.decoded for r in bpe_chunks.decode(encoded.select("doc_id", "ids")).collect()}
    for r in encoded.collect():
        ids, text = expected(tokenizer, (STRANGE + [None, None])[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == ids, r.doc_id
        assert counted[r.doc_id] == len(ids), r.doc_id
        assert r.decoded == text == again[r.doc_id]
    assert token_count.counts(docs.limit(0)).count() == bpe_chunks.encode(docs.limit(0)).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "two words"), (None, "two words")], "doc_id long, text string")
    assert [r.n_tokens for r in token_count.counts(docs).collect()] == [2, 2]
    assert len({r.ids for r in bpe_chunks.encode(docs).collect()}) == 1


def test_whole_tokens_are_proven(tokenizer):
    with open(bpe.default_path(), encoding="utf-8") as file:
        proven = token_count.whole_tokens(file.read())
    assert {"the", "!", "of"} <= proven and len(proven) > 10_000
    for text in random.Random(1).sample(sorted(proven), 300):
        assert len(tokenizer.encode(text, add_special_tokens=False).ids) == 1


def test_cuts_follow_the_content():
    rng = random.Random(5)
    shared = " ".join("".join(rng.choices("abcdefé", k=rng.randint(1, 9))) for _ in range(4000)).encode()
    a, b = (bpe_chunks.cut(prefix + shared) for prefix in (b"", b"another beginning, " * 40))
    assert b"".join(a) == shared and len(set(a) & set(b)) > 0.8 * len(a)
    for chunk in a:
        chunk.decode()
        assert len(chunk) <= bpe_chunks.MOST
    assert bpe_chunks.cut(b"") == []


def test_hashes_depend_on_the_window_alone():
    data = np.random.default_rng(1).integers(0, 256, 500, dtype=np.uint8)
    whole, part = bpe_chunks.rolling_hashes(data), bpe_chunks.rolling_hashes(data[100:])
    assert (whole[100 + 31 :] == part[31:]).all()


def test_joins_are_repaired_for_any_cut(tokenizer):
    with open(bpe.default_path(), encoding="utf-8") as file:
        words = bpe.Encoder(file.read())
    text = "Antidisestablishmentarianism isn't  the\nonly unbelievably long word; é́t cetera 日本語 don't".encode()
    for size in (1, 2, 3, 5, 7, 11, 30):
        chunks = bpe_chunks.ChunkEncoder(words)
        pieces = []
        start = 0
        while start < len(text):
            end = min(start + size, len(text))
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
            pieces.append(text[start:end])
            start = end
        original, bpe_chunks.cut = bpe_chunks.cut, lambda _: pieces
        try:
            assert chunks.document(text) == words.ids(text), size
        finally:
            bpe_chunks.cut = original


def test_shared_chunks_are_encoded_once():
    with open(bpe.default_path(), encoding="utf-8") as file:
        chunks = bpe_chunks.ChunkEncoder(bpe.Encoder(file.read()))
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdef", k=6)) for _ in range(3000)).encode()
    chunks.document(text)
    encoded = chunks.encoded
    chunks.document(text)
    assert chunks.encoded == encoded and chunks.reused >= encoded


def test_disagreeing_windows_fall_back_to_the_whole_text(tokenizer, monkeypatch):
    with open(bpe.default_path(), encoding="utf-8") as file:
        words = bpe.Encoder(file.read())
    chunks = bpe_chunks.ChunkEncoder(words)
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdef", k=9)) for _ in range(900)).encode()
    want = chunks.document(text)
    assert want == words.ids(text) and chunks.whole == 0
    monkeypatch.setattr(bpe_chunks.ChunkEncoder, "join", lambda *_: None)
    assert chunks.document(text) == want and chunks.whole == 1


@pytest.fixture(scope="module")
def words():
    with open(bpe.default_path(), encoding="utf-8") as file:
        return bpe.Encoder(file.read())


def test_pre_tokens_by_classes_of_characters(words):
    """Against the library, for any neighbours of letters, numbers, signs, blanks and apostrophes."""
    rng = random.Random(1)
    alphabet = "abst'''''redlvm09 \n\t.,;-!?éÜßªºµ²½§¡×÷Ŀŉſ‐…⁞€\"#AZ'"
    for _ in range(400):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(8)]
        for text, found in zip(texts, words.ids_of_texts([t.encode() for t in texts])):
            assert found == words.ids(text.encode()), text
    assert words.splitter is not None and words.ids_of_texts([]) == []


def test_recurring_pre_tokens_are_merged_once(words):
    """Some 300,000 others stand between, more than were remembered before."""
    made = []
    recent = bpe.Recent(lambda new: made.extend(new) or new, words.pieces.most)
    pieces = [b"%d" % i for i in range(300_000)]
    for at in range(0, len(pieces), 50_000):
        assert recent.of(pieces[at : at + 50_000]) == pieces[at : at + 50_000]
    assert recent.of([*pieces[:50_000], b"0", b"new"]) == [*pieces[:50_000], b"0", b"new"]
    assert len(made) == 300_001 and len(recent.young) + len(recent.old) <= 2 * words.pieces.most


def test_long_texts_are_divided(words, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 50)
    rng = random.Random(2)
    for alphabet in ("abc 1'é,\n", "abcXYZ0189+/", "日本 1é", "x"):
        text = "".join(rng.choices(alphabet, k=900)).encode()
        assert words.ids_of_texts([text, b"and more"]) == [words.ids(text), words.ids(b"and more")]
        assert b"".join(bpe.divided(text)) == text


def long_text(kind, size):
    rng = np.random.default_rng(3)
    if kind == "base64":
        signs = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
        return rng.choice(signs, size).tobytes()
    low, high, width = (0x4E00, 0x9FA5, 3) if kind == "cjk" else (0x61, 0x7B, 1)
    return "".join(map(chr, rng.integers(low, high, size // width))).encode()


@pytest.mark.parametrize("kind", ["base64", "cjk", "letters"])
def test_megabytes_without_blanks_take_seconds(words, kind):
    text = long_text(kind, 5 << 20)
    start = time.process_time()
    want = words.ids(text)
    alone = time.process_time() - start
    chunks = bpe_chunks.ChunkEncoder(words)
    assert chunks.document(text) == want
    assert time.process_time() - start < 6 * alone + 10
