"""A tokenizer inside tasks: loaded once for each worker, with what was encoded before at hand.

The tokenizer's file is read by the driver and broadcast; it has the size of its vocabulary.

Texts of `SAFE` characters are cut into pre-tokens many at a time: classes of characters give the places,
Arrow tells the different pre-tokens apart, and each of those that a worker does not remember is merged by
the library, without its normalizer and pattern, whose work is done. All else the library does itself.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Words, and pre-tokens, in a generation of what a worker remembers; there are two. A run of texts should
#: have fewer different ones.
REMEMBERED, REMEMBERED_PIECES = 120_000, 240_000

#: Pre-tokens that are encoded in one call, and that are merged in one call.
TOGETHER, MERGED = 256, 4096
#: Bytes of a text that are cut into pre-tokens at a time, and where a longer text may be divided.
PART = 4 << 20
APART = re.compile(rb"[\t-\r 0-9]")
#: The pattern and normalizers that `Splitter` follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Blanks, visible ASCII, Latin letters and signs, common punctuation: lower-casing and character classes
#: are the same in every Unicode version, and composition changes nothing. U+0130 lower-cases to two.
SAFE = re.compile(r"[\t-\r -~¡-įı-ſ‐-‧‰-⁞€]*")

#: What is left of a tokenizer that merges pre-tokens only.
_BARE = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "added_tokens": []}

_loaded: dict[str, Encoder] = {}


class SharedFile:
    """A broadcast file and a name by which workers know what they made of it."""

    def __init__(self, broadcast: Broadcast, digest: str):
        self.broadcast, self.id = broadcast, digest

    @property
    def value(self) -> str:
        return self.broadcast.value


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def shared_file(spark: SparkSession, path: str | None) -> SharedFile:
    """The text of a tokenizer's file for all tasks."""
    text = Path(path or default_path()).read_text("utf-8")
    return SharedFile(spark.sparkContext.broadcast(text), hashlib.sha256(text.encode()).hexdigest())


def load(text: str):
    """The tokenizer, with truncation and padding off, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def splitting(tokenizer, text: str) -> tuple[regex.Pattern, np.ndarray | None, re.Pattern]:
    """The pre-tokenizer's pattern; which ids end a pre-token, if the vocabulary marks them; and a
    pattern of the special tokens' strings."""
    spec = json.loads(text)
    steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
    pattern = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
    if pattern is None:
        raise ValueError("the tokenizer does not split by a pattern")
    end = spec["model"].get("end_of_word_suffix")
    tokens = map(tokenizer.id_to_token, range(tokenizer.get_vocab_size(with_added_tokens=True)))
    last = np.array([t is not None and t.endswith(end) for t in tokens]) if end else None
    special = "|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)"
    return regex.compile(pattern), last, re.compile(special)


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: visible Latin-1 characters
    for themselves, the others numbered on from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in visible else next(others)) for b in range(256)]


class Splitter:
    """Cuts texts of `SAFE` characters into the pre-tokens of `PATTERN`, by classes of characters: letters
    stay together, a number stands alone, and so do signs up to the next blank, letter or number; a sign
    run that begins with an apostrophe may be a contraction, which takes its letters with it."""

    BLANK, LETTER, NUMBER, SIGN, UNSAFE = range(5)

    def __init__(self):
        known = [chr(c) for c in range(0x20AD)]
        self.kind = np.array([self._kind(c) for c in known], dtype=np.uint8)
        self.of_byte = bytes(self.kind[:128]) + bytes([self.UNSAFE]) * 128
        # Characters of `SAFE` and their lower case take as many bytes.
        self.lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in known], dtype=np.int32)
        self.short = np.zeros(256, dtype=bool)
        self.short[[ord(c) for c in "stmd"]] = True

    def _kind(self, character: str) -> int:
        if not SAFE.fullmatch(character):
            return self.UNSAFE
        for kind, pattern in ((self.BLANK, r"\s"), (self.LETTER, r"\p{L}"), (self.NUMBER, r"\p{N}")):
            if regex.fullmatch(pattern, character):
                return kind
        return self.SIGN

    def split(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The different pre-tokens; for each place where one stands, which it is; and how many stand
        before each text, and in all."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(lengths + 1) - lengths - 1
        data = bytearray("\n".join(texts).encode()).lower()
        codes = np.frombuffer(data, np.uint8)
        kinds = np.frombuffer(data.translate(self.of_byte), np.uint8)
        inner = self._wide(codes, kinds)
        start = np.empty(len(kinds), dtype=bool)
        start[:1] = True
        np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
        start |= kinds == self.NUMBER
        start[inner] = False
        filled = kinds != self.BLANK
        start &= filled
        self._contract(codes, kinds, start)
        places = np.flatnonzero(start)
        ends = np.cumsum(filled, dtype=np.int32)
        offsets = np.append(ends[places] - 1, ends[-1:] if len(ends) else 0).astype(np.int32)
        plain = pa.py_buffer(bytes(data.translate(None, b"\t\n\x0b\x0c\r ")))
        found = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), plain]).dictionary_encode()
        begins += np.searchsorted(inner - np.arange(len(inner)), begins, "right")  # from characters to bytes
        before = np.append(np.searchsorted(places, begins), len(places))
        return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), before

    def _wide(self, codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Lower-case characters of two bytes, and put the kinds of those of two and three at each of
        their bytes; the places of the bytes after the first."""
        wide = np.flatnonzero(codes >= 0x80)
        if not len(wide):
            return wide
        own = codes[wide]
        first = wide[own >= 0xC0]
        lead, second = codes[first].astype(np.int32), codes[first + 1].astype(np.int32)
        three = lead >= 0xE0
        last = first[three] + 2
        number = (lead & 0x1F) << 6 | second & 0x3F
        number[three] = (lead[three] & 0x0F) << 12 | (second[three] & 0x3F) << 6 | codes[last] & 0x3F
        two, lowered = first[~three], self.lower[number[~three]]
        codes[two], codes[two + 1] = 0xC0 | lowered >> 6, 0x80 | lowered & 0x3F
        kinds[first] = kinds[first + 1] = self.kind[number]
        kinds[last] = self.kind[number[three]]
        return wide[own < 0xC0]

    def _contract(self, codes: np.ndarray, kinds: np.ndarray, start: np.ndarray) -> None:
        at = np.flatnonzero((codes == 39) & start)
        if not len(at):
            return
        follow = [np.where(at + k < len(codes), codes[np.minimum(at + k, len(codes) - 1)], 0) for k in (1, 2)]
        one, two = (x.astype(np.int64) for x in follow)
        e, r, v, ell = (ord(c) for c in "ervl")
        long = ((one == r) | (one == v)) & (two == e) | (one == ell) & (two == ell)
        size = np.where(self.short[one], 2, np.where(long, 3, 0))
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        after = (at + size)[at + size < len(codes)]
        start[after] = kinds[after] != self.BLANK


class Recent:
    """Results of words, of which the recently used stay: words live in two generations, and when the
    young one is full it becomes the old one, which is forgotten."""

    def __init__(self, make: Callable[[list], list], most: int = REMEMBERED):
        self.make, self.most = make, most
        self.young: dict = {}
        self.old: dict = {}

    def of(self, words: list) -> list:
        """The result of each word; those not remembered are made in one call."""
        found = list(map(self.young.get, words))
        places = [at for at, x in enumerate(found) if x is None]
        if places:
            missing = list(dict.fromkeys([words[at] for at in places]))
            if len(self.young) + len(missing) > self.most:
                self.old, self.young = self.young, {}
            results = dict(zip(missing, map(self.old.get, missing)))
            new = [w for w, x in results.items() if x is None]
            if new:
                results.update(zip(new, self.make(new)))
            self.young.update(results)
            for at in places:
                found[at] = results[words[at]]
        return found


def divided(text: bytes) -> Iterator[bytes]:
    """A long text in parts, divided where a blank or a digit stands, which ends a pre-token."""
    start = 0
    while start < len(text):
        cut = APART.search(text, start + PART)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


class Encoder:
    """Encodes texts by their pre-tokens or words. The pre-tokenizer never joins what blanks separate and composition
    never crosses a blank, so the ids of a text are those of its words in order."""

    def __init__(self, text: str):
        self.tokenizer = load(text)
        self.recent, self.pieces = Recent(self._encode), Recent(self._encode_pieces, REMEMBERED_PIECES)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        pattern, self.last, self.special = splitting(self.tokenizer, text)
        spec = json.loads(text)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        byte_level = any(p.get("type") == "ByteLevel" for p in spec["pre_tokenizer"].get("pretokenizers", []))
        known = pattern.pattern == PATTERN and steps == NORMALIZERS and byte_level and self.last is not None
        self.splitter = Splitter() if known else None
        if known:
            self.merger = load(json.dumps({**spec, **_BARE}))
            self.visible = {**dict(enumerate(byte_characters())), 10: " "}
        self.tokens = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]

    def ids(self, text: bytes) -> bytes:
        """The library's ids of a whole text, as little-endian unsigned 32-bit integers."""
        found = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        return np.array(found, dtype="<u4").tobytes()

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of words not met before, from those of their pre-tokens, which many words share."""
        found: list = [None] * len(words)
        texts = [w.decode() for w in words]
        rest = self._from_pieces(texts, found)
        for at, ids in zip(rest, self._one_by_one([texts[at] for at in rest])):
            found[at] = ids
        return found

    def _from_pieces(self, texts: list[str], found: list) -> list[int]:
        """Put the ids of the texts that can be cut here into ``found``; the places of the others."""
        if self.splitter is None:
            return list(range(len(texts)))
        whole = "\n".join(texts)
        if SAFE.fullmatch(whole) and not self.special.search(whole):
            safe = range(len(texts))
        else:
            safe = [at for at, text in enumerate(texts) if SAFE.fullmatch(text) and not self.special.search(text)]
        pieces, which, before = self.splitter.split([texts[at] for at in safe])
        ids = self.pieces.of(pieces)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), "<u4")
        own = sizes[which]
        ends = np.cumsum(own)
        moved = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - own), own)
        raw = flat[np.arange(len(moved)) + moved].tobytes()
        cuts = (4 * np.append(0, ends)[before]).tolist()
        for at, a, b in zip(safe, cuts, cuts[1:]):
            found[at] = raw[a:b]
        return [] if len(safe) == len(texts) else [at for at, x in enumerate(found) if x is None]

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens, many in one call: the vocabulary marks the last token of each."""
        result: list[bytes] = []
        for at in range(0, len(pieces), MERGED):
            some = pieces[at : at + MERGED]
            shown = b"\n".join(some).decode("latin-1").translate(self.visible)
            ids = np.array(self.merger.encode_batch_fast([shown], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, cuts = ids.tobytes(), (4 * ends).tolist()
                result += [raw[x:y] for x, y in zip([0, *cuts], cuts)]
            else:
                result += self._one_by_one([p.decode() for p in some])
        return result

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(encoding.ids, dtype="<u4").tobytes() for encoding in found]

    def ids_of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        return self.recent.of(words)

    def ids_of_texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, from those of its pre-tokens, or else of its words."""
        parts = [[text] if len(text) <= PART else list(divided(text)) for text in texts]
        if len(parts) < sum(map(len, parts)):
            return [b"".join(self._ids_of_long(some)) for some in parts]
        found: list = [None] * len(texts)
        rest = self._from_pieces([text.decode() for text in texts], found)
        words = [texts[at].split() for at in rest]
        ids = self.ids_of_words([w for some in words for w in some])
        ends = np.cumsum([0, *map(len, words)]).tolist()
        for at, a, b in zip(rest, ends, ends[1:]):
            found[at] = b"".join(ids[a:b])
        return found

    def _ids_of_long(self, parts: list[bytes]) -> list[bytes]:
        """The ids of the parts of a text, which is divided where pre-tokens are apart."""
        found: list = []
        for part in parts:
            one: list = [None]
            if self._from_pieces([part.decode()], one):
                return self.ids_of_words(b"".join(parts).split())
            found += one
        return found

    def decode(self, ids: bytes) -> bytes:
        """What the library's ``decode(ids, skip_special_tokens=False)`` gives for a tokenizer
        without a decoder: the tokens, joined by spaces."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(shared: SharedFile) -> Encoder:
    """This worker's encoder for a broadcast file."""
    if shared.id not in _loaded:
        _loaded.clear()
        _loaded[shared.id] = Encoder(shared.value)
    return _loaded[shared.id]
