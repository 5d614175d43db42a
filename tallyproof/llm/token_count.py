"""Token counts by the whole-token shortcut.

Before any text is read, every string of the vocabulary that stands for a whole pre-token is encoded by
itself; those that come out as one token are the proven ones. In a text, a pre-token that is proven counts
1 by a set lookup, and only the rest is merged, by the library, and remembered.

Pre-tokens are cut by the tokenizer's own pattern. Words with characters outside a range in which
lower-casing and character classes are the same for every Unicode version and never change under
composition, or with a special token's string, are left to the library whole.

Defined cases: a null text counts as empty; an empty text has no tokens; equal rows count alike; an empty
table gives an empty table; only the id and the text are read from the table, so other columns never clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm import bpe
from tallyproof.llm.common import GAP, as_bytes, runs, text_of

def whole_tokens(file_text: str) -> set[str]:
    """The pre-tokens that are proven to encode alone as one token."""
    tokenizer = bpe.load(file_text)
    model = json.loads(file_text)["model"]
    end = model.get("end_of_word_suffix") or ""
    byte_of = {c: b for b, c in enumerate(bpe.byte_characters())}
    candidates = []
    for token in model["vocab"]:
        body = token.removesuffix(end)
        if token.endswith(end) and all(c in byte_of for c in body):
            try:
                text = bytes(byte_of[c] for c in body).decode()
            except UnicodeDecodeError:  # part of a character
                continue
            if text and bpe.SAFE.fullmatch(text):
                candidates.append(text)
    found = tokenizer.encode_batch_fast(candidates, add_special_tokens=False)
    return {text for text, encoding in zip(candidates, found) if len(encoding.ids) == 1}


class Counter:
    """Counts tokens of texts as the library gives them."""

    def __init__(self, file_text: str, proven: set[str]):
        self.tokenizer = bpe.load(file_text)
        self.proven = proven
        self.pattern, self.last, self.special = bpe.splitting(self.tokenizer, file_text)
        self.merged = bpe.Recent(self._lengths)
        self.of_strange = bpe.Recent(self._whole_lengths)
        self.shortcuts = self.others = 0

    def _whole_lengths(self, texts: list[str]) -> list[int]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [len(encoding.ids) for encoding in found]

    def _lengths(self, pieces: list[str]) -> list[int]:
        """Tokens of pre-tokens: merged many at a time, where the vocabulary marks a pre-token's last
        token, so that each piece's tokens can be told apart."""
        lengths: list[int] = []
        for at in range(0, len(pieces), bpe.TOGETHER):
            some = pieces[at : at + bpe.TOGETHER]
            if self.last is not None:
                ids = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
                ends = np.flatnonzero(self.last[ids])
                if len(ends) == len(some) and ends[-1] == len(ids) - 1:
                    lengths += np.diff(ends, prepend=-1).tolist()
                    continue
            lengths += self._whole_lengths(some)
        return lengths

    def count(self, data: bytes) -> int:
        text = data.decode()
        strange: list[str] = []
        if not bpe.SAFE.fullmatch(text) or self.special.search(text):
            words = re.split(GAP, text)
            strange = [w for w in words if not bpe.SAFE.fullmatch(w) or self.special.search(w)]
            apart = set(strange)
            text = " ".join([w for w in words if w not in apart])
        pieces = self.pattern.findall(text.lower())
        rest = [p for p in pieces if p not in self.proven]
        self.shortcuts += len(pieces) - len(rest)
        self.others += len(rest) + len(strange)
        return len(pieces) - len(rest) + sum(self.merged.of(rest)) + sum(self.of_strange.of(strange))


_counters: dict[str, Counter] = {}


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Id, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row."""
    shared = bpe.shared_file(docs.sparkSession, path)
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(shared.value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.id not in _counters:
            _counters.clear()
            _counters[shared.id] = Counter(shared.value, proven.value)
        counter = _counters[shared.id]
        for rows in runs(batches, "_text"):
            texts = as_bytes(rows.column(1))
            sizes, tokens = [len(t) for t in texts], [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], [id_col, "n_bytes", "n_tokens"]
            )

    wanted = docs.select(F.col(f"`{id_col}`"), text_of(text_col).alias("_text"))
    kind = wanted.schema[0].dataType.simpleString()
    return wanted.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
