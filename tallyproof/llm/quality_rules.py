"""Line-first cleaning: rules per line, failing lines removed, documents that lose too much rejected.

Every line with a word is tested by itself. A line fails when it is

- **navigation**: a menu, that is separators between many of its words;
- **symbols**: many of ``#*$%&|<>{}~^\\`` among its visible characters;
- **shouting**: most of its letters are capitals, or exclamation marks follow many of its words;
- **repetition**: a long line of very few different words;
- **unpunctuated**: a long line without any punctuation of its script, where that has any;
- **boilerplate**: a short line that at least ``hot_share`` of the documents have, or one with a whole
  phrase of scripts, cookie notices or licences.

For the first sign all documents are read before any is judged: short lines, lower-cased and with all
digits alike, are counted by their hash. Documents that have their longest line in common count once, so
copies of a text make none of its lines boilerplate. Only pairs of hashes move; the hashes of lines that
pass the bound, which are no more than the short lines of a document over ``hot_share``, are handed to the
tasks.

Lines without a word never fail. A document is rejected when the failing lines held more than
``max_lost`` of its words, when it has fewer than ``min_words`` words, or when more than
``max_repeated`` of its words lie in three-word windows that occur at least twice.

Defined cases: a null text counts as empty; an empty text has no words and is rejected; equal rows
are judged alike, each on its own; an empty table gives an empty table; other columns are carried.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import BLANKS, as_bytes, runs, text_of
from tallyproof.session import stored

SYMBOLS = b"#*$%&|<>{}~^\\"
COUNTED_SYMBOLS = b"#*$%&|<>"
SEPARATORS = re.compile(r"[|»›•·]|(?<!\S)[>/](?!\S)")
#: The marks that end or part sentences, in the scripts of the basic plane.
PUNCTUATION = re.compile(
    r"[.,;:!?…\u037E\u0387\u055C-\u055E\u0589\u05C3\u060C\u061B\u061D-\u061F\u06D4\u0700-\u070A\u070C"
    r"\u07F8\u07F9\u0830-\u083E\u085E\u0964\u0965\u0E5A\u0E5B\u0F08\u0F0D-\u0F12\u104A\u104B\u1361-\u1368"
    r"\u166E\u16EB-\u16ED\u1735\u1736\u17D4-\u17D6\u17DA\u1802-\u1805\u1808\u1809\u1944\u1945\u1AA8-\u1AAB"
    r"\u1B5A\u1B5B\u1B5D-\u1B5F\u1C3B-\u1C3F\u1C7E\u1C7F\u203C\u203D\u2047-\u2049\u2E2E\u2E3C\u2E41\u3001\u3002"
    r"\uA4FE\uA4FF\uA60D-\uA60F\uA6F3-\uA6F7\uA876\uA877\uA8CE\uA8CF\uA92F\uA9C7-\uA9C9\uAA5D-\uAA5F\uAADF"
    r"\uAAF0\uAAF1\uABEB\uFE10-\uFE16\uFE50-\uFE52\uFE54-\uFE57\uFF01\uFF0C\uFF0E\uFF1A\uFF1B\uFF1F\uFF61\uFF64]"
)
#: Letters of Thai and Lao, which part sentences by blanks.
UNMARKED = re.compile(r"[\u0E01-\u0E2E\u0E81-\u0EAE]")
#: Phrases of notices, as whole words.
BOILERPLATE = re.compile(
    rb"\b(?:enable javascript|javascript is (?:disabled|required)|requires javascript|cookie (?:policy|settings|notice|consent)"
    rb"|(?:accept|uses?|using) cookies|lorem ipsum|all rights reserved|terms of use|terms of service|privacy policy|subscribe to"
    rb"|sign up for|log in to|skip to content|powered by|licensed under|spdx-license)\b"
)
BLANK_BYTES = BLANKS.encode()
_ALIKE = bytes(0x30 if 0x30 <= b <= 0x39 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
CAPITALS, LETTERS = string.ascii_uppercase.encode(), string.ascii_letters.encode()


@dataclass(frozen=True)
class Rules:
    """Bounds of the line rules and of the verdict; shares are fractions of 1."""

    min_words: int = 50
    max_repeated: float = 0.5
    max_lost: float = 0.3
    symbols: float = 0.1
    capitals: float = 0.7
    exclamations: float = 0.25
    separators: float = 0.2
    long_line: int = 20
    different: float = 0.2
    boilerplate_words: int = 40
    hot_share: float = 0.02
    hot_documents: int = 20


def occurrences(line: bytes, of: bytes) -> int:
    """How many bytes of ``line`` are among ``of``."""
    return len(line) - len(line.translate(None, of))


def mostly_capitals(line: bytes, share: float) -> bool:
    letters, capitals = occurrences(line, LETTERS), occurrences(line, CAPITALS)
    if 2 * letters < len(line) and not line.isascii():  # another alphabet
        text = line.decode()
        letters, capitals = sum(map(str.isalpha, text)), sum(map(str.isupper, text))
    return letters >= 20 and capitals > share * letters


def line_hash(words: list[bytes]) -> int:
    """A signed hash of a line's words, A-Z lowered and digits alike."""
    value = xxhash.xxh64_intdigest(b" ".join(words).translate(_ALIKE))
    return value - (1 << 64) if value >> 63 else value


def hot_lines(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> frozenset[int]:
    """The hashes of short lines that are boilerplate by the number of documents that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "_text"):
            lines: list[int | None] = []
            marks: list[int] = []
            for text in as_bytes(batch.column(0)):
                filled = [w for w in map(bytes.split, text.split(b"\n")) if w]
                if filled:
                    mark = line_hash(min(filled, key=_longest_first))
                    short = {line_hash(w) for w in filled if len(w) <= rules.boilerplate_words}
                    lines += [None, *short]
                    marks += [mark] * (1 + len(short))
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array(marks, pa.int64())], ["line", "mark"])

    pairs = docs.select(text_of(text_col).alias("_text")).mapInArrow(run, "line long, mark long").distinct()
    counts = pairs.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= rules.hot_documents)
    counts = stored(counts, "hot-lines")
    whole = counts.filter(F.col("line").isNull()).first()
    if whole is None:
        return frozenset()
    hot = counts.filter(F.col("line").isNotNull() & (F.col("n") >= rules.hot_share * whole.n)).select("line").toArrow()
    return frozenset(hot.column("line").to_pylist())


def _longest_first(words: list[bytes]) -> tuple[int, bytes]:
    line = b" ".join(words).translate(_ALIKE)
    return -len(line), line


def failing_rule(line: bytes, words: list[bytes], rules: Rules, hot: frozenset[int] = frozenset()) -> str | None:
    """The first rule that a line with a word fails."""
    n_words = len(words)
    if not line.isascii() or occurrences(line, b"|>/") > 2:
        if len(SEPARATORS.findall(line.decode())) >= max(3, rules.separators * n_words):
            return "navigation"
    if occurrences(line, SYMBOLS) > max(4, rules.symbols * (len(line) - occurrences(line, BLANK_BYTES))):
        return "symbols"
    if line.count(b"!") > max(3, rules.exclamations * n_words):
        return "shouting"
    if n_words > 3 and mostly_capitals(line, rules.capitals):
        return "shouting"
    if n_words >= rules.long_line:
        if len(set(words)) < rules.different * n_words:
            return "repetition"
        if not (PUNCTUATION.search(text := line.decode()) or UNMARKED.search(text)):
            return "unpunctuated"
    if n_words <= rules.boilerplate_words and (BOILERPLATE.search(line.lower()) or hot and line_hash(words) in hot):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    pairs = codes[:-1] * len(known) + codes[1:]
    if len(known) > 2_000_000:  # keep the next product within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(known) + codes[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    equal = ordered[1:] == ordered[:-1]
    again = np.zeros(len(windows), dtype=bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    if not again.any():
        return 0
    covered = np.zeros(len(words), dtype=bool)
    for step in range(3):
        covered[step : step + len(again)] |= again
    return int(covered.sum())


def judge(text: bytes, rules: Rules = Rules(), hot: frozenset[int] = frozenset()) -> dict:
    """Counts, verdict and cleaned text of one document, given in UTF-8."""
    words, kept_lines, seen, lost, n_dup, failed = [], [], set(), 0, 0, 0
    for line in text.split(b"\n"):
        if line_words := line.split():
            words += line_words
            n_dup += line in seen
            seen.add(line)
            if failing_rule(line, line_words, rules, hot):
                lost += len(line_words)
                failed += 1
                continue
        kept_lines.append(line)
    repeats = repeated_words(words)
    base = len(words) < rules.min_words or 100 * repeats > 100 * rules.max_repeated * len(words)
    return {
        "n_words": len(words),
        "word_chars": len(text.decode()) - occurrences(text, BLANK_BYTES),
        "n_symbols": occurrences(text, COUNTED_SYMBOLS),
        "n_dup_lines": n_dup,
        "n_repeat_words": repeats,
        "base_failed": base,
        "kept": not base and lost <= rules.max_lost * len(words),
        "lost_words": lost,
        "failed_lines": failed,
        "clean_text": text if not failed else b"\n".join(kept_lines),
    }


COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, lost_words long, failed_lines long"
)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Counts and verdict of every row, with its id; no text leaves the task."""
    hot = hot_lines(docs, text_col, rules)
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "_text"):
            rows = [judge(t, rules, hot) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[n] for r in rows], kinds[n]) for n in names]], [id_col, *names]
            )

    kinds = {n: pa.bool_() if n in ("base_failed", "kept") else pa.int64() for n in names}
    wanted = docs.select(F.col(f"`{id_col}`"), text_of(text_col).alias("_text"))
    kind = wanted.schema[0].dataType.simpleString()
    return wanted.mapInArrow(run, f"`{id_col}` {kind}, {COUNTS}")


def clean(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", rules: Rules = Rules()) -> DataFrame:
    """The rows that pass, with failing lines removed from their text and all columns of ``docs``.
    ``length_col``, where the table has it, is set to the code points of the new text."""
    schema, hot = docs.schema, hot_lines(docs, text_col, rules)
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, text_col):
            rows = [judge(t, rules, hot) for t in as_bytes(batch.column(at))]
            arrays, texts = list(batch.columns), [r["clean_text"].decode() for r in rows]
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            if length_at is not None:
                arrays[length_at] = pa.array(list(map(len, texts)), pa.int64()).cast(batch.schema.field(length_at).type)
            whole = pa.RecordBatch.from_arrays(arrays, batch.schema.names)
            yield whole.filter(pa.array([r["kept"] for r in rows], pa.bool_()))

    return docs.mapInArrow(run, schema)
