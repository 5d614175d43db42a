"""A static range asymmetric numeral system over blocks of token ids, in numpy.

A block's ids are dealt over lanes, id ``i`` to lane ``i % lanes``, each with a 64-bit state of its own;
one numpy step codes an id in every lane. Lanes share one frequency table, whose entries add up to
``2**BITS``, and interleave their 32-bit words in one stream. Checkpoints within a block keep all states
and the place in the stream, so that decoding can begin at any of them. Checksums cover the stored bytes
and the decoded ids.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

BITS = 18
LOW = 31  # states are at least 2**LOW between steps
LANES = 1024
STEPS_PER_CHECKPOINT = 128
_HEAD = struct.Struct("<4sIIHHI")  # magic, ids, words, lanes, checkpoints, checksum of the ids
MAGIC = b"RNS1"


@dataclass(frozen=True)
class Table:
    """Frequencies of the ids and what is made of them; every id of the vocabulary has at least 1."""

    freq: np.ndarray
    start: np.ndarray
    of_slot: np.ndarray

    @staticmethod
    def of_counts(counts: np.ndarray) -> Table:
        """Frequencies in proportion to ``counts``, at least 1 each; what rounding leaves goes to the
        most frequent ids."""
        size, total = len(counts), 1 << BITS
        if size > total // 2:
            raise ValueError("the vocabulary is too large for the table")
        spare = total - size
        part = counts.astype(np.float64) * (spare / max(1, counts.sum()))
        freq = np.floor(part).astype(np.int64) + 1
        most = np.argsort(-counts, kind="stable")
        left = total - int(freq.sum())
        freq[most] += left // size
        freq[most[: left % size]] += 1
        return Table.of_frequencies(freq)

    @staticmethod
    def of_frequencies(freq: np.ndarray) -> Table:
        freq = freq.astype(np.uint64)
        start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        return Table(freq, start, np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64)))

    def to_bytes(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes())

    @staticmethod
    def from_bytes(data: bytes) -> Table:
        return Table.of_frequencies(np.frombuffer(zlib.decompress(data), "<u4"))


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One block. Ids are coded from the last step to the first, as they are decoded the other way."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    state = np.full(lanes, 1 << LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    checkpoints: list[tuple[int, np.ndarray]] = []  # words after the checkpoint, states
    after = 0
    bits, half = np.uint64(BITS), np.uint64(32)
    limit = np.uint64(LOW - BITS + 32)
    freq, start = table.freq[ids], table.start[ids]
    for step in range(steps - 1, -1, -1):
        f, s = freq[step * lanes : (step + 1) * lanes], start[step * lanes : (step + 1) * lanes]
        x = state[: len(f)]
        full = x >= (f << limit)
        words.append(x[full].astype("<u4"))
        after += len(words[-1])
        x = np.where(full, x >> half, x)
        quotient = x // f
        state[: len(f)] = (quotient << bits) + (x - quotient * f) + s
        if step and step % STEPS_PER_CHECKPOINT == 0:
            checkpoints.append((after, state.copy()))
    stream = b"".join(w.tobytes() for w in reversed(words))
    places = np.array([after - a for a, _ in reversed(checkpoints)], dtype="<u4").tobytes()
    states = b"".join(s.astype("<u8").tobytes() for s in [state, *[s for _, s in reversed(checkpoints)]])
    head = _HEAD.pack(MAGIC, n, after, lanes, len(checkpoints), zlib.crc32(ids.astype("<u4").tobytes()))
    body = head + places + states + stream
    return body + struct.pack("<I", zlib.crc32(body))


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block, or those between two of its checkpoints: 0 is the block's begin, and
    ``last`` None its end."""
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0] or block[:4] != MAGIC:
        raise ValueError("a block differs from its checksum")
    _, n, n_words, lanes, n_checkpoints, checksum = _HEAD.unpack_from(block)
    at = _HEAD.size
    places = [0, *np.frombuffer(block, "<u4", n_checkpoints, at).tolist()]
    at += 4 * n_checkpoints
    states = np.frombuffer(block, "<u8", lanes * (n_checkpoints + 1), at).reshape(-1, lanes)
    at += states.nbytes
    stream = np.frombuffer(block, "<u4", n_words, at)
    steps = -(-n // lanes)
    end = steps if last is None or last > n_checkpoints else last * STEPS_PER_CHECKPOINT
    place, state = places[first], states[first].astype(np.uint64)
    out = np.empty(n, dtype=np.uint32)
    bits, half, low = np.uint64(BITS), np.uint64(32), np.uint64(1 << LOW)
    slots = np.uint64((1 << BITS) - 1)
    begin = first * STEPS_PER_CHECKPOINT
    for step in range(begin, end):
        room = out[step * lanes : (step + 1) * lanes]
        x = state[: len(room)]
        slot = x & slots
        ids = table.of_slot[slot]
        room[:] = ids
        x = table.freq[ids] * (x >> bits) + slot - table.start[ids]
        short = np.flatnonzero(x < low)
        x[short] = (x[short] << half) | stream[place : place + len(short)].astype(np.uint64)
        place += len(short)
        state[: len(room)] = x
    found = out[begin * lanes : min(n, end * lanes)]
    if first == 0 and last is None and zlib.crc32(found.astype("<u4").tobytes()) != checksum:
        raise ValueError("decoded ids differ from their checksum")
    return found
