"""Words of a block of UTF-8 texts as numpy arrays, for use inside Arrow tasks.

A block is a run of whole documents.  Its texts stay one byte array; words are offsets into it and
64-bit fingerprints, so that no Python object is made for a word.  The size of a block bounds the
memory of a task; a document longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20

_MULTIPLIERS = (
    np.random.Generator(np.random.PCG64(20260101)).integers(0, 2**63, 64, dtype=np.uint64) * 2 + 1
).astype(np.uint64)
_BELOW = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


def byte_table(is_member) -> np.ndarray:
    return np.array([bool(is_member(b)) for b in range(256)])


SPACES = b" \t\n\x0b\x0c\r"
# Every byte but the blank and \x09-\x0d.
SPACED = byte_table(lambda b: b not in SPACES)
# Digits, letters and everything beyond ASCII.
ALPHANUMERIC = byte_table(lambda b: b >= 0x80 or chr(b).isalnum())
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offset of each row; a NULL is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of up to ``most`` bytes, or of one document."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


class Words:
    """``start``/``end``: bytes of every word; ``first``: number of the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        inside = member[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        begins = offsets[:-1][offsets[:-1] < len(data)]
        before[begins] = False
        ends = offsets[1:][offsets[1:] > 0]
        after[ends - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n_docs = len(offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())

    def prints(self) -> np.ndarray:
        """A 64-bit fingerprint of each word, never 0.  Eight bytes are read at a time."""
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        length = self.end - self.start
        result = mix(length.astype(np.uint64) * _MULTIPLIERS[0])
        at, left, rows = self.start, length, None
        while len(at):
            part = (eight[at] & _BELOW[np.minimum(left, 8)]) * _MULTIPLIERS[1]
            if rows is None:
                result = mix(result + part)
            else:
                result[rows] = mix(result[rows] + part)
            more = np.flatnonzero(left > 8)
            rows = more if rows is None else rows[more]
            at, left = at[more] + 8, left[more] - 8
        result[result == 0] = 1
        return result

    def windows(self, size: int) -> np.ndarray:
        """Numbers of the words at which ``size`` words of one document begin."""
        n = np.maximum(self.counts() - size + 1, 0)
        return ranges(self.first[:-1], n)

    def text(self, low: int, high: int) -> bytes:
        """Words ``low`` to ``high`` of the block, joined by one blank."""
        raw = self.data
        return b" ".join(
            raw[a:b].tobytes() for a, b in zip(self.start[low:high], self.end[low:high], strict=True)
        )


def window_prints(prints: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A fingerprint of ``size`` consecutive words for each start in ``at``."""
    total = np.zeros(max(len(prints) - size + 1, 0), np.uint64)
    for k in range(size):
        total += prints[k : k + len(total)] * _MULTIPLIERS[2 + k % 61]
    return mix(total[at] + np.uint64(size))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i] + lengths[i] - 1`` for each i, one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths), lengths)
    return skip + np.arange(total)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the spans."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def per_document(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each run of places ``first[i] .. first[i+1] - 1``."""
    running = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=running[1:])
    return running[first[1:]] - running[first[:-1]]
