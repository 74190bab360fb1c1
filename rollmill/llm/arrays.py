"""Vectorised helpers for whole texts inside Arrow tasks: slicing of batches, words and their hashes as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
#: Elements of a flat array that are worked on at once where temporaries would outgrow the result.
PIECE = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)

#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Word bytes of the two contracts: not white space; and letters, digits and all beyond ASCII (of lower-cased text).
NOT_SPACE = np.array([c not in b" \t\n\x0b\x0c\r" for c in range(256)])
ALNUM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and UTF-8 bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that a slice holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(np.asarray(size, np.int64)) if batch.num_rows else []
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
            upto = max(upto, at + 1)
            yield batch.slice(at, upto - at)
            at = upto


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                ones = np.full(max(n, 1 << 20), base, np.uint64)
                ones[0] = 1
                setattr(self, name, np.cumprod(ones, dtype=np.uint64))
        return self.up, self.down


_POWERS = Powers(0x27BB2EE687B0B0FD)
_OTHER_POWERS = Powers(0x9FB21C651E98DF25)


class Spans:
    """64-bit hashes of the spans of a sequence of codes: equal spans hash alike wherever they stand.

    With a table, codes are looked up in it, some at a time: codes of all bytes of a pack would take eight times its memory.
    """

    def __init__(self, codes: np.ndarray, powers: Powers = _POWERS, table: np.ndarray | None = None) -> None:
        up, self.down = powers.to(len(codes) + 1)
        self.total = np.zeros(len(codes) + 1, np.uint64)
        for at in range(0, len(codes), PIECE):
            some = codes[at : at + PIECE]
            end = at + len(some)
            some = (some if table is None else table[some]) * up[at:end]
            np.cumsum(some, dtype=np.uint64, out=self.total[at + 1 : end + 1])
            self.total[at + 1 : end + 1] += self.total[at]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.total[ends] - self.total[starts]) * self.down[starts]
        return mix(value + (ends - starts).astype(np.uint64) * _STEP)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(codes).hashes(starts, ends)


def other_span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the same spans with another base, over codes mixed anew: with span_hashes, 128 bits."""
    return Spans(mix(codes ^ _STEP), _OTHER_POWERS).hashes(starts, ends)


def words_of(offsets: np.ndarray, data: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of word bytes within one text) and the index of the first word of each text."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = word_byte[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:]
    ends = np.zeros(n + 1, bool)
    ends[1:] = inside[:-1] & (~inside[1:] | first[1:])
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = PIECE) -> np.ndarray:
    """A hash per word, computed over pieces of about ``limit`` bytes so that one huge text needs no huge temporaries."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        upto = max(int(np.searchsorted(ends, low + limit, "right")), at + 1)
        high = ends[upto - 1]
        out[at:upto] = Spans(data[low:high], table=_BYTE_CODE).hashes(starts[at:upto] - low, ends[at:upto] - low)
        at = upto
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order (by sorting: for such keys faster than a hash table)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the runs (start, length), run after run."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of the length that begins at one of the starts."""
    so_far = np.bincount(starts, minlength=n + 1)[:n]
    np.cumsum(so_far, out=so_far)
    out = so_far > 0
    out[length:] = so_far[length:] > so_far[: max(n - length, 0)]
    return out


def within(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans (start, end)."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:n], out=depth[:n]) > 0
