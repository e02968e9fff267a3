"""Text columns of Arrow batches as flat byte arrays: words, hashes and runs without a loop over documents.

All helpers treat null texts as empty, never cut a text, and never let a word or
window cross the end of its document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACES = (0x20, *range(0x09, 0x0E))
SOLID = np.ones(256, bool)
SOLID[list(_SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows into parts of about ``limit`` bytes of text; a longer text is a part of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows behind each other, and where each row begins (one offset more than rows)."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that close values get unrelated hashes."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every run of solid bytes, and the number of the first word of each row (one more than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = solid[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    out = mix(left.astype(np.uint64) * _K)
    todo, at = np.arange(len(starts)), starts
    while len(todo):
        short = left < 8
        keep = np.where(short, (np.uint64(1) << (np.uint64(8) * (left & 7).astype(np.uint64))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
        out[todo] = mix(out[todo] * _K + (eight[at] & keep))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` values from each position on; positions without ``k`` values are left off."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _K
        out += hashes[j: j + n]
    return mix(out)


def slide(values: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """The least (or by ``pick`` another) of the ``w`` values from each position on."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def window_rows(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """For each of ``total - k + 1`` window positions, whether it lies within one row."""
    ok = np.ones(max(0, total - k + 1), bool)
    for end in np.unique(first[1:]):
        ok[max(0, end - k + 1): end] = False
    return ok
