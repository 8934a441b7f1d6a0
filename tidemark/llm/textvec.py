"""Words, shingles and hashes of Arrow string columns by numpy, whole batches at a time. Small helpers of Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_M = 0x9E3779B97F4A7C15 | 1
_MINV = pow(_M, -1, 1 << 64)
#: Bytes of words: ASCII letters and digits, and all bytes of characters beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers = np.empty(0, U), np.empty(0, U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x bears on every bit of the result."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the multiplier and of its inverse modulo 2**64, n or more of each."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 18)
        one, inverse = np.full(n, _M, U), np.full(n, _MINV, U)
        one[0] = inverse[0] = 1
        _powers = np.multiply.accumulate(one), np.multiply.accumulate(inverse)
    return _powers


def slices(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about `most` bytes each; a longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums[j] - sums[i], times the inverse power of i, is a hash of data[i:j]."""
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and row of every word: the longest runs of word bytes, cut at the ends of texts."""
    is_word = WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = is_word[:-1]
    start = np.flatnonzero(is_word & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = is_word[1:]
    end = np.flatnonzero(is_word & (~after | first[1:])) + 1
    return start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column)


def shingle_hashes(words: np.ndarray, row: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the n-word shingles in order; a text of fewer words, but one at least, is one shingle."""
    if len(words) >= n:
        total = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            total = total * U(_M) + words[k : len(words) - n + 1 + k]
        whole = row[: len(total)] == row[n - 1 :]
        hashes, of = mix(total[whole]), row[: len(total)][whole]
    else:
        hashes, of = np.empty(0, U), np.empty(0, row.dtype)
    count = np.bincount(row, minlength=rows)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        at = np.searchsorted(row, short)
        extra = []
        for s, c in zip(at.tolist(), count[short].tolist()):
            h = 0
            for w in words[s : s + c].tolist():
                h = (h * _M + w) & 0xFFFFFFFFFFFFFFFF
            extra.append(h ^ c)
        hashes, of = np.concatenate([hashes, mix(np.array(extra, U))]), np.concatenate([of, short.astype(of.dtype)])
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    return hashes, of


def sort_rows(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """hashes, of rows that stand one after the other, sorted within each row."""
    out = hashes.copy()
    cuts = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row)).tolist()
    for s, e in zip(cuts, cuts[1:]):
        out[s:e].sort()
    return out


def distinct(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that stand one after the other, each hash of a row once, sorted by (row, hash)."""
    h = sort_rows(hashes, row)
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[once], row[once]


def occurrences(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows that stand one after the other, sorted by (row, hash): hashes, rows, and the how-manieth of its kind each
    is, from 0."""
    h = sort_rows(hashes, row)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
    return h, row, nth
