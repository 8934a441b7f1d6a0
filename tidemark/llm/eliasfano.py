"""Elias-Fano sequences and an n-gram trie of them, laid out flat so that a mapped buffer is used in place."""

from __future__ import annotations

import mmap
from functools import cached_property

import numpy as np

U = np.uint64
#: Codes of a probability are its -log10 in steps of 1 / STEPS, in 16 bits.
STEPS, UNSEEN = 2_048, 65_535


def codes(p: np.ndarray) -> np.ndarray:
    """Quantised probabilities; an error of half a step at most down to 10 ** -31."""
    return np.minimum(np.rint(-np.log10(p) * STEPS), UNSEEN - 1).astype(np.uint16)


_VALUES = np.append(10.0 ** (np.arange(UNSEEN) / -STEPS), 0.0)


def values(code: np.ndarray) -> np.ndarray:
    """The probabilities of codes, 0 of UNSEEN."""
    return _VALUES[code]


class EliasFano:
    """A monotone sequence: the low bits of each value side by side, the high bits in unary. Where the ones and zeros of
    the unary part are is found once, when it is first asked."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = np.zeros(((n + (top >> low_bits)) // 64 + 1) * 64, np.uint8)
        bits[(v >> low_bits) + np.arange(n)] = 1
        low = np.zeros(n * low_bits // 64 + 2, U)
        if low_bits:
            bit = np.arange(n) * low_bits
            x, shift = (v & ((1 << low_bits) - 1)).astype(U), (bit & 63).astype(U)
            np.bitwise_or.at(low, bit >> 6, x << shift)
            over = np.flatnonzero((bit & 63) + low_bits > 64)
            np.bitwise_or.at(low, (bit[over] >> 6) + 1, x[over] >> (U(64) - shift[over]))
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").view(U))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high]

    @classmethod
    def from_arrays(cls, arrays: list[np.ndarray]) -> EliasFano:
        (n, low_bits), low, high = arrays
        return cls(int(n), int(low_bits), low, high)

    @cached_property
    def _bits(self) -> np.ndarray:
        return np.unpackbits(self.high.view(np.uint8), bitorder="little").view(bool)

    @cached_property
    def _ones(self) -> np.ndarray:
        return np.flatnonzero(self._bits)

    @cached_property
    def _before_zero(self) -> np.ndarray:
        """How many values have a high part below h."""
        zeros = np.flatnonzero(~self._bits)
        return np.append(0, zeros - np.arange(len(zeros)))

    @cached_property
    def _lows(self) -> np.ndarray:
        """The low bits of all values, where they are asked for several times."""
        return np.concatenate([np.empty(0, np.int64), *[self._low(np.arange(a, min(a + (1 << 16), self.n))) for a in range(0, self.n, 1 << 16)]]).astype(np.int32 if self.low_bits < 31 else np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i * self.low_bits
        at, shift = bit >> 6, (bit & 63).astype(U)
        x = self.low[at] >> shift
        split = np.flatnonzero((bit & 63) + self.low_bits > 64)
        x[split] |= self.low[at[split] + 1] << (U(64) - shift[split])
        return (x & U((1 << self.low_bits) - 1)).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self._ones[i] - i) << self.low_bits) | self._low(i)

    def find(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index of the first value >= x within [first, end) if that is x, else -1: successor search over the values that
        share x's high part, a few in general, which are tried in turn, then by halves."""
        upto, lows = self._before_zero, self._lows
        h, want = np.minimum(x >> self.low_bits, len(upto) - 1), (x & ((1 << self.low_bits) - 1)).astype(lows.dtype)
        a, b = np.maximum(upto[h], first), np.minimum(upto[np.minimum(h + 1, len(upto) - 1)], end)
        out = np.full(len(x), -1, np.int64)
        some = np.flatnonzero(a < b)
        for _ in range(3):
            at = a[some]
            low, wanted = lows[at], want[some]
            hit = low == wanted
            out[some[hit]] = at[hit]
            less = low < wanted
            some, at = some[less], at[less] + 1
            a[some] = at
            some = some[at < b[some]]
            if not len(some):
                return out
        last = b.copy()
        while len(some):
            mid = (a[some] + b[some]) >> 1
            less = lows[mid] < want[some]
            a[some[less]] = mid[less] + 1
            b[some[~less]] = mid[~less]
            done = a[some] >= b[some]
            ended = some[done & (a[some] < last[some])]
            hit = ended[lows[a[ended]] == want[ended]]
            out[hit] = a[hit]
            some = some[~done]
        return out


class Lists:
    """Ascending lists, one after the other, made monotone by adding to each the last value of the one before; the places
    where they begin are a monotone sequence too."""

    def __init__(self, starts: EliasFano, values: EliasFano) -> None:
        self.starts, self.values = starts, values

    @classmethod
    def of(cls, sizes: np.ndarray, values: np.ndarray) -> Lists:
        starts = np.append(0, np.cumsum(sizes))
        last = np.where(sizes > 0, values[np.maximum(starts[1:] - 1, 0)] if len(values) else 0, 0)
        shift = np.append(0, np.cumsum(last))[:-1]
        return cls(EliasFano.of(starts), EliasFano.of(values + np.repeat(shift, sizes)))

    def find(self, of: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index over all lists, rank within the list) of x in list `of`; index -1 where it isn't. Lists are opened once
        for neighbours that ask for the same one."""
        new = np.diff(of, prepend=-1) != 0
        lists = of[new]
        first, end = self.starts[lists], self.starts[lists + 1]
        shift = np.zeros(len(lists), np.int64)
        after = np.flatnonzero(first > 0)
        shift[after] = self.values[first[after] - 1]
        run = np.cumsum(new) - 1
        first = first[run]
        at = self.values.find(x + shift[run], first, end[run])
        return at, at - first


class Trie:
    """Words; each word's successors, ascending, with a code each. With trigrams: each word's contexts (the words before
    it), and each context's successors as ranks among the word's, with a code each. What leads on (the words, or the
    contexts) has a second code, of what it leaves to the shorter context. Codes are quantised probabilities."""

    def __init__(self, words: EliasFano, followers: Lists, p: np.ndarray, leave: np.ndarray, contexts: Lists | None = None, grams: Lists | None = None) -> None:
        self.words, self.followers, self.p, self.leave, self.contexts, self.grams = words, followers, p, leave, contexts, grams

    def tobytes(self) -> bytes:
        levels = [self.words] + [e for x in (self.followers, self.contexts, self.grams) if x is not None for e in (x.starts, x.values)]
        arrays = [a for e in levels for a in e.arrays()] + [self.p, self.leave]
        raw = [a.tobytes() for a in arrays]
        head = np.array([len(levels), *map(len, raw)], np.int64)
        return b"".join([head.tobytes(), *[r + bytes(-len(r) % 8) for r in raw]])

    @classmethod
    def frombuffer(cls, buffer) -> Trie:
        """The trie over a buffer, which may be a mapped file; nothing is copied."""
        levels = int(np.frombuffer(buffer, np.int64, 1)[0])
        sizes = np.frombuffer(buffer, np.int64, 3 * levels + 2, 8).tolist()
        at, arrays = 8 * (1 + len(sizes)), []
        for k, size in enumerate(sizes):
            kind = np.dtype(np.uint16 if k >= 3 * levels else U if k % 3 else np.int64)
            arrays.append(np.frombuffer(buffer, kind, size // kind.itemsize, at))
            at += size + -size % 8
        e = [EliasFano.from_arrays(arrays[3 * k : 3 * k + 3]) for k in range(levels)]
        return cls(e[0], Lists(*e[1:3]), *arrays[-2:], *[Lists(*e[k : k + 2]) for k in range(3, levels, 2)])

    @classmethod
    def mapped(cls, raw: bytes) -> Trie:
        """The trie in a memory map of its own."""
        memory = mmap.mmap(-1, len(raw))
        memory.write(raw)
        return cls.frombuffer(memory)

    def _node(self, word: np.ndarray) -> np.ndarray:
        return self.words.find(word, np.zeros(len(word), np.int64), np.full(len(word), self.words.n))

    @staticmethod
    def _along(of: np.ndarray, look) -> np.ndarray:
        """look() of the distinct values of an ascending array, for each of its places."""
        first = np.flatnonzero(np.diff(of, prepend=of[0] - 1)) if len(of) else np.empty(0, np.int64)
        return look(of[first])[np.cumsum(np.diff(of, prepend=of[0] - 1) != 0) - 1] if len(of) else of

    def pairs(self, word: np.ndarray, follower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of pairs, UNSEEN for others; codes that the words leave, UNSEEN for unknown ones), by ascending word."""
        p, leave = np.full(len(word), UNSEEN, np.uint16), np.full(len(word), UNSEEN, np.uint16)
        node = self._along(word, self._node)
        known = np.flatnonzero(node >= 0)
        leave[known] = self.leave[node[known]]
        pair, _ = self.followers.find(node[known], follower[known])
        p[known[pair >= 0]] = self.p[pair[pair >= 0]]
        return p, leave

    def trigrams(self, before: np.ndarray, word: np.ndarray, follower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of trigrams, codes that their contexts leave; UNSEEN for others), by ascending word."""
        p, leave = np.full(len(word), UNSEEN, np.uint16), np.full(len(word), UNSEEN, np.uint16)
        node = self._along(word, self._node)
        known = np.flatnonzero(node >= 0)
        asked = (node[known] << 32) | before[known]
        context = self._along(asked, lambda pairs: self.contexts.find(pairs >> 32, pairs & 0xFFFFFFFF)[0])
        known, context = known[context >= 0], context[context >= 0]
        leave[known] = self.leave[context]
        pair, rank = self.followers.find(node[known], follower[known])
        known, context, rank = known[pair >= 0], context[pair >= 0], rank[pair >= 0]
        gram, _ = self.grams.find(context, rank)
        p[known[gram >= 0]] = self.p[gram[gram >= 0]]
        return p, leave
