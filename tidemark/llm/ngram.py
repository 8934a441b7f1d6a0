"""Language-model scoring: Witten-Bell trigrams in Elias-Fano tries, a trie per shard of contexts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import textvec as tv
from .common import bucketed, give_back, map_arrow, ship_package, table, written
from .eliasfano import EliasFano, Lists, Trie, codes, values

U = np.uint64
START, END, UNKNOWN, FIRST = 0, 1, 2, 3
BLOCK_BYTES = 8 << 20
#: About so many distinct words of blocks, or distinct pairs and trigrams of blocks, go to one task's group.
SHARD_WORDS, SHARD_GRAMS = 2_000_000, 1 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, bytes of equal weight side by side."""
    planes = b"".join((a.view(f"u{a.itemsize}") >> 8 * k).astype(np.uint8).tobytes() for a in map(np.ascontiguousarray, arrays) for k in range(a.itemsize))
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.itemsize)]], np.int64).tobytes()
    raw = head + planes
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8 + 16 * n
    for size, item in np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2).tolist():
        planes = np.frombuffer(raw, np.uint8, size * item, at).reshape(item, size)
        whole = planes[0].astype(f"u{item}")
        for k in range(1, item):
            if planes[k].any():
                whole |= planes[k].astype(whole.dtype) << 8 * k
        out.append(whole.view(f"i{item}"))
        at += size * item
    return out


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a and b of the distinct pairs, in order, which of them each row is); values are below 2**31.

    Where a pair and the row's number fit 64 bits they are sorted as one number, without an order beside it."""
    if len(a) and int(a.min()) >= 0 and int(b.min()) >= 0:
        wide, row = int(b.max()).bit_length(), (len(a) - 1).bit_length()
        if int(a.max()).bit_length() + wide + row <= 63:
            keys = a.astype(np.int64)
            for x, bits in ((b, wide), (np.arange(len(a), dtype=np.int32), row)):
                keys <<= bits
                keys |= x
            keys.sort()
            of = np.empty(len(a), np.int32)
            rows = (keys & ((1 << row) - 1)).astype(np.int32)
            keys >>= row
            new = np.append(True, keys[1:] != keys[:-1])
            of[rows] = np.cumsum(new, dtype=np.int32) - 1
            keys = keys[new]
            return (keys >> wide).astype(np.int32), (keys & ((1 << wide) - 1)).astype(np.int32), of
    keys, of = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
    return (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), of.astype(np.int32)


def _sliced(look, *columns: np.ndarray, most: int = 1 << 17) -> list[np.ndarray]:
    """look(*columns), arrays as long as the columns, from slices of them, so that what it needs on the way stays small."""
    parts = [look(*[c[a : a + most] for c in columns]) for a in range(0, max(len(columns[0]), 1), most)]
    return [np.concatenate(x) for x in zip(*parts)]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, place of each token's word among them, end of each text's tokens): runs of anything but ASCII white
    space, with only ASCII letters in lower case."""
    runs = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ends = runs.offsets.to_numpy()[1:].astype(np.int64) - runs.offsets[0].as_py()
    words = runs.flatten().dictionary_encode()
    flat, names = words.indices.to_numpy(), words.dictionary.cast(pa.large_binary())
    cuts = np.frombuffer(names.buffers()[1], np.int64, names.offset + len(names) + 1)[names.offset :].tolist() if len(names) else [0]
    raw = names.buffers()[2].to_pybytes() if len(names) and names.buffers()[2] else b""
    index = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
    if b"" in index:  # before white space that a text begins with, and after what it ends with
        nothing = flat == index.index(b"")
        ends -= np.append(0, np.cumsum(nothing))[ends]
        flat = flat[~nothing]
    return index, flat, ends


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per run of texts: the hashes of its distinct words, ascending, and each text's words as places among them."""
    for batch in batches:
        texts = batch.column("text")
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        runs = (np.cumsum(sizes) - sizes) // BLOCK_BYTES
        cuts = np.append(np.flatnonzero(np.diff(runs, prepend=-1)), len(sizes)).tolist()
        for a, b in zip(cuts, cuts[1:]):
            index, flat, ends = _words(texts.slice(a, b - a))
            names, place = np.unique(np.fromiter(map(xxh3_64_intdigest, index), U, len(index)), return_inverse=True)
            train = np.asarray(batch.column("train").slice(a, b - a))
            tokens = place.astype(np.int32)[flat] if len(flat) else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().int >> 65]),
                    pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column("id").slice(a, b - a)),
                    pa.array([pack(names, tokens, ends, train.astype(np.int8))], pa.binary()),
                    pa.array([len(names)]),
                    pa.array([len(tokens) + b - a]),
                    pa.array([int(train.sum())]),
                ],
                ["block", "ids", "data", "n_words", "n_tokens", "n_train"],
            )


def _shard_of(names: np.ndarray, shards: int) -> np.ndarray:
    """Ascending with the names."""
    return (((names.view(U) >> U(32)) * U(shards)) >> U(32)).astype(np.int64)


def _of_text(ends: np.ndarray) -> np.ndarray:
    """The text of each token."""
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def _ask_words(shards: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                names, tokens, ends, train = unpack(data)
                n = np.bincount(tokens[train[_of_text(ends)] > 0], minlength=len(names)).astype(np.int32)
                cuts = np.searchsorted(_shard_of(names, shards), np.arange(shards + 1))
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array(np.full(len(some), block)), pa.array([pack(names[cuts[s] : cuts[s + 1]], n[cuts[s] : cuts[s + 1]]) for s in some], pa.binary())],
                    ["shard", "block", "data"],
                )

    return ask


def _count_words(shards: int, hot: int):
    """Of a shard of words: each block's words' ids and counts in training texts, and one row of totals.

    Ids are dense, small for frequent words. hot: words of more occurrences are named in the row of totals."""

    def counted(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        asked = [unpack(d) for d in group.column("data").to_pylist()]
        names, of = np.unique(np.concatenate([a[0] for a in asked]).view(U), return_inverse=True)
        c = np.zeros(len(names), np.int64)
        np.add.at(c, of, np.concatenate([a[1] for a in asked]).astype(np.int64))
        ids = np.empty(len(names), np.int64)
        ids[np.lexsort((names, -c))] = FIRST + np.arange(len(names)) * shards + shard
        ids[c == 0] = UNKNOWN
        cuts = np.append(0, np.cumsum([len(a[0]) for a in asked]))
        replies = [pack(ids[of[a:b]], c[of[a:b]]) for a, b in zip(cuts, cuts[1:])]
        much = np.flatnonzero(c > hot)
        n = len(asked)
        del asked, of
        give_back()
        return pa.table({
            "shard": pa.array([shard] * (n + 1), pa.int32()),
            "block": pa.array([*group.column("block").to_pylist(), None], pa.int64()),
            "reply": pa.array([*replies, None], pa.binary()),
            "total": pa.array([None] * n + [int(c.sum())], pa.int64()),
            "known": pa.array([None] * n + [int((c > 0).sum())], pa.int64()),
            "hot": pa.array([None] * n + [[{"id": int(ids[k]), "n": int(c[k])} for k in much]], pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))),
        })

    return counted


class _Text:
    """A block's tokens with the ids and counts of its words."""

    def __init__(self, data: bytes, replies: list[bytes] | None, n_ends: int) -> None:
        _, tokens, self.ends, self.train = unpack(data)
        known = [unpack(r) for r in replies or []]
        # Places of the block's words: START, END and UNKNOWN before its own.
        self.ids = np.concatenate([[START, END, UNKNOWN], *[k[0] for k in known]]).astype(np.int64)
        self.counts = np.concatenate([[0, n_ends, 0], *[k[1] for k in known]]).astype(np.int64)
        place = np.arange(len(self.ids), dtype=np.int32)
        place[self.ids == UNKNOWN] = UNKNOWN
        texts = len(self.ends)
        self.doc = np.repeat(np.arange(texts, dtype=np.int32), np.diff(self.ends, prepend=0) + 1)
        self.w3 = np.full(len(self.doc), END, np.int32)
        words = np.ones(len(self.doc), bool)
        words[self.ends + np.arange(texts)] = False
        self.w3[words] = place[tokens + FIRST]
        first = np.diff(self.doc, prepend=-1) > 0
        self.w2 = np.where(first, np.int32(START), np.append(np.int32(START), self.w3[:-1]))
        self.w1 = np.where(first, np.int32(START), np.append(np.int32(START), self.w2[:-1]))
        self.trained = self.train[self.doc]


def _key(*ids: np.ndarray) -> np.ndarray:
    """One number of several; the same for the same ones."""
    key = np.zeros(len(ids[0]), U)
    for x in ids:
        key = tv.mix(key * U(31) + np.asarray(x).astype(U))
    return key


class _Split:
    """Contexts with more occurrences than a shard holds: they are dealt by their successors. What each shard says of its
    part (occurrences and distinct successors) gives the context's sums, and by them the parts' probabilities their due."""

    def __init__(self, contexts: dict[tuple[int, ...], int], limit: int, width: int) -> None:
        self.keys = _key(*np.array(list(contexts), np.int64).reshape(-1, width).T)
        order = np.argsort(self.keys)
        self.keys, self.parts = self.keys[order], np.array([-(-n // limit) for n in contexts.values()], np.int64)[order]
        self.pieces = self.wholes = np.empty(0, U)

    def parts_of(self, *context: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(context[0]), np.int64)
        key = _key(*context)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.parts[at], 1)

    def settle(self, rows: list[tuple]) -> _Split:
        """rows: (context, shard, occurrences, distinct successors) of all parts."""
        if rows:
            of = np.array([r[0] for r in rows], np.int64).T
            shard, c, t = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
            self.wholes, context = np.unique(_key(*of), return_inverse=True)
            all_c, all_t = np.bincount(context, c), np.bincount(context, t)
            self.leave = all_t / (all_c + all_t)
            pieces = _key(*of, shard)
            order = np.argsort(pieces)
            self.pieces, self.factor = pieces[order], ((c + t) / (all_c + all_t)[context])[order]
        return self

    def settled(self, p: np.ndarray, leave: np.ndarray, shard: np.ndarray, *context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities that shards gave, and what contexts leave (all of it, those that no training text has), of whole
        contexts."""
        p, leave = p.copy(), np.where(leave > 0, leave, 1.0)
        for keys, values_, out, of in ((self.pieces, "factor", p, (*context, shard)), (self.wholes, "leave", leave, context)):
            if len(keys):
                some = np.flatnonzero(self.parts_of(*context) > 1)
                key = _key(*[x[some] for x in of])
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                there = keys[at] == key
                found = getattr(self, values_)[at[there]]
                out[some[there]] = found * p[some[there]] if values_ == "factor" else found
        return p, leave


class _Grams:
    """The distinct n-grams of a block that its shards are asked for, in the order of the shards."""

    def __init__(self, columns: list[np.ndarray], of: np.ndarray, shard: np.ndarray, shards: int) -> None:
        shard = shard.astype(np.uint16) if shards <= 1 << 16 else shard  # numbers of 16 bits are sorted by their digits
        order = np.argsort(shard, kind="stable").astype(np.int32)
        self.columns, self.shard = [c[order] for c in columns], shard[order]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.of = rank[of]  # of each token asked for
        self.cuts = np.searchsorted(self.shard, np.arange(shards + 1))
        self.some = np.flatnonzero(np.diff(self.cuts))

    def requests(self, ids: np.ndarray, trained: np.ndarray) -> list[bytes]:
        n = np.bincount(self.of, trained, len(self.shard)).astype(np.int32)
        number, out = np.empty(len(ids), np.int32), []
        for s in self.some:
            a, b = self.cuts[s], self.cuts[s + 1]
            words = _distinct(np.concatenate([c[a:b] for c in self.columns]))
            words = words[np.argsort(ids[words])]  # frequent words first: small numbers, small steps between ids
            number[words] = np.arange(len(words))
            out.append(pack(np.diff(ids[words], prepend=0), *[number[c[a:b]] for c in self.columns], n[a:b]))
        return out

    def answers(self, replies: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
        """(probability, what the context leaves) of each n-gram, as its shard sees it."""
        said = [unpack(r) for r in replies or []]
        p, leave = (np.concatenate([np.empty(0, np.uint16), *[x[k].view(np.uint16) for x in said]]) for k in (0, 1))
        return values(p), values(leave)


@dataclass
class _Plan:
    """What every pass over the blocks needs."""

    n_ends: int
    tokens: int  # of all training texts
    vocabulary: int
    shards: int
    words: _Split
    contexts: _Split | None = None

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1))

    def pairs(self, t: _Text) -> tuple[np.ndarray, _Grams]:
        """(tokens after a known word, their pairs)."""
        there = t.counts > 0
        there[START] = self.n_ends > 0
        at = np.flatnonzero(there[t.w2])
        x, y, of = _distinct_pairs(t.w2[at], t.w3[at])
        t.pair_of, t.pairs = np.full(len(t.w3), -1, np.int32), (x, y)
        t.pair_of[at] = of

        def shard_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray]:
            parts = self.words.parts_of(t.ids[x])
            salt = np.where(parts > 1, tv.mix(t.ids[y].astype(U) + U(1)) % parts.astype(U), U(0))
            return ((((_key(t.ids[x], salt) >> U(32)) * U(self.shards)) >> U(32)).astype(np.int32),)

        return at, _Grams([x, y], of, *_sliced(shard_of, x, y), self.shards)

    def known_pairs(self, t: _Text, replies: list[bytes] | None) -> np.ndarray:
        """Whether training texts hold each token with the word before it, as after_pairs() says."""
        seen = np.zeros(len(t.w3), bool)
        at, grams = self.pairs(t)
        of_pair, _ = self.words.settled(*grams.answers(replies), grams.shard, t.ids[grams.columns[0]])
        seen[at] = (of_pair > 0)[grams.of]
        return seen

    def after_pairs(self, t: _Text, replies: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each token after the word before it, whether training texts hold that pair)."""
        p = self.base(t.counts)[t.w3]
        seen = np.zeros(len(p), bool)
        at, grams = self.pairs(t)
        of_pair, leave = self.words.settled(*grams.answers(replies), grams.shard, t.ids[grams.columns[0]])
        seen[at] = of_pair[grams.of] > 0
        p[at] = of_pair[grams.of] + leave[grams.of] * p[at]
        return p, seen

    def trigrams(self, t: _Text, seen: np.ndarray) -> tuple[np.ndarray, _Grams]:
        """(tokens after a known pair, their trigrams), after pairs()."""
        starts = np.diff(t.doc, prepend=-1) > 0
        known = np.where(starts, self.n_ends > 0, np.append(False, seen[:-1]))
        at = np.flatnonzero(known)
        # A token's context is the pair of the token before it; the last number is that of no token.
        x, y = (np.append(c, np.int32(START)) for c in t.pairs)
        context = np.where(starts, np.int32(len(x) - 1), np.append(np.int32(-1), t.pair_of[:-1]))
        context, w3, of = _distinct_pairs(context[at], t.w3[at])
        w1, w2 = x[context], y[context]

        def shard_of(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> tuple[np.ndarray]:
            parts, split = self.words.parts_of(t.ids[w2]), self.contexts.parts_of(t.ids[w1], t.ids[w2])
            salt = np.where(parts > 1, tv.mix(t.ids[w1].astype(U) + U(1)) % parts.astype(U), U(0))
            salt = salt + np.where(split > 1, _key(t.ids[w1]) + tv.mix(t.ids[w3].astype(U) + U(1)) % split.astype(U), U(0))
            return ((((_key(t.ids[w2], salt) >> U(32)) * U(self.shards)) >> U(32)).astype(np.int32),)

        return at, _Grams([w1, w2, w3], of, *_sliced(shard_of, w1, w2, w3), self.shards)

    def after_trigrams(self, t: _Text, p: np.ndarray, seen: np.ndarray, replies: list[bytes] | None) -> np.ndarray:
        at, grams = self.trigrams(t, seen)
        of_gram, leave = self.contexts.settled(*grams.answers(replies), grams.shard, t.ids[grams.columns[0]], t.ids[grams.columns[1]])
        p = p.copy()
        p[at] = of_gram[grams.of] + leave[grams.of] * p[at]
        return p


def _ask(work):
    """Rows (shard, block, data) of what work(text, row) asks the shards for."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams, ids, trained = work(row)
                data = pa.array(grams.requests(ids, trained), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(grams.some, pa.int32()), pa.array(np.full(len(data), row["block"])), data], ["shard", "block", "data"])

    return ask


def pair_trie(word: np.ndarray, follower: np.ndarray, n: np.ndarray) -> tuple[Trie, np.ndarray, np.ndarray, np.ndarray]:
    """(trie of distinct pairs that occur n times, ascending; the words, their occurrences and distinct successors).

    Witten-Bell: p(w | h) = (c(h w) + t(h) p(w | shorter h)) / (c(h) + t(h)), t counting the distinct words after h; the
    trie has c(h w) / (c(h) + t(h)) of the pair and t(h) / (c(h) + t(h)) of the word."""
    words, at = np.unique(word, return_inverse=True)
    c, t = np.bincount(at, n, len(words)), np.bincount(at, minlength=len(words))
    return Trie(EliasFano.of(words), Lists.of(t, follower), codes(n / (c + t)[at]), codes(t / (c + t))), words, c, t


def trigram_trie(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, n: np.ndarray) -> tuple[Trie, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trie of distinct trigrams, ascending by w2, w1, w3, that occur n times; w1 and w2 of the contexts, their
    occurrences and distinct successors); as pair_trie()."""
    words, at = np.unique(w2, return_inverse=True)
    f2, f3, of = _distinct_pairs(at, w3)
    kinds = np.bincount(f2, minlength=len(words))
    first = np.append(0, np.cumsum(kinds))
    c2, c1, context = _distinct_pairs(at, w1)
    c, t = np.bincount(context, n, len(c2)), np.bincount(context, minlength=len(c2))
    trie = Trie(
        EliasFano.of(words), Lists.of(kinds, f3), codes(n / (c + t)[context]), codes(t / (c + t)),
        Lists.of(np.bincount(c2, minlength=len(words)), c1), Lists.of(t, of - first[c2[context]]),
    )
    return trie, c1, words[c2], c, t


def _answer(order: int, plan: _Plan, limit: int):
    """Of a shard: the trie of what training texts hold, then each block's n-grams through it, and a row of what others need
    to know: split contexts' parts and, of pairs, those with more occurrences than a shard holds."""

    def answer(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        asked = [unpack(d) for d in group.column("data").to_pylist()]
        asked = [[np.cumsum(a[0]), *a[1:]] for a in asked]
        # The shard's words are numbered; the trie is of these numbers.
        ids = _distinct(np.concatenate([a[0] for a in asked]))
        columns = [np.concatenate([np.searchsorted(ids, a[0]).astype(np.int32)[a[1 + k]] for a in asked]) for k in range(order)]
        n = np.concatenate([a[-1] for a in asked])
        cuts = np.append(0, np.cumsum([len(a[-1]) for a in asked])).tolist()
        del asked
        if order == 2:
            x, y, of = _distinct_pairs(*columns)
            n = np.bincount(of, n, len(x)).astype(np.int64)
            known = np.flatnonzero(n)
            trie, *context, c, t = pair_trie(x[known], y[known], n[known])
            much = known[n[known] > limit]
            hot = list(zip(ids[x[much]].tolist(), ids[y[much]].tolist(), n[much].tolist(), [-1] * len(much)))
            split = np.flatnonzero(plan.words.parts_of(ids[context[0]]) > 1) if len(known) else []
            hot += [(int(ids[context[0][k]]), -1, int(c[k]), int(t[k])) for k in split]
            p, leave = _sliced(Trie.mapped(trie.tobytes()).pairs, x, y)
            runs = [x]
        else:
            y, x, of = _distinct_pairs(columns[1], columns[0])
            context, z, gram = _distinct_pairs(of, columns[2])
            x, y, of = x[context], y[context], gram
            n = np.bincount(of, n, len(x)).astype(np.int64)
            known = np.flatnonzero(n)
            trie, *context, c, t = trigram_trie(x[known], y[known], z[known], n[known])
            split = np.flatnonzero(plan.contexts.parts_of(ids[context[0]], ids[context[1]]) > 1) if len(known) else []
            hot = [(int(ids[context[0][k]]), int(ids[context[1][k]]), int(c[k]), int(t[k])) for k in split]
            p, leave = _sliced(Trie.mapped(trie.tobytes()).trigrams, x, y, z)
        replies = [pack(p[of[a:b]].view(np.int16), leave[of[a:b]].view(np.int16)) for a, b in zip(cuts, cuts[1:])]
        del columns, of, p, leave, trie
        give_back()
        some = pa.array([None] * len(replies) + [[dict(zip(("a", "b", "n", "t"), h)) for h in hot]], pa.list_(pa.struct([(f, pa.int64()) for f in ("a", "b", "n", "t")])))
        return pa.table({"shard": pa.array([shard] * (len(replies) + 1), pa.int32()), "block": pa.array([*group.column("block").to_pylist(), None], pa.int64()), "reply": pa.array([*replies, None], pa.binary()), "hot": some})

    return answer


def _totals(plan: _Plan):
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.select(["data", "replies", "replies2", "replies3"]).to_pylist()):
                t = _Text(row["data"], row["replies"], plan.n_ends)
                docs = len(t.ends)
                of_base = np.log10(plan.base(t.counts))[t.w3]
                p, seen = plan.after_pairs(t, row["replies2"])
                p = plan.after_trigrams(t, p, seen, row["replies3"])
                total = lambda x: pa.array(np.bincount(t.doc, x, docs))  # noqa: B023, E731
                n_known = np.bincount(t.doc, t.counts[t.w3] > 0, docs).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids").slice(k, 1).flatten(), pa.array(t.train > 0), pa.array(np.bincount(t.doc, minlength=docs)), pa.array(n_known), total(of_base), total(np.log10(p))],
                    ["id", "train", "n_tokens", "n_known", "base_score", "score"],
                )

    return totals


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row of docs: the log10 probability of its
    whole text under a trigram model of the rows for which `train` holds, and under their smoothed word frequencies.

    Tokens are runs of anything but space and U+0009 to U+000D, A-Z in lower case, then one end. A null text is empty. A
    null `train` is false. Rows count as often as they are repeated. Without training rows every token has the base's
    probability. No rows, no result; other columns don't matter. Words go by a 64-bit hash.

    Texts become blocks of 8 MB, written once with their words numbered, in buckets, so that answers alone are dealt to
    them. A block asks shards of words for ids and counts, shards of words for the pairs that follow them, and shards of
    pairs for the trigrams, each distinct n-gram once, together with its number in the block's training texts. A shard's
    task counts them, maps their trie and answers through it. A word or pair with more occurrences than a shard holds is
    dealt by what follows it; there are no more of these than shards, and their parts' sums go to all blocks. Nothing is
    dropped, however rare."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = bucketed(map_arrow(rows, _blocks, f"block long, ids array<{kind}>, data binary, n_words long, n_tokens long, n_train long"), "blocks", "block")
    n_words, n_tokens, n_ends = (x or 0 for x in blocks.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("n_train")).first())
    word_shards, gram_shards = max(1, -(-n_words // shard_words)), max(1, -(-n_tokens // shard_grams))
    ship_package(spark)
    asked = map_arrow(blocks.select("block", "data"), _ask_words(word_shards), "shard int, block long, data binary")
    counted = asked.groupBy("shard").applyInArrow(_count_words(word_shards, shard_grams), "shard int, block long, reply binary, total long, known long, hot array<struct<id: long, n: long>>")
    counted = written(counted, "words")
    n, v = (x or 0 for x in counted.agg(F.sum("total"), F.sum("known")).first())
    hot = {(r["id"],): r["n"] for r in counted.where("size(hot) > 0").select(F.explode("hot").alias("h")).select("h.*").collect()}
    hot |= {(START,): n_ends} if n_ends > shard_grams else {}
    plan = _Plan(n_ends, n + n_ends, v + (n_ends > 0), gram_shards, _Split(hot, shard_grams, 1))

    def with_replies(table_: DataFrame, replies: DataFrame, name: str) -> DataFrame:
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("shard", "reply"))), lambda r: r["reply"])
        return table_.join(replies.where("block is not null").groupBy("block").agg(ordered.alias(name)), "block", "left")

    def through_shards(asked: DataFrame, order: int) -> tuple[DataFrame, list]:
        said = asked.groupBy("shard").applyInArrow(_answer(order, plan, shard_grams), "shard int, block long, reply binary, hot array<struct<a: long, b: long, n: long, t: long>>")
        said = written(said, f"answers{order}")
        return said, said.where("size(hot) > 0").select("shard", F.explode("hot").alias("h")).select("shard", "h.*").collect()

    def of_pairs(row: dict) -> tuple[_Grams, np.ndarray, np.ndarray]:
        t = _Text(row["data"], row["replies"], plan.n_ends)
        at, grams = plan.pairs(t)
        return grams, t.ids, t.trained[at]

    def of_trigrams(row: dict) -> tuple[_Grams, np.ndarray, np.ndarray]:
        t = _Text(row["data"], row["replies"], plan.n_ends)
        at, grams = plan.trigrams(t, plan.known_pairs(t, row["replies2"]))
        return grams, t.ids, t.trained[at]

    known = with_replies(blocks, counted, "replies")
    pairs, hot = through_shards(map_arrow(known.select("block", "data", "replies"), _ask(of_pairs), "shard int, block long, data binary"), 2)
    plan.words.settle([((r.a,), r.shard, r.n, r.t) for r in hot if r.t >= 0])
    contexts = {(r.a, r.b): r.n for r in hot if r.t < 0}
    contexts |= {(START, START): n_ends} if n_ends > shard_grams else {}
    plan.contexts = _Split(contexts, shard_grams, 2)
    known = with_replies(known, pairs, "replies2")
    trigrams, hot = through_shards(map_arrow(known.select("block", "data", "replies", "replies2"), _ask(of_trigrams), "shard int, block long, data binary"), 3)
    plan.contexts.settle([((r.a, r.b), r.shard, r.n, r.t) for r in hot])
    out = map_arrow(with_replies(known, trigrams, "replies3"), _totals(plan), f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(plan.tokens).cast("long"))


def op12(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held_out = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 5 == 1
    out = score(table(spark, sf_dir, "documents"), ~held_out)
    return out.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
