"""Words of blocks, packed arrays and trie searches: the same results by fewer steps."""

import numpy as np
import pyarrow as pa

from tidemark.llm import ngram
from tidemark.llm.eliasfano import EliasFano, Trie


def test_words_are_those_of_bytes_split():
    texts = [None, "", " ", "A b\tÀ a ", "\n\x0bx\x0c\ry\x1cz\x1f\x85 Q", "  lead", "trail\t\t", "É É é", "　  ", "a\x00b A\x00B"]
    broken = pa.array([b"\xff A \xc3", b"B\xe2\x82 \xa0 b"]).view(pa.string())
    long = [" ".join(f"W{k * j % 97}" for k in range(60)) for j in range(400)]
    for some in (pa.array(texts), pa.array(["cut off", *texts])[1:], pa.array(texts[:3]), pa.array([], pa.string()), broken, *[pa.array(long)[a : a + 90] for a in (0, 90, 310)]):
        index, flat, ends = ngram._words(some)
        want = [x.lower().split() for x in some.cast(pa.binary()).fill_null(b"").to_pylist()]
        assert [[index[k] for k in flat[a:b]] for a, b in zip(np.append(0, ends), ends)] == want
        assert all(type(w) is bytes for w in index)


def test_packed_arrays_come_back():
    rng = np.random.default_rng(1)
    for kind in (np.int8, np.int16, np.int32, np.int64):
        i = np.iinfo(kind)
        arrays = [rng.integers(i.min, i.max, 1_000, kind, endpoint=True), np.arange(100).astype(kind), np.empty(0, kind), np.array([i.min, -1, 0, i.max], kind)[::-1]]
        for a, b in zip(arrays, ngram.unpack(ngram.pack(*arrays)), strict=True):
            assert a.dtype == b.dtype and (a == b).all()


def test_find_decodes_each_low_part_once(monkeypatch):
    rng = np.random.default_rng(2)
    v = np.sort(rng.choice(200_000, 20_000, replace=False))
    e = EliasFano.of(v)
    decoded, low = [], EliasFano._low
    monkeypatch.setattr(EliasFano, "_low", lambda self, i: decoded.append(len(i)) or low(self, i))
    for x in (rng.integers(0, 250_000, 50_000), v, np.array([0, v[0], v[-1], v[-1] + 1, 10**9])):
        first, end = np.zeros(len(x), np.int64), np.full(len(x), len(v))
        at = np.minimum(np.searchsorted(v, x), len(v) - 1)
        assert (e.find(x, first, end) == np.where(v[at] == x, at, -1)).all()
    assert sum(decoded) == len(v)


def test_trigrams_look_for_a_context_once(monkeypatch):
    rng = np.random.default_rng(3)
    rows = np.unique(rng.integers(0, 12, (3_000, 3)), axis=0)  # w2, w1, w3 in order
    known = rng.random(len(rows)) < 0.6
    trie, *_ = ngram.trigram_trie(rows[known, 1], rows[known, 0], rows[known, 2], np.ones(known.sum(), np.int64))
    asked, find = [], trie.contexts.find
    monkeypatch.setattr(trie.contexts, "find", lambda of, x: asked.append(len(of)) or find(of, x))
    p, leave = Trie.trigrams(trie, rows[:, 1], rows[:, 0], rows[:, 2])
    assert ((p != 65_535) == known).all() and asked == [len(np.unique(rows[:, :2], axis=0))]
    contexts = {tuple(r) for r in rows[known, :2].tolist()}
    assert [x != 65_535 for x in leave] == [tuple(r) in contexts for r in rows[:, :2].tolist()]
