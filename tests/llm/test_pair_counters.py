"""Pairs of frequent words have a counter each in a task, so a key goes out once, and little is held besides."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.llm import decontamination as D


def _vocabulary(n):
    hashes = np.array([h for k in range(n) for _, _, (h,), _ in D._words(pa.array([f"w{k}"]))], np.uint64)
    return np.sort(hashes), np.argsort(np.argsort(hashes))


def _squares(texts, at, own, n):
    """Sums of products of counts over the windows of all texts, i <= j, by brute force."""
    want = np.zeros((n, n), np.int64)
    for words in texts:
        term = np.array([own[at[k]] for k in words], np.int64)
        for s in range(0, max(len(term) - D.WINDOW, 0) + D.STRIDE, D.STRIDE) if len(term) else ():
            if s and s + D.STRIDE >= len(term):
                break
            some = term[s : s + D.WINDOW]
            c = np.bincount(some[some >= 0], minlength=n)
            want += np.outer(c, c)
    return np.triu(want)


def _given(count, texts):
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{k}" for k in words) for words in texts])], ["text"])
    rows = [r for b in count(iter([batch])) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    return [r for r in rows if r[0] >= 0], sum(n for k, n in rows if k < 0)


def test_a_pair_of_frequent_words_is_given_out_once(monkeypatch):
    """However few pairs may be held in all; before, every fold of them gave its keys again."""
    monkeypatch.setattr(D, "SORTED_PAIRS", 1 << 12)
    monkeypatch.setattr(D, "HELD_PAIRS", 1 << 8)
    rng, n = np.random.default_rng(1), 60
    vocabulary, at = _vocabulary(n)
    texts = [rng.integers(0, n, k).tolist() for k in (0, 1, 23, 24, 25, 47, 48, 49, 71, 72, 73, 96, 97, 5_000)]
    rows, _ = _given(D._pair_counts(vocabulary, [np.arange(n, dtype=np.int32)]), texts)
    assert len(rows) == len({k for k, _ in rows})


def test_counts_are_those_of_brute_force_whatever_is_frequent(monkeypatch):
    """Texts around the lengths of windows and their halves, two blocks that share words, words of neither block, and
    counters for all, some and hardly any of the pairs."""
    rng, n = np.random.default_rng(2), 40
    vocabulary, at = _vocabulary(n)
    texts = [rng.zipf(1.3, k).clip(1, n) - 1 for k in (0, 1, 2, 23, 24, 25, 47, 48, 49, 50, 71, 72, 73, 95, 96, 97, 120, 121, 333)]
    owns = [np.where(np.arange(n) % 3 < 2, np.cumsum(np.arange(n) % 3 < 2) - 1, -1), np.where(np.arange(n) % 4 < 2, np.cumsum(np.arange(n) % 4 < 2) - 1, -1)]
    want = [_squares(texts, at, own, n) for own in owns]
    monkeypatch.setattr(D, "SORTED_PAIRS", 1 << 9)
    for counters in (1 << 12, 1 << 8, 1):
        monkeypatch.setattr(D, "COUNTERS", counters, raising=False)
        got = [np.zeros((n, n), np.int64) for _ in owns]
        rows, windows = _given(D._pair_counts(vocabulary, [own.astype(np.int32) for own in owns]), texts)
        for key, m in rows:
            got[key >> 40][key >> 20 & 0xFFFFF, key & 0xFFFFF] += m
        assert windows == sum(max(0, -(-(len(t) - D.WINDOW) // D.STRIDE)) + 1 for t in texts if len(t))
        assert all((g == w).all() for g, w in zip(got, want))


def test_counting_pairs_takes_little_memory():
    """Of a task over many texts, besides what it gave out."""
    rng, n = np.random.default_rng(3), 1_900
    vocabulary, _ = _vocabulary(n)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, n, 2_000)) for _ in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 10])], ["text"]) for k in range(0, 60, 10)]
    count = D._pair_counts(vocabulary, [np.arange(n, dtype=np.int32)])
    tracemalloc.start()
    given = sum(b.num_rows for b in count(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert given <= n * (n + 1) // 2 + 1
    assert peak < 28 << 20
