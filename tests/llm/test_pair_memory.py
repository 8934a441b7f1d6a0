"""A task that counts pairs of words, or looks for items, holds little at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.llm import decontamination as D


def _batches(rng, texts, words):
    for _ in range(texts):
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{k}" for k in rng.integers(0, 1_500, words))])], ["text"])


def test_pairs_are_given_out_as_a_text_is_read():
    """Counts are those of brute force, batches are short, and a task's memory is that of a few hundred thousand pairs."""
    rng, n = np.random.default_rng(5), 1_500
    hashes = np.array([h for k in range(n) for _, _, (h,), _ in D._words(pa.array([f"w{k}"]))], np.uint64)
    vocabulary = np.sort(hashes)
    own = np.arange(n, dtype=np.int32)
    texts = [b.column(0)[0].as_py() for b in _batches(rng, 1, 40_000)]
    want = np.zeros((n, n), np.int64)
    term = np.searchsorted(vocabulary, hashes)[[int(w[1:]) for w in texts[0].split()]]
    starts = np.arange(0, len(term) - D.WINDOW + D.STRIDE, D.STRIDE)
    for s in starts:
        c = np.bincount(term[s : s + D.WINDOW], minlength=n)
        some = np.flatnonzero(c)
        want[np.ix_(some, some)] += np.outer(c[some], c[some])
    count = D._pair_counts(vocabulary, [own])
    got, windows, longest = np.zeros((n, n), np.int64), 0, 0
    tracemalloc.start()
    for batch in count(pa.RecordBatch.from_arrays([pa.array([t])], ["text"]) for t in texts):
        longest = max(longest, batch.num_rows)
        key, m = (batch.column(k).to_numpy() for k in range(2))
        windows += m[key < 0].sum()
        key, m = key[key >= 0], m[key >= 0]
        np.add.at(got, (key >> 20, key & 0xFFFFF), m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert windows == len(starts)
    assert (np.triu(want) == got).all()
    assert longest <= 1 << 16
    assert peak < got.nbytes + (48 << 20)
