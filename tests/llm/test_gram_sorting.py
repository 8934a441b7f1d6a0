"""Numbering n-grams and asking for them in little memory."""

import tracemalloc

import numpy as np

from tidemark.llm import ngram


def test_distinct_pairs_equal_unique_in_less_memory():
    rng = np.random.default_rng(1)
    for n, most in ((0, 5), (1, 1), (1_000, 40), (1_000, 2**31 - 1), (400_000, 50_000)):
        a, b = (rng.integers(0, most, n, endpoint=True).astype(np.int32) for _ in range(2))
        tracemalloc.start()
        x, y, of = ngram._distinct_pairs(a, b)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        keys, want = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
        assert (x == keys >> 32).all() and (y == (keys & 0xFFFFFFFF)).all() and (of == want).all()
        assert n < 400_000 or peak < 45 * n  # np.unique takes 57 bytes a row


def test_slices_are_asked_one_at_a_time():
    asked = []

    def look(x, y):
        asked.append(len(x))
        return x + y, x * y

    x, y = np.arange(10), np.arange(10) + 1
    total, product = ngram._sliced(look, x, y, most=4)
    assert asked == [4, 4, 2] and (total == x + y).all() and (product == x * y).all()
    assert [len(o) for o in ngram._sliced(look, x[:0], y[:0])] == [0, 0]
