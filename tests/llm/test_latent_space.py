"""The latent spaces of decontamination are fitted on all passages of all texts."""

import random

import numpy as np
import pyarrow as pa

from tidemark.llm import decontamination as D


def test_products_of_all_texts_equal_brute_force(spark, monkeypatch):
    """Two blocks with common terms, null, empty and repeated texts, over more documents than any former sample took."""
    rng = random.Random(3)
    some = [" ".join(rng.choice("ab cd ef gh ij kl mn op".split()) for _ in range(rng.choice((0, 3, 48, 60, 130)))) for _ in range(40)]
    texts = [some[k % 40] for k in range(6_000)] + [None]
    hashes = {w: h for w in "ab cd ef gh ij".split() for _, _, (h,), _ in D._words(pa.array([w]))}
    vocabulary = np.sort(np.array(list(hashes.values()), np.uint64))
    at = {w: int(np.searchsorted(vocabulary, h)) for w, h in hashes.items()}
    owns = [np.array([0, 1, 2, -1, -1], np.int32), np.array([-1, 0, -1, 1, 2], np.int32)]
    want, windows = [np.zeros((3, 3), int) for _ in owns], 0
    for text in some:
        words = text.split()
        starts = [*range(0, max(len(words) - D.WINDOW, 0), D.STRIDE), max(len(words) - D.WINDOW, 0)] if words else []
        starts = [k * D.STRIDE for k in range(len(starts))]
        windows += 150 * len(starts)
        for s in starts:
            for own, sums in zip(owns, want):
                c = np.zeros(3, int)
                for w in words[s : s + D.WINDOW]:
                    if w in at and own[at[w]] >= 0:
                        c[own[at[w]]] += 1
                sums += 150 * np.outer(c, c)
    monkeypatch.setattr(D, "SORTED_PAIRS", 1 << 12)
    rows, n = D.products(spark.createDataFrame([(t,) for t in texts], "text string"), vocabulary, owns)
    got = [np.zeros((3, 3), int) for _ in owns]
    for r in rows.collect():
        got[r.block][r.i, r.j] += r.n
    assert n == windows
    assert all((g == w).all() for g, w in zip(got, want))


def test_leading_vectors_equal_exact_ones(spark):
    rng = np.random.default_rng(2)
    a = rng.poisson(0.3, (400, 300)) + np.outer(rng.poisson(2, 400), np.arange(300) < 30) + np.outer(rng.poisson(3, 400), np.arange(300) > 280)
    weight, more = rng.uniform(1, 3, 300), np.zeros((1, 300))
    g = a.T @ a
    rows = spark.createDataFrame([(i, j, int(g[i, j])) for i in range(300) for j in range(300) if g[i, j]], "i int, j int, n long")
    q = D.randomised_svd(rows, weight, 16, more, passes=4)
    exact = np.linalg.svd(a * weight)[2][:2]
    assert np.linalg.norm(exact @ q, axis=1).min() > 0.999
