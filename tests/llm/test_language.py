"""Spelling variants, language-model scores and vector codes against brute force; edge cases of each."""

import collections
import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import eliasfano, exponion, ngram, spelling
from tidemark.llm.common import table


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, an empty and a long text, repeated rows, and columns with names that operators add."""
    rows = [(1, None), (2, ""), (None, "tidings Tidings tidinge"), (3, "tidings tidingsx " * 5_000), (4, "eeeeeeee eeeeeeeee " * 9), (4, "eeeeeeee eeeeeeeee " * 9), (5, "\x0b \x1c ? é")]
    extra = {c: F.lit(c) for c in ("word", "n", "id", "train", "block", "score", "a.b")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra)


def near_pairs(words):
    one = lambda a, b: a != b and (sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b)))))
    return {(a, b) for a in words for b in words if abs(len(a) - len(b)) <= 1 and one(a, b)}


@pytest.mark.parametrize("block_rows", [4_096, 7])
def test_near_words_by_brute_force(spark, monkeypatch, block_rows):
    """Few letters, so that grams repeat inside words and every list is long; small blocks cut the lists."""
    monkeypatch.setattr(spelling, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(spelling, "BUCKET_ROWS", 500)
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abé"), size=n)) for n in rng.integers(6, 10, 300)} | {"a" * n for n in range(6, 14)} | {"ab" * n for n in range(3, 9)} | {"𝒶" * 7, "𝒶" * 6}
    frame = spark.createDataFrame([(w, 1 + i) for i, w in enumerate(sorted(words))], "word string, n long")
    found = [(r.word, r.near) for r in spelling.near_words(frame).collect()]
    assert len(found) == len(set(found)) and set(found) == near_pairs(words)


def test_forms_and_roots(spark):
    words = {"abcdef": 5_000, "abcdeg": 1_000, "abcdxg": 200, "abcyxg": 40, "abzyxg": 8, "abcdefg": 1_000, "qwerty": 9, "qwertz": 9, "zzzzzz": 7}
    got = {r.word: r for r in spelling.with_forms(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(got) == set(words)
    assert [got[w].form for w in ("abcdef", "abcdeg", "abcdxg", "abcyxg", "abzyxg", "abcdefg")] == [None, "abcdef", "abcdeg", "abcdxg", "abcyxg", "abcdef"]
    assert {got[w].root for w in ("abcdef", "abcdeg", "abcdxg", "abcyxg", "abzyxg", "abcdefg")} == {"abcdef"}
    assert (got["qwerty"].form, got["qwerty"].n_near, got["zzzzzz"].n_near, got["zzzzzz"].root, got["abcdeg"].form_n) == (None, 1, 0, "zzzzzz", 5_000)


def test_spelling_edges(spark, odd):
    got = {r.word: r for r in spelling.variants(odd).collect()}
    assert {"tidings", "tidingsx", "eeeeeeee", "eeeeeeeee"} <= set(got)
    assert got["eeeeeeee"].n == 18 and got["eeeeeeee"].n_near == 1 and got["tidings"].n_near >= 1
    assert spelling.variants(odd.limit(0)).count() == 0
    run = "abcdefgh"
    hit = next(i for i in itertools.count() if zlib.crc32(f"{i}:{run}".encode()) % 199 == 0)
    at = zlib.crc32(f"{hit}:{run}".encode()) % len(run)
    row = spark.createDataFrame([(hit, run), (hit + 1, run)], "d long, r string").select(spelling.slips(F.col("d"), F.col("r")).alias("w")).collect()
    assert [r.w for r in row] == [run[:at] + run[at + 1 :], run]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 0), (5, 3), (1_000, 50), (1_000, 10**12), (3_000, 3_000)):
        v = np.sort(rng.integers(0, top + 1, n))
        e = eliasfano.EliasFano.of(v)
        assert n == 0 or (e[np.arange(n)] == v).all()
        x = np.concatenate([v, rng.integers(0, top + 2, 200)])
        got = e.find(x, np.zeros(len(x), np.int64), np.full(len(x), n))
        first = np.searchsorted(v, x)
        expected = np.where((first < n) & (np.append(v, -1)[np.minimum(first, n)] == x), first, -1)
        assert (got == expected).all()
    assert sum(a.nbytes for a in eliasfano.EliasFano.of(np.arange(100_000) * 3).arrays()) < 100_000


def scores(rows, held_out):
    """Witten-Bell trigrams with dictionaries."""
    texts = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    train = [t for i, t in texts if not held_out(i)]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    pairs, grams = collections.Counter(), collections.Counter()
    for t in train:
        q = [0, 0, *t]
        grams.update(zip(q, q[1:], q[2:]))
    for (_, y, z), k in grams.items():
        pairs[y, z] += k
    total, kinds = collections.Counter(), collections.Counter()
    for table_ in (pairs, grams):
        for gram, k in table_.items():
            total[gram[:-1]] += k
            kinds[gram[:-1]] += 1
    for i, t in texts:
        base = score = 0.0
        q = [0, 0, *t]
        for x, y, z in zip(q, q[1:], q[2:]):
            p = (c[z] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for h, of in (((y,), pairs[y, z]), ((x, y), grams[x, y, z])):
                p = (of + kinds[h] * p) / (total[h] + kinds[h]) if total[h] else p
            score += math.log10(p)
        yield i, (held_out(i), len(t), sum(c[z] > 0 for z in t), n), base, score


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 700, "shard_grams": 60}])
def test_scores_by_brute_force(spark, sf, sizes):
    """One shard, and shards so small that many words and pairs of words are split."""
    docs = table(spark, sf, "documents")
    held_out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 != 1
    got = {r.id: r for r in ngram.score(docs, train, **sizes).collect()}
    gain = 0.0
    for i, counts, base, score in scores([(r.doc_id, r.text) for r in docs.collect()], held_out):
        r = got.pop(i)
        assert (not r.train, r.n_tokens, r.n_known, r.train_tokens) == counts
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) <= 1.5 / eliasfano.STEPS * r.n_tokens
        gain += (score - base) * counts[0]
    assert not got and gain > 0


def test_probabilities_add_up(spark):
    """Over all words and the unknown one, after a known pair, a known word and an unknown one."""
    rows = [(0, "a b c a b d a b c e f a b"), (1, "b c d b c a")]
    vocabulary = list("abcdef")
    contexts = ["a b", "f b", "zz b", "zz zz"]
    asked = [(100 + i, f"{h} {w}") for i, (h, w) in enumerate(itertools.product(contexts, [*vocabulary, "unknown"]))]
    ends = [(1_000 + i, h) for i, h in enumerate(contexts)]
    docs = spark.createDataFrame(rows + asked + ends, "doc_id long, text string")
    got = {r.id: r.score for r in ngram.score(docs, F.col("doc_id") < 2).collect()}
    expected = {i: s for i, _, _, s in scores(rows + asked + ends, lambda i: i >= 2)}
    assert all(abs(got[i] - expected[i]) < 0.005 for i in got)


def test_score_edges(spark, odd):
    out = ngram.score(odd, F.col("doc_id") == 3).collect()
    assert len(out) == odd.count() and {r.train_tokens for r in out} == {10_001}
    assert [r.n_tokens for r in sorted(out, key=lambda r: (r.id is None, r.id or 0))] == [1, 1, 10_001, 19, 19, 4, 4]
    none = ngram.score(odd, F.lit(None).cast("boolean")).collect()
    assert all(r.score == pytest.approx(r.base_score, abs=r.n_tokens / eliasfano.STEPS) and r.n_known == 0 for r in none)
    assert ngram.score(odd.limit(0), F.lit(True)).count() == 0


def test_exponion_equals_a_full_scan():
    rng = np.random.default_rng(2)
    for spread in (3, 300):
        book = rng.integers(-spread, spread, (64, 4))
        book[10] = book[50] = book[20]  # ties go to the lower index
        x = rng.integers(-spread, spread, (2_000, 4))
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        best, least = exponion.nearest(x, book, exponion.neighbours(book), rng.integers(0, 64, 2_000))
        assert (best == d.argmin(1)).all() and (least == d.min(1)).all()


def test_vector_code_edges(spark):
    rows = [(1, [1.0, 2.0, None], 0), (2, None, 0), (3, [float("nan")], 0), (4, [float("inf")], 0), (5, [], None), (6, [0.5] * 20, None), (6, [0.25] * 16, 7), (None, [-0.1] * 16, 7)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"codes": F.lit("c"), "q": F.lit(1)})
    out, books = exponion.compress(vectors)
    got = out.collect()
    assert sorted((r.id is None, r.id or 0) for r in got) == [(False, 5), (False, 6), (False, 6), (True, 0)]
    assert books.shape == (16, 4, 2) and all(r.error == 0 for r in got)  # as many entries as rows, each its own
    assert [bytes(r.codes)[0] for r in got if r.id == 5] == [0]
    empty, none = exponion.compress(vectors.limit(0))
    assert empty.count() == 0 and none.size == 0
    with pytest.raises(Exception, match="too large"):
        exponion.compress(spark.createDataFrame([(1, [1e9] * 16, 0)], "vec_id long, embedding array<float>, label int"))
