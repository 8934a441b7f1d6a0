"""The forecasting model and the lexicon's sentiment."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import model as M
from tidemark.operators.sentiment import Lexicon, lexicon_sentiment
from tidemark.plans.functions_ import labelled_lexicon


def market(n, seed=3):
    """Rows whose direction a noisy signal tells with a known probability."""
    rng = random.Random(seed)
    rows = []
    for t in range(n):
        x = rng.gauss(0, 1)
        up = rng.random() < 1 / (1 + math.exp(-2 * x))
        rows.append((t, f"s{t % 2}", x, rng.gauss(0, 1), int(up), (0.02 if up else -0.02) + rng.gauss(0, 0.01)))
    return rows


SCHEMA = "t long, symbol string, x double, noise double, y int, r double"


@pytest.mark.parametrize("n", [900, 300])
def test_forecaster(spark, n):
    """Isotonic and sigmoid calibration on rows that no fit saw; absent columns; the band."""
    rows = market(n + 600)
    frame = spark.createDataFrame(rows, SCHEMA)
    model = M.train(frame.where(f"t < {n}"), ["x", "noise", "sym_a"], "y", "r", ["t", "symbol"], trees=8)
    assert model.n == n and len(model.classifiers) == 3 and all(isinstance(c, M.Isotonic if n >= 500 else M.Sigmoid) for _, c in model.classifiers)
    later = [r for r in M.forecast(frame.where(f"t >= {n}").drop("noise"), model).collect()]
    truth = {r[0]: r for r in rows}
    p, y = np.array([r.proba_up for r in later]), np.array([truth[r.t][4] for r in later])
    assert len(later) == 600 and ((p >= 0) & (p <= 1)).all()
    ideal = np.array([1 / (1 + math.exp(-2 * truth[r.t][2])) for r in later])
    brier, best, base = ((p - y) ** 2).mean(), ((ideal - y) ** 2).mean(), y.mean() * (1 - y.mean())
    assert brier < best + 0.03 and brier < base - 0.03
    for lo, hi in ((0, 0.3), (0.3, 0.7), (0.7, 1.01)):  # what is said to happen so often does
        some = (p >= lo) & (p < hi)
        assert some.sum() < 40 or abs(p[some].mean() - y[some].mean()) < (0.12 if n >= 500 else 0.2)
    missed = np.array([truth[r.t][5] - r.change for r in later])
    assert 0.6 < missed.std() / model.resid_std < 1.6


def test_sigmoid_is_the_best_one(spark):
    rng = random.Random(1)
    rows = [(p := rng.random(), float(rng.random() < 1 / (1 + math.exp(3 - 6 * p)))) for _ in range(400)]
    s = M.fit_sigmoid(spark.createDataFrame(rows, "p double, y double"), "p", "y")
    up = sum(y for _, y in rows)
    t1, t0 = (up + 1) / (up + 2), 1 / (len(rows) - up + 2)
    loss = lambda a, b: -sum((t := t1 if y else t0) * math.log(q := 1 / (1 + math.exp(a * p + b))) + (1 - t) * math.log(1 - q) for p, y in rows)
    here = loss(s.a, s.b)
    assert all(here <= loss(s.a + da, s.b + db) + 1e-6 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05)) and -8 < s.a < -4
    one = M.fit_sigmoid(spark.createDataFrame([(0.5, 1.0)] * 9, "p double, y double"), "p", "y")
    assert 0.8 < 1 / (1 + math.exp(one.a * 0.5 + one.b)) < 1


def test_too_little_to_train_on(spark):
    frame = spark.createDataFrame(market(60), SCHEMA)
    for some in (frame.where("t < 40"), frame.where("y = 1"), frame.limit(0), frame.withColumn("r", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            M.train(some, ["x"], "y", "r", ["t"], trees=2)


def plain_score(text, rows):
    """The same rules once more, word by word, with what each word does looked up in a list."""
    does = lambda w: {k: v for x, k, v in rows if x == w.lower()}
    text = (text or "")[:3_000]
    words = []
    for w in text.split():
        bare = w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        words.append(w if len(bare) <= 2 else bare)
    cache = {w: does(w) for w in set(words)}
    big = [w.isupper() for w in words]
    mixed = any(big) and not all(big)
    out = []
    for i, w in enumerate(words):
        v = cache[w].get("valence") or 0
        if v == 0 or "booster" in cache[w]:
            out.append(0)
            continue
        sign = 1 if v > 0 else -1
        if mixed and big[i]:
            v += 0.733 * sign
        for back in (1, 2, 3):
            if i - back < 0 or "valence" in cache[words[i - back]]:
                continue
            e = words[i - back]
            if "booster" in cache[e]:
                s = 0.293 * cache[e]["booster"] * (1 if v >= 0 else -1)
                if mixed and e.isupper():
                    s += 0.733 if v >= 0 else -0.733
                v += s * {1: 1, 2: 0.95, 3: 0.9}[back]
            if "negation" in cache[e]:
                v = v * -0.74
        out.append(v)
    for i, w in enumerate(words):
        if "contrast" in cache[w]:
            out = [0.5 * v for v in out[:i]] + out[i : i + 1] + [1.5 * v for v in out[i + 1 :]]
            break
    s = sum(out)
    q = text.count("?")
    emphasis = min(text.count("!"), 4) * 0.292 + ({0: 0, 1: 0, 2: 0.36, 3: 0.54}.get(q, 0.96))
    s = s + emphasis if s > 0 else s - emphasis if s < 0 else 0
    return round(s / math.sqrt(s * s + 15), 4)


WORDS = [("good", "valence", 1.9), ("bad", "valence", -2.5), ("not", "negation", None), ("very", "booster", 1.0), ("barely", "booster", -1.0), ("but", "contrast", None)]


def test_rules():
    score = Lexicon(WORDS).score
    assert score("good") > 0 > score("bad") and score("not good") < 0 < score("not bad") and score("not so very good") < 0 and score("not x y z good") > 0
    assert score("very good") > score("very x good") > score("very x y good") > score("good") > score("barely good") and score("very bad") < score("bad")
    assert score("it is GOOD") > score("it is good") == score("IT IS good".lower()) and score("GOOD") == score("good")
    assert score("good but bad") < score("bad but good") and score("good!!") > score("good!") and score("good!!!!!") == score("good!!!!") and score("good??") > score("good?") == score("good")
    assert score(None) == score("") == score("nothing!") == 0 and score("x " * 3_000 + "good") == 0


def test_sentiment_equals_plain_code(spark, sf):
    lexicon = labelled_lexicon(spark, sf)
    rows = [tuple(r) for r in lexicon.collect()]
    assert {k for _, k, _ in rows} == {"valence", "negation", "booster", "contrast"}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "?! ..."), (-4, "A" * 9_000)], "doc_id long, text string"))
    of = {}
    for w, k, v in rows:
        of.setdefault(w, []).append((w, k, v))
    some = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.sentiment for r in lexicon_sentiment(docs, "text", lexicon).collect()}
    assert got.keys() == some.keys() and len({v for v in got.values()}) > 50
    for i, text in some.items():
        mine = [x for w in {p.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower() for p in (text or "")[:3_000].split()} | {p.lower() for p in (text or "")[:3_000].split()} for x in of.get(w, [])]
        assert got[i] == pytest.approx(plain_score(text, mine), abs=1e-4)
