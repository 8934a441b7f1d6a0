"""Quantiles, ranks and matches of large groups against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks as R
from tidemark.operators import vectors as V


def quantile(values, p):
    v = sorted(values)
    at = (len(v) - 1) * p
    k = math.floor(at)
    return v[k] + (v[min(k + 1, len(v) - 1)] - v[k]) * (at - k) if at > k else v[k]


@pytest.mark.parametrize("bins", [1_024, 4])
def test_exact_quantiles(spark, monkeypatch, bins):
    """One group of all rows with distinct values, equal values, values of all magnitudes and both signs, infinities."""
    monkeypatch.setattr(R, "BINS", bins)
    rng = random.Random(1)
    groups = {
        "distinct": [rng.random() for _ in range(2_000)],
        "equal": [7.0] * 300,
        "few": [float(rng.randrange(4)) for _ in range(500)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(400)] + [0.0] * 5,
        "near": [1e9 + k * 1e-6 for k in range(300)],
        "ends": [float("inf"), -float("inf"), 1.0, 2.0, 3.0, float("inf")] * 4,
        "one": [-3.5],
        None: [2.0, 1.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    probs = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    out = R.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), "g", "x", probs)
    assert "percentile" not in out._jdf.queryExecution().toString()
    got = {r.g: r for r in out.collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        for i, p in enumerate(probs):
            expected = quantile(values, p)
            assert got[g][f"q{i}"] == pytest.approx(expected, rel=1e-12) or (math.isnan(expected) and math.isnan(got[g][f"q{i}"]))


def test_ordinal_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 3]), i) for i in range(1_000)]
    ranked = R.ordinal_ranks(spark.createDataFrame(rows, "k string, v int, id int").repartition(7), "k", ["v", "id"], "place")
    got = {r.id: r.place for r in ranked.collect()}
    for k in ("a", "b", None):
        ordered = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in ordered] == list(range(1, len(ordered) + 1))


def test_one_group_is_spread(spark):
    """All rows in one category: sorted by several tasks, without a window over them."""
    rows = spark.range(50_000).select(F.lit("all").alias("k"), (F.col("id") * 7919 % 50_000).alias("v"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = R.ordinal_ranks(rows, "k", ["v", "id"], "place")
        assert out.where("place <> v + 1").isEmpty() and out.select("_part" if "_part" in out.columns else F.spark_partition_id()).distinct().count() > 1
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_best_matches(spark, monkeypatch):
    """Both sides in several blocks; ties to the smaller key; vectors that match nothing."""
    monkeypatch.setattr(V, "MATCH_ROWS", 16)
    rng = np.random.default_rng(4)
    left = [(i, v) for i, v in enumerate(rng.integers(-2, 3, (60, 3)).astype(float).tolist())] + [(100, None), (101, [0.0, 0.0, 0.0])]
    right = [(f"k{i:02}", v) for i, v in enumerate(rng.integers(-2, 3, (50, 3)).astype(float).tolist())]
    got = {r.id: r for r in V.best_matches(spark.createDataFrame(left, "id int, vector array<double>"), spark.createDataFrame(right, "key string, vector array<double>"), 0.51, general="k07").collect()}
    assert set(got) == {i for i, _ in left}

    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return None if n == 0 else round(float((a / np.linalg.norm(a)) @ (b / np.linalg.norm(b))), 12)

    for i, v in left:
        scores = [(c, k) for k, w in right if v is not None and (c := cosine(v, w)) is not None]
        if not scores:
            assert (got[i].best, got[i].score, got[i].specific, got[i].matches) == (None, None, None, 0)
            continue
        top = max(c for c, _ in scores)
        assert got[i].score == pytest.approx(top) and got[i].best in {k for c, k in scores if c > top - 1e-9}
        specific = max(c for c, k in scores if k != "k07")
        assert got[i].specific_score == pytest.approx(specific) and got[i].specific != "k07"
        assert got[i].matches == sum(c >= 0.51 for c, _ in scores)
    same = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0])], "key string, vector array<double>")
    assert [r.best for r in V.best_matches(spark.createDataFrame([(1, [3.0, 0.0])], "id int, vector array<double>"), same, 0.5).collect()] == ["a"]
