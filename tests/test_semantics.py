"""Golden cases, metamorphic checks and edge cases of the operators."""

import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import decisions as D
from tidemark.functions import parsing as P
from tidemark.functions import routing as R
from tidemark.functions import text as T
from tidemark.operators.joins import as_of, interval_join, similar_sets, upsert
from tidemark.plans import filters
from tidemark.plans.aggregates import aggregate_events
from tidemark.plans.forecasting import event_features, folds, labels, leaks, price_features, trailing_sigma, walk_forward
from tidemark.plans.sorts import greedy_titles, streaks
from tidemark.sources import feeds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_routing_polarity(spark):
    rows = [("conflict", "Ukraine", ["ukraine-war"], ["war"], -0.5, None), ("conflict", "Ukraine", [], ["war"], 0.62, 1.0), ("political", "Moscow, Russia", [], [], None, None), ("general", "", [], [], None, None)]
    df = spark.createDataFrame(rows, "category string, location_name string, topic_slugs array<string>, sub_categories array<string>, route_sentiment double, intensity double")
    got = [(r.category, r.symbol, round(r.weight, 4)) for r in R.route(df).collect()]
    assert ("conflict", "GC=F", round(1.0 * 0.8 * 0.85 * 0.75, 4)) in got  # a haven rises on bad news
    assert ("conflict", "GC=F", -round(1.0 * 0.8 * 0.85 * 0.31, 4)) in got  # good conflict news is halved
    assert ("political", "SPY", round(0.6 * 0.7 * 1.0 * 0.5, 4)) in got  # `us` stands in russia
    assert not [g for g in got if g[0] == "general"]


def test_tokens_and_jaccard(spark):
    assert one(spark, F.array_sort(T.tokens(F.lit("The Ukraine-deal: a deal of 20 US")))) == ["deal", "ukraine"]
    assert one(spark, T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []


def test_junk_and_paywall(spark):
    assert one(spark, T.is_junk_article(F.lit("Subscribe to read"), F.lit("http://x.example/a/b")))
    assert one(spark, T.is_non_article_url(F.lit("https://x.example/tag/oil?x=1")))
    assert not one(spark, T.is_non_article_url(F.lit("https://x.example/2024/oil-price")))
    assert one(spark, T.is_paywall(F.lit("Subscribe to unlock this article. Try unlimited access")))
    assert not one(spark, T.is_paywall(F.lit("word " * 300 + "Already a subscriber")))


def test_summary_and_citations(spark):
    assert one(spark, T.summary(F.lit("One.  Two!\nThree? Four."))) == "One. Two! Three?"
    assert one(spark, T.strip_citations(F.lit("Rain falls (Reuters) (AP) "))) == "Rain falls"


def test_parsing(spark):
    assert str(one(spark, P.approximate_date(F.lit("March 2025")))) == "2025-03-01"
    assert one(spark, P.approximate_date(F.lit("soon"))) is None
    assert one(spark, P.notice_time(F.lit("PERM"))) is None
    assert one(spark, P.nice_max(F.lit(37.0))) == 50.0
    assert one(spark, P.js_round(F.lit(-2.5))) == -2


def test_as_of_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "b", 9), (4, "a", 1)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 5, "y"), ("a", 2, "w"), ("a", None, "z")], "k string, t int, v string")
    got = {r.id: r.v for r in as_of(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert got == {1: "y", 2: None, 3: None, 4: None}
    strict = {r.id: r.v for r in as_of(left, right, ["k"], "t", "t", ["v"], strict=True).collect()}
    assert strict[1] == "w"


def test_interval_join_equals_brute_force(spark):
    points, spans = [(i, (i * 37) % 101) for i in range(60)], [(i, (i * 13) % 90, (i * 13) % 90 + i % 25) for i in range(40)]
    got = interval_join(spark.createDataFrame(points, "p int, at int"), spark.createDataFrame(spans, "s int, lo int, hi int"), "at", "lo", "hi", 10)
    assert {(r.p, r.s) for r in got.collect()} == {(p, s) for p, at in points for s, lo, hi in spans if lo <= at <= hi}


def test_upsert_keeps_created_columns(spark):
    current = spark.createDataFrame([("k", 1, "old")], "k string, v int, created string")
    incoming = spark.createDataFrame([("k", 2, "new"), ("k", 3, "newer"), ("n", 4, "n")], "k string, v int, created string")
    got = {r.k: (r.v, r.created) for r in upsert(current, incoming, ["k"], F.col("v"), ["created"]).collect()}
    assert got == {"k": (3, "old"), "n": (4, "n")}


def _bars(spark, n=60):
    return spark.createDataFrame([("s", i * 86400, 100.0 + (i * 7) % 13, float(i % 5)) for i in range(n)], "symbol string, t long, close double, volume double")


def test_future_events_change_nothing(spark):
    routed = "symbol string, s long, weight double, finbert double, sentiment double, category string, topics array<string>"
    past = [("s", 10 * 86400 + 5, 0.5, 0.1, None, "conflict", ["crypto"]), ("s", 12 * 86400, -0.25, None, 0.5, "economic", [])]
    as_of_day = 13 * 86400
    rows = lambda ev: [tuple(r) for r in event_features(_bars(spark), spark.createDataFrame(ev, routed), at="t").where(f"t <= {as_of_day}").orderBy("t").collect()]
    assert rows(past) == rows([*past, ("s", as_of_day + 1, 0.9, 0.9, 0.9, "conflict", ["crypto"])])


def test_features_and_labels(spark):
    f = price_features(_bars(spark), at="t").join(labels(_bars(spark), (1,), at="t"), ["symbol", "t"]).orderBy("t").collect()
    assert f[0].ret_1d == 0.0 and f[5].rsi_14 == 0.5 and f[-1].y_ret_1 is None
    assert f[30].ret_5d == pytest.approx(f[30].close / f[25].close - 1)
    assert {r.y_dir_1 for r in f[:-1]} <= {0, 1}


def test_volume_z_of_sparse_volumes(spark):
    rows = [("s", i, 100.0 + i % 7, float(i % 9) if i % 40 == 3 else None) for i in range(1_200)]
    got = {r.t: r.vol_z for r in price_features(spark.createDataFrame(rows, "symbol string, t long, close double, volume double"), at="t").collect()}
    for t in (2, 3, 90, 250, 700, 850, 1_199):
        v = [x for _, i, _, x in rows if i <= t and x is not None][-20:]
        assert got[t] == pytest.approx((v[-1] - statistics.mean(v)) / statistics.stdev(v) if len(v) > 2 else 0.0)


def test_sigma_needs_twenty_returns(spark):
    s = trailing_sigma(_bars(spark), at="t").orderBy("t").collect()
    assert s[20].sigma is None and s[21].sigma is not None


def test_folds_do_not_leak(spark):
    f = folds(spark.createDataFrame([(i,) for i in range(100)], "t int"), "t", 20, 90, 10, 30)
    assert leaks(f, "t").count() == 0
    assert f.where("role = 'test'").count() == f.where("role = 'test'").select("t").distinct().count()


def test_greedy_filter_is_not_a_self_join(spark):
    rows = [(1, "k", "alpha beta gamma delta"), (2, "k", "alpha beta gamma delta epsilon"), (3, "k", "beta gamma delta epsilon"), (4, "k", ""), (5, "k", "")]
    got = greedy_titles(spark.createDataFrame(rows, "id int, k string, title string").withColumn("t", F.col("id")), "k", "title", "t", "id", 0.75)
    # 2 falls to 1 and so can't suppress 3; empty titles stay.
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 5]


def test_greedy_titles_equal_brute_force(spark):
    """Two keys, a short memory, and pauses after which all is forgotten."""
    rng = random.Random(3)
    rows, t = [], 0
    for i in range(400):
        t += rng.choice([10, 20, 30, 120])
        rows.append((i, rng.choice("ab"), " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) for _ in range(rng.randint(0, 5))), t))
    expected, state = [], {}
    for i, k, title, t in rows:
        last, kept = state.get(k, (None, []))
        if last is not None and t - last > 100:
            last, kept = None, []
        s = set(title.split())
        if not any(len(s & o) >= 0.75 * len(s | o) for o in kept if s):
            expected.append(i)
            if s:
                last, kept = t, [*kept, s][-4:]
        state[k] = last, kept
    got = greedy_titles(spark.createDataFrame(rows, "id int, k string, title string, t int"), "k", "title", "t", "id", 0.75, 4, 100)
    assert sorted(r.id for r in got.collect()) == expected


def test_as_of_over_blocks(spark):
    """Blocks without a right row, before all of them, ties, strictness, null times and keys, by brute force."""
    rng = random.Random(4)
    right = [(rng.choice("ab"), rng.randrange(0, 1_000) if rng.random() > 0.05 else None, i) for i in range(60)]
    left = [(rng.choice("abc"), rng.randrange(-100, 1_300) if rng.random() > 0.05 else None, i) for i in range(300)]
    r, l = spark.createDataFrame(right, "k string, t long, v int"), spark.createDataFrame(left, "k string, at long, id int")  # noqa: E741
    for strict in (False, True):
        got = {x.id: x.v for x in as_of(l, r, ["k"], "at", "t", ["v"], strict, width=50).collect()}
        for k, at, i in left:
            before = [(t, v) for q, t, v in right if q == k and t is not None and at is not None and (t < at if strict else t <= at)]
            assert got[i] == (max(before)[1] if before else None)
        assert len(got) == len(left)


def test_similar_sets_equal_brute_force(spark):
    rng = random.Random(5)
    sets = [(i, sorted({rng.choice("abcdefghijkl") * 3 for _ in range(rng.randint(0, 7))})) for i in range(120)]
    for num, den in ((1, 2), (3, 4)):
        got = {(r.a, r.b) for r in similar_sets(spark.createDataFrame(sets, "id int, tokens array<string>"), "id", "tokens", num, den).collect()}
        assert got == {(i, j) for i, a in sets for j, b in sets if i < j and a and b and den * len(set(a) & set(b)) >= num * len(set(a) | set(b))}


def greedy_communities(vectors, threshold):
    """The sequential algorithm: candidate communities by size, each taking what is left."""
    x = np.array(vectors)
    x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    near = x @ x.T >= threshold
    taken, out = set(), {}
    for centre in sorted(range(len(x)), key=lambda i: -near[i].sum()):
        for i in np.flatnonzero(near[centre]).tolist():
            if i not in taken:
                taken.add(i)
                out[i] = centre
    return {i: out.get(i, i) for i in range(len(x))}


@pytest.mark.parametrize("block_rows", [1_024, 16])
def test_communities_equal_the_sequential_algorithm(spark, monkeypatch, block_rows):
    """Overlapping communities of equal sizes, copies, a zero and a null vector, two buckets; small blocks cut a bucket."""
    from tidemark.operators import vectors as V

    monkeypatch.setattr(V, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(7)
    vectors = [[math.cos(a / 10), math.sin(a / 10), 0.0] for a in rng.integers(0, 60, 120).tolist()] + [[0.0, 0.0, 0.0]] + rng.standard_normal((80, 3)).tolist()
    rows = [(i, 0, v) for i, v in enumerate(vectors)] + [(1_000 + i, 1, v) for i, v in enumerate(vectors[:50])] + [(5_000, 0, None), (5_001, None, [1.0, 0.0, 0.0])]
    got = {r.id: r.community for r in V.communities(spark.createDataFrame(rows, "id long, bucket int, vector array<double>"), 0.9).collect()}
    expected = greedy_communities(vectors, 0.9) | {1_000 + i: 1_000 + c for i, c in greedy_communities(vectors[:50], 0.9).items()} | {5_000: 5_000, 5_001: 5_001}
    assert got == expected and len({c for c in got.values()}) > 5


def test_body_of_pages(spark):
    pages = [
        "<p>" + "A long sentence of the story, told in full. " * 3 + "</p><nav><p>Home and a menu that is long enough to pass.</p></nav><p>Menu</p>",
        "<header><p>Head lines of the site, and more of them.</p></header><article><p>First part of it, a real sentence.</p><p><a href='x'>Only links here</a></p></article><p>After the article, not its text.</p>",
        "<div class='sidebar wide'><p>Side matter that should be dropped from it.</p></div><p>The body itself stays here.</p>",
        "<p>Subscribe to read the rest of this story today.</p>", "", None, "<p>" + "Word after word. " * 400 + "</p>",
    ]
    got = [r.b for r in spark.createDataFrame(list(enumerate(pages)), "i int, html string").select("i", D.body_of(F.col("html")).alias("b")).orderBy("i").collect()]
    assert got[0] == ("A long sentence of the story, told in full. " * 3).strip() and got[1] == "First part of it, a real sentence." and got[2] == "The body itself stays here."
    assert got[3:6] == [None] * 3 and len(got[6]) == 4_000


def test_streaks(spark):
    rows = [("a", i, e) for i, e in enumerate([True, True, False, True, True, True])]
    got = {(r["first"], r.length) for r in streaks(spark.createDataFrame(rows, "k string, t int, e boolean"), "k", "t", "e").collect()}
    assert got == {(0, 2), (3, 3)}


def test_filters(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, is_deleted boolean")
    assert {r.id for r in filters.alive(df).collect()} == {2, 3}
    assert filters.tri_state(df, "is_deleted", "all").count() == 3
    assert filters.capped("x", 100, 500) == 100 and filters.capped("900", 100, 500) == 500
    with pytest.raises(ValueError):
        filters.window_pair(1, None)


def test_aggregation_of_nothing_and_ties(spark):
    schema = "id long, source_code string, title string, published_s long, city string, country string, category string, sentiment double, intensity double, cluster long, finbert double, latitude double, longitude double"
    assert aggregate_events(spark.createDataFrame([], schema)).count() == 0
    rows = [(2, "b", "t", 10, "X", "Y", None, None, 0.5, 0, None, 1.0, None), (1, "a", "t", 20, "X", "Y", "general", 0.25, 0.5, 0, 0.5, 2.0, None), (3, "a", "t", 5, None, "Y", None, None, None, 0, None, None, None)]
    e = aggregate_events(spark.createDataFrame(rows, schema)).collect()
    assert len(e) == 1 and (e[0].representative, e[0].article_count, e[0].sources) == (1, 2, "a,b")
    assert (e[0].title, e[0].latitude, e[0].longitude, e[0].avg_finbert) == ("t", 1.5, None, 0.5)
    assert e[0].intensity == pytest.approx(0.56)


def test_unknown_reader():
    with pytest.raises(ValueError):
        feeds.reader("telegraph")


def test_model_is_judged_on_later_rows(spark):
    """A direction that one feature tells: held-out rows only, each once, after the rows of their fit."""
    rng = random.Random(7)
    rows = [("s", t, x := rng.gauss(0, 1), rng.gauss(0, 1), int(x + rng.gauss(0, 0.3) > 0)) for t in range(600)]
    frame = spark.createDataFrame(rows, "symbol string, t long, a double, b double, y int")
    p = walk_forward(frame, ["a", "b"], "y", [200, 300, 400, 500], 200, trees=3).collect()
    assert sorted(r.t for r in p) == list(range(201, 501)) and all(r.origin < r.t <= r.origin + 100 for r in p)
    assert sum((r.p > 0.5) == r.y for r in p) / len(p) > 0.85
    assert walk_forward(frame.where("y = 1"), ["a"], "y", [200, 300], 100).count() == 0


def test_summary_by_brute_force(spark):
    texts = ["One. Two! Three? Four.", "A" * 400 + ". Next.", "", None, "no end", "First sentence here.  Second  one.\nThird " + "x" * 340 + ". Fourth.", "a.b c. d"]

    def expected(text):
        parts = re.split(r"(?<=[.!?])\s+", re.sub(r"\s+", " ", text or "").strip())[:3]
        out = ""
        for s in parts:
            if out and len(out) + len(s) + 1 > 350:
                break
            out = f"{out} {s}".strip()
        return out[:350]

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.summary(F.col("t")).alias("s")).orderBy("i")
    assert [r.s for r in df.collect()] == [expected(t) for t in texts]


def test_training_frame_by_brute_force(spark, sf):
    """Features of some bars of the tables, each worked out from the raw rows before it."""
    import tidemark.plans  # noqa: F401
    from tidemark.adapters import load
    from tidemark.plans.forecasting import routed_hours
    from tidemark.registry import QUERIES

    bars, events = {}, [r for r in routed_hours(spark, sf).collect() if r.weight]
    for r in load(spark, sf, "hours").collect():
        bars.setdefault(r.symbol, []).append((r.t, r.close))
    frame = QUERIES["w13_training_frame"](spark, sf).collect()
    assert len(frame) == sum(max(0, len(b) - 25 - 5) for b in bars.values())
    for r in random.Random(8).sample(frame, 40):
        at = sorted(bars[r.symbol])
        i = [t for t, _ in at].index(r.t)
        near = [e for e in events if e.symbol == r.symbol and r.t - 7 * 86_400 <= e.s <= r.t]
        days = lambda n: [e for e in near if r.t - e.s <= n * 86_400]  # noqa: B023, E731
        assert r.ret_5d == pytest.approx(at[i][1] / at[i - 5][1] - 1) and r.y_ret_5 == pytest.approx(at[i + 5][1] / at[i][1] - 1) and r.pos == i
        for n in (1, 3, 7):
            assert r[f"evw_sum_{n}d"] == pytest.approx(sum(e.weight for e in days(n))) and r[f"evw_cnt_{n}d"] == len(days(n))
            assert r[f"evw_maxabs_{n}d"] == max((abs(e.weight) for e in days(n)), default=0)
        assert r.evw_decay_7d == pytest.approx(sum(e.weight * math.exp(-(r.t - e.s) / 86_400 / 3) for e in near))
        scores = [e.finbert for e in days(3) if e.finbert is not None]
        assert r.news_finbert_mean == pytest.approx(sum(scores) / len(scores) if scores else 0) and r.news_finbert_min == min(scores, default=0)
        assert r.cat_conflict == sum(e.category == "conflict" for e in days(3)) and r.topic_crypto == any("crypto" in e.topics for e in near)
        assert r[f"sym_{r.symbol}"] == 1 and sum(r[f"sym_{s}"] for s in bars) == 1
