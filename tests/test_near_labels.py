"""Labels of similar sets without pairs of them."""

import random

from tidemark.operators.joins import near_labels, similar_sets
from tidemark.plans.joins_ import corroboration


def test_equal_brute_force(spark):
    rng = random.Random(6)
    sets = list({tuple(sorted({rng.choice("abcdefghijkl") * 3 for _ in range(rng.randint(1, 8))})) for _ in range(150)})
    rows = [(i, list(s), rng.sample("pqrstuvw", rng.choice((0, 1, 1, 2)))) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, labels array<string>")
    for num, den, subset_tokens in ((1, 2, 12), (1, 2, 4), (3, 4, 12)):
        near = {i: {x for j, b, labels in rows for x in labels if den * len({*a} & {*b}) >= num * len({*a} | {*b})} for i, a, _ in rows}
        for most in (3, 9):
            got = {r.id: set(r.labels) for r in near_labels(df, "id", "tokens", "labels", num, den, most, subset_tokens).collect()}
            assert {i for i, x in near.items() if x} == set(got)
            assert all(x <= near[i] and len(x) >= min(most, len(near[i])) for i, x in got.items())
            assert most < 9 or all(x == near[i] for i, x in got.items())


def test_similar_sets_of_large_ones(spark):
    rng = random.Random(7)
    sets = [(i, sorted({rng.choice("abcdefghijkl") * 3 for _ in range(rng.randint(0, 7))})) for i in range(120)]
    got = {(r.a, r.b) for r in similar_sets(spark.createDataFrame(sets, "id int, tokens array<string>"), "id", "tokens", 1, 2, 5).collect()}
    assert got == {(i, j) for i, a in sets for j, b in sets if i < j and a and b and max(len(a), len(b)) >= 5 and 2 * len(set(a) & set(b)) >= len(set(a) | set(b))}


def test_many_similar_titles_form_no_pairs(spark):
    """1,200 titles that are all near each other: no stage may shuffle rows by the square of that."""
    n = 1_200
    rows = [(i, f"s{i % 3}", ["aaa", "bbb", "ccc", "ddd", "eee", "fff", f"w{i}"]) for i in range(n)]
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    before = {stages().apply(k).stageId() for k in range(stages().size())}
    got = corroboration(spark.createDataFrame(rows, "id long, source_code string, tokens array<string>")).collect()
    assert {(r.id, r.bonus) for r in got} == {(i, 1.0) for i in range(n)}
    found = stages()
    most = max(found.apply(k).shuffleWriteRecords() for k in range(found.size()) if found.apply(k).stageId() not in before)
    assert 0 < most < 200 * n
