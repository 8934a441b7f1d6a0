"""Streams with state: restarts, late rows, time limits; tables kept by key."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.plans.sorts import greedy_titles
from tidemark.plans.streams import fetches
from tidemark.sources import sinks
from tidemark.streaming import state as S
from tidemark.streaming import windows as W

WORDS = "talks deal war storm vote bank flood rate court strike".split()


def files_of(spark, rows, schema, folder, parts):
    """Rows written as that many files, in their order; a function that adds the next file to what a stream reads."""
    n = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * n : (k + 1) * n], schema).coalesce(1).write.parquet(f"file://{folder}/part{k}")
    return [f"file://{folder}/part{k}" for k in range(parts)]


def streamed(spark, paths, folder, schema, work, after=None):
    """Runs work over the files as they come: one run per file, each a restart on the same checkpoint."""
    import shutil

    Path(f"{folder}/in").mkdir(parents=True, exist_ok=True)
    for k, path in enumerate(paths):
        for f in Path(path.removeprefix("file://")).glob("*.parquet"):
            shutil.copy(f, f"{folder}/in/{k}-{f.name}")
        out = W.run(work(spark.readStream.schema(schema).parquet(f"file://{folder}/in")), f"file://{folder}/state")
    return out


def titles(n, seed=3):
    rng = random.Random(seed)
    return [(i, f"s{rng.randrange(3)}", " ".join(rng.sample(WORDS, 4)) if rng.random() < 0.95 else "the", 1_000_000 + 900 * i + (200_000 if i > n * 0.7 else 0)) for i in range(n)]


def test_titles_of_a_stream_with_restarts(spark, tmp_path):
    """Three runs on one checkpoint keep what one pass over the table keeps; state goes a day after the last title."""
    schema = "id long, source string, title string, at long, time timestamp"
    rows = [(*r, __import__("datetime").datetime.fromtimestamp(r[3], __import__("datetime").timezone.utc)) for r in titles(240)]
    table = spark.createDataFrame(rows, schema)
    expected = {r.id for r in greedy_titles(table, "source", "title", "at", "id").collect()}
    work = lambda s: S.kept_titles(s, ["source"], "title", "at", "id", event_time="time")
    out = streamed(spark, files_of(spark, rows, schema, tmp_path / "f", 3), tmp_path, schema, work)
    got = [r.id for r in out.collect()]
    assert sorted(got) == sorted(expected) and 10 < len(got) < 230
    again = W.run(work(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")), f"file://{tmp_path}/state")
    assert sorted(r.id for r in again.collect()) == sorted(got)


def test_kept_titles_by_brute_force(spark):
    def jaccard(a, b):
        return len(a & b) / len(a | b)

    rows = titles(300, 9)
    expected = set()
    for source in {r[1] for r in rows}:
        kept, last = [], None
        for i, _, title, at in [r for r in rows if r[1] == source]:
            if last is not None and at - last > 86_400:
                kept, last = [], None
            tokens = {w for w in title.split() if w in WORDS}
            if tokens and any(jaccard(tokens, k) >= 0.6 for k in kept[-5:]):
                continue
            expected.add(i)
            if tokens:
                kept.append(tokens)
                last = at
    got = S.kept_titles(spark.createDataFrame(rows, "id long, source string, title string, at long"), ["source"], "title", "at", "id", 0.6, memory=5)
    assert {r.id for r in got.collect()} == expected


def gate(rows):
    """The counter and the block as two dictionaries with times at which entries end."""
    counter, blocked, out = {}, {}, {}
    for i, source, outcome, at in sorted(rows, key=lambda r: (r[3], r[0])):
        n, end = counter.get(source, (0, 0))
        n = n if at < end else 0
        if at < blocked.get(source, 0):
            out[i] = (True, n)
            continue
        if outcome == "timeout":
            blocked[source] = at + 1_800
        if outcome == "ok":
            counter[source] = (n := 0, 0)
        if outcome == "empty":
            counter[source] = (n := n + 1, at + 21_600)
            if n >= 8:
                blocked[source] = at + 21_600
        out[i] = (False, n)
    return out


def test_gate_by_brute_force_and_restarts(spark, sf, tmp_path):
    rng = random.Random(5)
    rows, at = [], 1_000_000
    for i in range(400):
        at += rng.choice([60, 600, 600, 1_200, 9_000])
        rows.append((i, rng.randrange(3), rng.choices(["empty", "timeout", "ok", "failed", None], [30, 1, 1, 2, 1])[0], at))
    expected = gate(rows)
    assert any(b for b, _ in expected.values()) and max(n for _, n in expected.values()) == 8
    schema = "id long, source int, outcome string, at long, time timestamp"
    timed = [(*r, __import__("datetime").datetime.fromtimestamp(r[3], __import__("datetime").timezone.utc)) for r in rows]
    table = spark.createDataFrame(timed, schema)
    assert {r.id: (r.blocked, r.streak) for r in S.gated_sources(table, ["source"], "outcome", "at", "id").collect()} == expected
    work = lambda s: S.gated_sources(s, ["source"], "outcome", "at", "id", event_time="time")
    out = streamed(spark, files_of(spark, timed, schema, tmp_path / "f", 2), tmp_path, schema, work)
    assert {r.id: (r.blocked, r.streak) for r in out.collect()} == expected
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), "user_id", "event_type", F.col("ts").cast("timestamp").alias("started_at"))
    whole = fetches(events)
    from tidemark.registry import QUERIES

    got = {r.id: (r.blocked, r.streak) for r in QUERIES["r07_source_gate"](spark, sf).collect()}
    assert got == gate([(r.id, r.source, r.outcome, r["at"]) for r in whole.collect()])


def test_stream_equals_table_query(spark, sf):
    from tidemark.registry import QUERIES

    assert {r.id for r in QUERIES["r06_kept_titles"](spark, sf).collect()} == {r.id for r in QUERIES["t13_greedy_titles"](spark, sf).collect()}


def test_late_rows_and_restarts_of_windows(spark, tmp_path):
    """A row older than the watermark of the batch before is left out; after a restart earlier batches are there still."""
    from datetime import datetime, timedelta, timezone

    day = lambda n: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(days=n)
    schema = "at timestamp, k string, article_count long"
    batches = [[(day(0.5), "a", 1), (day(1), "a", 2), (day(20), "a", 4)], [(day(2), "a", 8), (day(40), "a", 16)], [(day(41), "a", 32)]]
    paths = []
    for k, rows in enumerate(batches):
        paths += files_of(spark, rows, schema, tmp_path / f"f{k}", 1)
    out = streamed(spark, paths, tmp_path, schema, lambda s: W.event_windows(s, "at", ["k"]))
    start = lambda n: int(day(n).timestamp()) // 259_200 * 259_200
    got = {}
    for r in out.collect():
        got[r.start_s] = got.get(r.start_s, 0) + r.articles
    assert got == {start(0): got[start(0)], start(1): got[start(1)], start(20): 4} and sum(got.values()) == 7  # without the late 8
    assert len(W.batches_of(spark, f"file://{tmp_path}/state")) >= 3


def test_keyed_table(spark, tmp_path):
    """A batch rewrites the buckets it touches; a batch that comes again changes nothing."""
    path = f"{tmp_path}/t"
    write = W.keyed_table(spark, f"file://{path}", ["k"], "v", buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int, x string")
    table = lambda: {(r.k, r.v, r.x) for r in spark.read.parquet(f"file://{path}").collect()}
    files = lambda: {p.relative_to(path).as_posix() for p in Path(path).rglob("*.parquet")}
    write(frame([(f"k{i}", 1, "a") for i in range(100)]), 0)
    before = files()
    batch = frame([("k1", 2, "b"), ("k1", 3, "c"), ("k2", 0, "old"), ("new", 1, "d")])
    write(batch, 1)
    expected = {(f"k{i}", 1, "a") for i in range(100) if i != 1} | {("k1", 3, "c"), ("new", 1, "d")}
    assert table() == expected
    gone = {f.split("/")[0] for f in before - files()}
    assert 1 <= len(gone) <= 3 and len({f.split("/")[0] for f in before}) > len(gone)
    write(batch, 1), write(frame([]), 2)
    assert table() == expected


def test_sinks(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    path = f"file://{tmp_path}/a"
    rows = lambda: sorted((r.k, r.v) for r in spark.read.parquet(path).collect())
    sinks.append(frame([("a", 1)]), path)
    sinks.append(frame([("a", 1), ("b", 2)]), path)
    assert rows() == [("a", 1), ("a", 1), ("b", 2)]
    sinks.insert_if_absent(spark.read.parquet(path), frame([("b", 9), ("c", 3), ("c", 3)]), ["k"], path)
    assert rows() == [("a", 1), ("a", 1), ("b", 2), ("c", 3)]
    other = f"file://{tmp_path}/b"
    sinks.update_by_key(frame([("a", 1), ("b", 2)]), frame([("b", 5), ("b", 4), ("d", 6)]), ["k"], F.col("v"), other)
    assert sorted((r.k, r.v) for r in spark.read.parquet(other).collect()) == [("a", 1), ("b", 5), ("d", 6)]
    sinks.report(frame([("a", 1)]), f"file://{tmp_path}/r")
    assert [(r.k, r.v) for r in spark.read.json(f"file://{tmp_path}/r").collect()] == [("a", 1)]


@pytest.mark.parametrize("mode", ["append", "update"])
def test_nothing_to_read(spark, tmp_path, mode):
    schema = "at timestamp, k string, article_count long"
    Path(f"{tmp_path}/in").mkdir()
    stream = W.event_windows(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), "at", ["k"])
    assert W.run(stream, f"file://{tmp_path}/state", mode, ["start_s", "k"]).count() == 0
