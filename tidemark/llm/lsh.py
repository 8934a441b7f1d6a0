"""From bands to classes: candidates that share a band key, exact verification on sets, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, map_arrow, written
from .textvec import U

#: Least Jaccard similarity, as a fraction: sets of m and n elements with c in common are near if (4 + 5) c >= 4 (m + n).
NUM, DEN = 4, 5
LEADERS, BLOCK_ROWS = 2, 2_048
_TURNS = (0, 0x3A5C_96E1_4B7D_28F3)

#: From a column of payloads to the distinct elements of its rows: (hashes, row numbers), sorted by both.
Elements = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def parity_sketch(h: np.ndarray, row: np.ndarray, rows: int, words: int) -> list[pa.Array]:
    """Columns of 64-bit words: each distinct element of a row flips one bit. Two sets differ in at least as many elements
    as their sketches differ in bits."""
    out = np.zeros(rows * words, U)
    bit = (h >> U(20)) % U(64 * words)
    np.bitwise_xor.at(out, row.astype(np.int64) * words + (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return [pa.array(c) for c in out.view(np.int64).reshape(rows, words).T]


def sketch_columns(words: int) -> list[str]:
    return [f"s{i}" for i in range(words)]


def shared_keys(bands: DataFrame) -> DataFrame:
    """The rows (key, id), distinct, whose key has two ids or more. Counts are summed before the shuffle and the join may
    split a hot key."""
    several = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return bands.join(several, "key")


def shared_keys_once(bands: DataFrame) -> DataFrame:
    """As shared_keys(), for rows (key long, id long) that may repeat, with one shuffle of them: each task reads its rows
    sorted, as a stream, and keeps those whose neighbour has the same key and another id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, id_, tied = np.empty(0, np.int64), np.empty(0, np.int64), False  # the last row, which waits for the next
        out = lambda k, i: pa.RecordBatch.from_arrays([pa.array(k), pa.array(i)], ["key", "id"])
        for batch in batches:
            k = np.concatenate([key, batch.column("key").to_numpy()])
            i = np.concatenate([id_, batch.column("id").to_numpy()])
            if not len(k):
                continue
            once = np.append(True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]))
            k, i = k[once], i[once]
            same = k[1:] == k[:-1]
            keep = np.append(tied, same) | np.append(same, False)
            tied = bool(keep[-1])
            key, id_ = k[-1:], i[-1:]
            yield out(k[:-1][keep[:-1]], i[:-1][keep[:-1]])
        if tied:
            yield out(key, id_)

    return map_arrow(bands.where("key is not null").repartition("key").sortWithinPartitions("key", "id"), work, "key long, id long")


def _leaders(shared: DataFrame) -> DataFrame:
    """(key, leaders, size): the ids that come first in LEADERS fixed orders of all ids, so that keys with the same
    members mostly have the same leaders."""
    if shared.schema["id"].dataType.simpleString() == "bigint":
        first = [F.min(F.col("id").bitwiseXOR(F.lit(t))).bitwiseXOR(F.lit(t)) for t in _TURNS[:LEADERS]]
    else:
        first = [F.min(F.struct(F.xxhash64("id", F.lit(t)), "id"))["id"] for t in _TURNS[:LEADERS]]
    found = shared.groupBy("key").agg(*[f.alias(f"l{i}") for i, f in enumerate(first)], F.count("*").alias("size"))
    return found.select("key", F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)])).alias("leaders"), "size")


def _common(own: np.ndarray, other: np.ndarray) -> int:
    return np.count_nonzero(own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other) if len(own) else 0


def _rows_of(elements: Elements, payload: pa.Array) -> list[np.ndarray]:
    h, row = elements(payload)
    bounds = np.searchsorted(row, np.arange(len(payload) + 1)).tolist()
    return [h[s:e] for s, e in zip(bounds, bounds[1:])]


def _near_pairs(elements: Elements) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (a, b, payload_a, payload_b), the pairs whose sets are near."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                both = np.concatenate([part.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")])
                _, first, of = np.unique(both, return_index=True, return_inverse=True)
                sets = _rows_of(elements, pa.concat_arrays([part.column("payload_a"), part.column("payload_b")]).take(pa.array(first)))
                pairs = ((sets[i], sets[j]) for i, j in zip(of[: part.num_rows].tolist(), of[part.num_rows :].tolist()))
                near = [(NUM + DEN) * _common(x, y) >= NUM * (len(x) + len(y)) for x, y in pairs]
                yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return work


def _links_of_group(elements: Elements, words: int) -> Callable[[pa.Table], pa.Table]:
    """Of members of one key, those to be asked (asks) and the others there, a forest of the near pairs between components."""

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group.column("asks").to_numpy()
        marks = np.column_stack([group.column(c).to_numpy() for c in sketch_columns(words)]).view(U)
        n = group.column("n").to_numpy()
        root = np.unique(group.column("comp").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        may: list[tuple[int, np.ndarray]] = []
        for i in left.tolist():
            there = right[(root[right] != root[i]) & (DEN * np.minimum(n[right], n[i]) >= NUM * np.maximum(n[right], n[i]))]
            differ = np.zeros(len(there), np.int64)
            for w in range(words):
                differ += np.bitwise_count(marks[there, w] ^ marks[i, w])
            near = (NUM + DEN) * differ <= (DEN - NUM) * (n[there] + n[i])
            if near.any():
                may.append((i, there[near][np.argsort(differ[near], kind="stable")]))
        found_a, found_b = [], []
        if may:
            wanted = np.unique(np.concatenate([[i for i, _ in may], *[there for _, there in may]]))
            sets = dict(zip(wanted.tolist(), _rows_of(elements, group.column("payload").chunk(0).take(pa.array(wanted)))))
            for i, there in may:
                for j in there.tolist():
                    if root[j] != root[i] and (NUM + DEN) * _common(sets[i], sets[j]) >= NUM * (len(sets[i]) + len(sets[j])):
                        found_a.append(i)
                        found_b.append(j)
                        root[root == max(root[i], root[j])] = min(root[i], root[j])
        ids = group.column("id")
        return pa.table({"a": ids.take(pa.array(found_a, pa.int64())), "b": ids.take(pa.array(found_b, pa.int64()))})

    return work


def classes(shared: DataFrame, sets: DataFrame, words: int, elements: Elements) -> DataFrame:
    """(id, component) of all ids that link with another: the components of the graph of near pairs that share a key.

    shared: distinct rows (key, id) of keys with several ids; sets: a row (id, n, s0..., payload) per id, with the number
    of its distinct elements, their sketch in `words` columns and what elements() makes them from.

    No key emits its pairs. First every member of a key meets the key's two leaders; keys of three or fewer are then
    decided. In larger ones, the members outside the key's largest component meet all that are in other components than
    theirs, and of what links there a forest comes out, one row per component at most. So no link of ids that share a key
    is lost, and a large group of copies, soon one component, costs about its size. Both sides are cut into blocks of
    about 2,048 rows and every pair of blocks is a group of its own, so a hot key is spread over tasks. What is compared
    first are sketches, which rule out only what can't be near; then whole sets.
    """
    kind = shared.schema["id"].dataType.simpleString()
    marks = sketch_columns(words)
    leaders = written(_leaders(shared), "leaders")
    pairs = shared.join(leaders, "key").select("id", F.explode("leaders").alias("leader")).where("id <> leader")
    pairs = pairs.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    side = lambda x, columns: sets.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    differ = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in marks)
    may = f"{DEN} * least(n_a, n_b) >= {NUM} * greatest(n_a, n_b) and {NUM + DEN} * ({differ}) <= {DEN - NUM} * (n_a + n_b)"
    pairs = pairs.join(side("a", ["n", *marks]), "a").join(side("b", ["n", *marks]), "b").where(may).select("a", "b")
    pairs = pairs.join(side("a", ["payload"]), "a").join(side("b", ["payload"]), "b")
    star = written(map_arrow(pairs.select("a", "b", "payload_a", "payload_b"), _near_pairs(elements), f"a {kind}, b {kind}"), "star")
    comp = written(components(star), "classes")

    members = (
        shared.join(leaders.where(f"size > {LEADERS + 1}"), "key").where("not array_contains(leaders, id)").join(comp, "id", "left")
        .select("key", "id", F.coalesce("component", "id").alias("comp"))
    )
    members = written(members, "members")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int")
    largest = (
        members.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key")
        .agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("size"), F.count("*").alias("comps"))
        .where("comps > 1").withColumn("outside", F.col("size") - F.col("m.n"))
        .select("key", F.col("m.comp").alias("largest"), blocks("outside").alias("left_blocks"), blocks("size").alias("right_blocks"))
    )
    apart = written(members.join(largest, "key"), "open")
    forget(members, leaders, star)
    if apart.isEmpty():
        return comp
    block = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = apart.where("comp <> largest").select("key", "id", "comp", block("left_blocks").alias("i"), every("right_blocks").alias("j"), F.lit(True).alias("asks"))
    right = apart.select("key", "id", "comp", every("left_blocks").alias("i"), block("right_blocks").alias("j"), F.lit(False).alias("asks"))
    groups = left.unionByName(right).join(sets.select("id", "n", *marks, "payload"), "id").groupBy("key", "i", "j")
    more = written(groups.applyInArrow(_links_of_group(elements, words), f"a {kind}, b {kind}"), "rest")
    forget(apart)
    if more.isEmpty():
        return comp
    return written(components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)), "classes")
