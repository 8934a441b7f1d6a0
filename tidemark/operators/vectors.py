"""Greedy communities of near vectors within groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import forget, ship_package, sized, written

BLOCK_ROWS = 1_024


def _grid(rows: DataFrame) -> DataFrame:
    """Rows (bucket, id, vector, ...) dealt to groups (bucket, _i, _j) of two blocks each, a bucket having a block per 1,024
    rows: every two rows of a bucket meet in one group, so that a large bucket is spread over tasks."""
    blocks = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_n"))
    own = rows.join(sized(blocks, "buckets"), "bucket").withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    dealt = own.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.withColumns({"_i": F.least("_own", "_k"), "_j": F.greatest("_own", "_k")})


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of block _i, rows of block _j, their cosines); both are the same where a block meets itself."""
    values = group.column("vector").combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    x = values.flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
    length = np.linalg.norm(x, axis=1)
    x = x / np.where(length > 0, length, np.inf)[:, None]
    own = group.column("_own").to_numpy()
    left, right = np.flatnonzero(own == group.column("_i")[0].as_py()), np.flatnonzero(own == group.column("_j")[0].as_py())
    return left, right, x[left] @ x[right].T


def communities(rows: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(id, community, cosine) of all rows (id, bucket, vector): greedy community detection within each bucket.

    Each row is the centre of the rows of its bucket with a cosine of threshold or more to it. Centres are taken in the
    order of their sizes, larger first, then by id; each takes what no earlier one has. So a row belongs to the first, in
    that order, of the centres near it, which needs no sequence of steps: one pass counts every centre's size, a second
    one finds every row's first centre. community is the centre's id, cosine the row's to it. (A centre may itself belong
    to an earlier one; its community then has the others.)

    Null, empty and zero vectors and null buckets are alone, with a null cosine; vectors of one bucket have one width; ids
    are unique. Pairs never leave the group of blocks in which they are compared; a pass returns a row per row and group.
    """
    good = rows.where("id is not null and bucket is not null and size(vector) > 0").select("id", "bucket", F.col("vector").cast("array<double>").alias("vector"))

    def count(group: pa.Table) -> pa.Table:
        left, right, cosine = _sides(group)
        near = cosine >= threshold
        n = np.zeros(group.num_rows, np.int64)
        n[left] += near.sum(1)
        if len(left) != len(right) or (left != right).any():
            n[right] += near.sum(0)
        return pa.table({"id": group.column("id"), "n": pa.array(n)})

    def choose(group: pa.Table) -> pa.Table:
        left, right, cosine = _sides(group)
        ids, sizes = group.column("id").to_pylist(), group.column("size").to_pylist()
        out: list[tuple] = []
        same = len(left) == len(right) and (left == right).all()
        for of, centres, c in ((left, right, cosine),) if same else ((left, right, cosine), (right, left, cosine.T)):
            order = sorted(range(len(centres)), key=lambda k: (-sizes[centres[k]], ids[centres[k]]))
            near = c[:, order] >= threshold
            first = near.argmax(1)
            for k in np.flatnonzero(near.any(1)).tolist():
                centre = centres[order[first[k]]]
                out.append((ids[of[k]], -sizes[centre], ids[centre], float(c[k, order[first[k]]])))
        columns = list(zip(*out)) if out else [()] * 4
        return pa.table([pa.array(columns[0], group.schema.field("id").type), pa.array(columns[1], pa.int64()), pa.array(columns[2], group.schema.field("id").type), pa.array(columns[3], pa.float64())], names=["id", "n", "centre", "cosine"])

    ship_package(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()
    counted = _grid(good).groupBy("bucket", "_i", "_j").applyInArrow(count, f"id {kind}, n long")
    sizes = written(counted.groupBy("id").agg(F.sum("n").alias("size")), "sizes")
    chosen = _grid(good.join(sizes, "id")).groupBy("bucket", "_i", "_j").applyInArrow(choose, f"id {kind}, n long, centre {kind}, cosine double")
    first = written(chosen.groupBy("id").agg(F.min(F.struct("n", "centre", "cosine")).alias("c")), "centres")
    forget(sizes)
    return rows.select("id").join(first, "id", "left").select("id", F.coalesce("c.centre", "id").alias("community"), "c.cosine")


def merged(topics: DataFrame, threshold: float = 0.85) -> DataFrame:
    """topics (id, bucket, vector, keywords, source_ids) with canonical and, in the canonical row, the keywords and source
    ids of its whole community, its own first, then those of the others, the nearest to the centre before: of each
    community the topic with the most keywords, then the nearest to the centre, then the smallest id. Others have null."""
    of = written(topics.select("id", "keywords", "source_ids").join(communities(topics, threshold), "id").withColumn("far", -F.round(F.coalesce("cosine", F.lit(1.0)), 9)), "topics")
    best = F.min_by("id", F.struct(-F.size("keywords"), "far", "id"))
    canonical = of.groupBy("community").agg(best.alias("canonical"))
    ranked = F.array_sort(F.collect_list(F.struct((F.col("id") != F.col("canonical")).alias("other"), "far", "id", "keywords", "source_ids")))
    union = lambda c: F.array_distinct(F.flatten(F.transform("ranked", lambda r: r[c])))
    groups = of.join(canonical, "community").groupBy("community").agg(F.first("canonical").alias("canonical"), ranked.alias("ranked")).select("community", "canonical", union("keywords").alias("k"), union("source_ids").alias("s"))
    own = F.col("id") == F.col("canonical")
    return of.join(groups, "community").select("id", "canonical", F.when(own, F.col("k")).alias("keywords"), F.when(own, F.col("s")).alias("source_ids"))


MATCH_ROWS = 4_096


def best_matches(left: DataFrame, right: DataFrame, threshold: float, general=None) -> DataFrame:
    """(id, best, score, specific, specific_score, matches) of every row of left (id, vector) against all rows of right (key,
    vector): the key of the greatest cosine, of equal ones the smallest; the same among keys other than `general`; and how
    many keys have a cosine of threshold or more. Null, empty and zero vectors match nothing: such rows of left have nulls
    and 0. ids and keys are unique; all vectors have one width.

    Both sides are cut into blocks of 4,096 rows, and every block of one meets every block of the other in a group of its
    own by one matrix product, which returns a row per left row. No side is broadcast, and no pair leaves its group."""
    lk, rk = left.schema["id"].dataType.simpleString(), right.schema["key"].dataType.simpleString()
    good = lambda d: d.where("size(vector) > 0").withColumn("vector", F.col("vector").cast("array<double>"))
    blocks = lambda d: max(1, -(-d.count() // MATCH_ROWS))
    n_left, n_right = blocks(left), blocks(right)
    none = lambda kind: F.lit(None).cast(kind)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = good(left).select(own("id", n_left).alias("i"), every(n_right).alias("j"), "id", none(rk).alias("key"), "vector")
    dealt = dealt.unionByName(good(right).select(every(n_left).alias("i"), own("key", n_right).alias("j"), none(lk).alias("id"), "key", "vector"))

    def compare(group: pa.Table) -> pa.Table:
        id_type, key_type = group.schema.field("id").type, group.schema.field("key").type
        names = ["id", "best", "score", "specific", "specific_score", "matches"]
        types = [id_type, key_type, pa.float64(), key_type, pa.float64(), pa.int64()]
        is_left = np.asarray(group.column("id").is_valid())
        ids, keys = (group.column(c).filter(pa.array(m)).to_pylist() for c, m in (("id", is_left), ("key", ~is_left)))
        if not ids or not keys:
            return pa.table([pa.array([], t) for t in types], names=names)
        x = np.array(group.column("vector").to_pylist())
        length = np.linalg.norm(x, axis=1)
        x = x / np.where(length > 0, length, np.nan)[:, None]
        order = sorted(range(len(keys)), key=lambda k: keys[k])  # argmax gives the first of equal ones
        keys = [keys[k] for k in order]
        cosine = x[is_left] @ x[~is_left][order].T
        cosine = np.where(np.isnan(cosine), -np.inf, cosine)
        special = np.array([k != general for k in keys])
        columns: list = [ids]
        for c in (cosine, np.where(special, cosine, -np.inf)):
            best = c.argmax(1)
            score = c[np.arange(len(c)), best]
            columns += [[keys[k] if s > -np.inf else None for k, s in zip(best.tolist(), score.tolist())], [s if s > -np.inf else None for s in score.tolist()]]
        columns.append((cosine >= threshold).sum(1).tolist())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    ship_package(left.sparkSession)
    part = dealt.groupBy("i", "j").applyInArrow(compare, f"id {lk}, best {rk}, score double, specific {rk}, specific_score double, matches long")
    top = lambda key, score: F.min(F.when(F.col(key).isNotNull(), F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))))
    found = part.groupBy("id").agg(top("best", "score").alias("b"), top("specific", "specific_score").alias("s"), F.sum("matches").alias("matches"))
    return left.select("id").join(found, "id", "left").select(
        "id", F.col("b.k").alias("best"), (-F.col("b.s")).alias("score"), F.col("s.k").alias("specific"), (-F.col("s.s")).alias("specific_score"), F.coalesce("matches", F.lit(0)).alias("matches")
    )
