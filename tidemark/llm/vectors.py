"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_arrow, sized, table, written

COSINE = 0.93
SUBSPACES, CODEWORDS, LIST_ROWS, MOST_LISTS = 16, 64, 2_000, 4_096
#: Lists that a vector's partners are sought in: so many of the nearest ones at most.
PROBES = 24
#: Rows of a list, and of those that look for partners in it, that meet in one group; sample rows a list is fitted on.
BLOCK_ROWS, ASK_ROWS, FIT_ROWS = 2_048, 16_384, 40


@dataclass
class Quantiser:
    centroids: np.ndarray  # (lists, width)
    books: np.ndarray  # (subspaces, codewords, width of a subspace)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list of each row, squared distances to all centroids)."""
        d = np.maximum((x * x).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * x @ self.centroids.T, 0)
        return d.argmin(1), d

    def codes(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, what is lost): one code per subspace, and the distance of each row from its decoded form."""
        m, _, w = self.books.shape
        parts = residual.reshape(len(residual), m, w)
        out = np.empty((len(residual), m), np.uint8)
        lost = np.zeros(len(residual))
        for k in range(m):
            d = ((parts[:, k, None, :] - self.books[k]) ** 2).sum(2)
            out[:, k] = d.argmin(1)
            lost += d[np.arange(len(d)), out[:, k]]
        return out, np.sqrt(lost)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """(subspaces, rows, codewords): squared distances of each row's parts to all codewords."""
        m, _, w = self.books.shape
        parts = residual.reshape(len(residual), m, w)
        return np.stack([((parts[:, k, None, :] - self.books[k]) ** 2).sum(2) for k in range(m)])


def _runs(rows: int, columns: int) -> list[tuple[int, int]]:
    """Runs of rows whose matrix with so many columns has 4 million values at most."""
    step = max(64, (1 << 22) // columns)
    return [(a, min(a + step, rows)) for a in range(0, rows, step)]


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    means = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        length = (means**2).sum(1)
        of = np.concatenate([(length - 2 * x[a:b] @ means.T).argmin(1) for a, b in _runs(len(x), len(means))])
        n = np.bincount(of, minlength=len(means))
        for j in range(x.shape[1]):
            means[:, j] = np.where(n > 0, np.bincount(of, x[:, j], minlength=len(means)) / np.maximum(n, 1), means[:, j])
    return means


def padded(values: pa.Array, width: int) -> np.ndarray:
    """(rows, width) in double precision, filled up with zeros."""
    lengths = np.diff(values.offsets.to_numpy())
    out = np.zeros((len(values), width))
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    out[np.repeat(np.arange(len(values)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def of_length_one(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def unit_vectors(values: pa.Array, width: int) -> np.ndarray:
    return of_length_one(padded(values, width))


def _centroids(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; of more than 64 lists in two levels, each first one having lists in proportion to its rows."""
    if lists <= 64:
        return _k_means(x, min(lists, len(x)), 10, rng)
    coarse = Quantiser(_k_means(x, min(64, len(x)), 10, rng), np.zeros((1, 1, x.shape[1])))
    of = np.concatenate([coarse.nearest(x[a:b])[0] for a, b in _runs(len(x), len(coarse.centroids))])
    out = []
    for k in np.unique(of):
        part = x[of == k]
        out.append(_k_means(part, max(1, min(len(part), round(lists * len(part) / len(x)))), 6, rng))
    return np.concatenate(out)


def fit(vectors: DataFrame, rows: int, levels: list[int], width: int, sample_rows: int = 20_000, seed: int = 8) -> dict[int, Quantiser]:
    """For each of the numbers of lists, centroids and codebooks from at most 2 * sample_rows vectors, about sample_rows
    (or 40 a list, if that is more), chosen by a hash of their values."""
    sample_rows = max(sample_rows, FIT_ROWS * max(levels))
    one_in = max(1, rows // sample_rows)
    sample = vectors.where(F.pmod(F.xxhash64(F.lit(seed), "values"), F.lit(one_in)) == 0).orderBy(F.xxhash64("values"), "g").limit(2 * sample_rows).select("values").toArrow()
    x = unit_vectors(sample.column(0).combine_chunks(), width) if sample.num_rows else np.zeros((1, width))
    rng = np.random.default_rng(seed)
    out = {}
    for lists in levels:
        centroids = _centroids(x, lists, rng)
        coarse = Quantiser(centroids, np.zeros((1, 1, width)))
        some = x[rng.permutation(len(x))[:20_000]]
        nearest = np.concatenate([coarse.nearest(some[a:b])[0] for a, b in _runs(len(some), len(centroids))])
        parts = (some - centroids[nearest]).reshape(len(some), SUBSPACES, -1)
        out[lists] = Quantiser(centroids, np.stack([_k_means(parts[:, k], min(CODEWORDS, len(some)), 10, rng) for k in range(SUBSPACES)]))
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component of each of n nodes (its smallest node) under the links a-b: least neighbours, then pointer jumping."""
    of = np.arange(n)
    while True:
        least = of.copy()
        np.minimum.at(least, of[a], of[b])
        np.minimum.at(least, of[b], of[a])
        new = least[of]
        while (new[new] != new).any():
            new = new[new]
        if (new == of).all():
            return of
        of = new


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors of one label are linked if their cosine in double precision is
    `cosine` or more; n_links counts the other vectors linked directly, component_id is the smallest vec_id reachable.

    Vectors that are null, empty or zero, or hold null or non-finite components, and vectors of a null label, link with
    nothing. Vectors of different widths count as filled up with zeros. Equal vectors are one row until the end, with
    their number. Rows that repeat a vec_id are vectors of their own. Rows with a null vec_id get no links and a null
    component. No rows, no result; other columns don't matter.

    A label has about an inverted list for two thousand vectors (1, 4, 16 up to 4,096; beyond, lists get longer). A vector
    is kept in the list of its nearest centroid as residual codes. It looks for partners in its own list and in those of its
    24 nearest lists that come later and whose border (the plane half-way between the centroids) isn't farther than two
    linked vectors can be. So up to 24 lists no linked pair is missed; of more, the one whose list comes first must have
    the other's among its 24 nearest, which pairs at the threshold have by over 99 % (tested on random vectors, which have
    no near lists). There, distances from code tables drop a partner only if they exceed that distance by more than its
    code has lost; the rest is decided by exact cosines. So a vector is sent to 24 lists at most, however many there are.
    Lists are cut into blocks of 2,048 rows, those that ask into blocks of 16,384, and every pair of blocks is one group,
    so a hot list is spread; a group returns sums and a spanning forest of its links. Vectors of floats travel as such.
    """
    rows = embeddings.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("values"))
    finite = F.forall("values", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("values", lambda v: v != 0)
    good = rows.where("id is not null and label is not null and size(values) > 0").where(finite)
    copies = good.withColumn("h1", F.xxhash64("values")).withColumn("h2", F.xxhash64(F.lit(1), "values"))
    groups = copies.groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("values").alias("values"))
    groups = written(groups.withColumn("g", F.monotonically_increasing_id()), "vectors")
    total, width = groups.agg(F.count("*"), F.max(F.size("values"))).first()
    alone = lambda d: d.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not total:
        return alone(rows)
    width = -(-width // SUBSPACES) * SUBSPACES
    of_size = F.least(F.lit(MOST_LISTS), F.pow(4, F.floor(F.log(4.0, F.greatest(F.lit(1.0), F.col("size") / LIST_ROWS)) + 0.5))).cast("int")
    labels = sized(groups.groupBy("label").agg(F.count("*").alias("size")).select("label", of_size.alias("lists")), "labels")
    levels = sorted(r.lists for r in labels.select("lists").distinct().collect())  # eight at most
    shared = embeddings.sparkSession.sparkContext.broadcast(fit(groups, total, levels, width))
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    number = np.float32 if embeddings.schema[vector].dataType.elementType.typeName() == "float" else np.float64

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantisers = shared.value
        raw = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
        for batch in batches:
            of = batch.column("lists").to_numpy()
            for level in np.unique(of).tolist():
                of_level = batch.filter(pa.array(of == level))
                q = quantisers[level]
                length = (q.centroids**2).sum(1)
                for a, b in _runs(of_level.num_rows, len(q.centroids)):
                    part = of_level.slice(a, b - a)
                    own_values = padded(part.column("values"), width)
                    x = of_length_one(own_values)
                    own, d = q.nearest(x)
                    codes, lost = q.codes(x - q.centroids[own])
                    homes, of_home = np.unique(own, return_inverse=True)
                    apart = np.sqrt(np.maximum(length[homes][:, None] + length - 2 * q.centroids[homes] @ q.centroids.T, 1e-12))
                    border = (d - d[np.arange(len(x)), own][:, None]) / (2 * apart[of_home])
                    border[apart[of_home] < 1e-4] = 0  # too near to tell
                    near = np.argpartition(d, PROBES - 1, axis=1)[:, :PROBES] if d.shape[1] > PROBES else np.tile(np.arange(d.shape[1]), (len(x), 1))
                    asked = (np.take_along_axis(border, near, 1) <= reach) & (near > own[:, None])
                    probes = [near[i, asked[i]].astype(np.int32) for i in range(len(x))]
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(c) for c in ("g", "label", "n", "lists")], pa.array(own.astype(np.int32)), pa.array(probes, pa.list_(pa.int32())), raw(own_values.astype(number)), raw(codes), pa.array(lost)],
                        ["g", "label", "n", "lists", "list", "probes", "x", "codes", "lost"],
                    )

    label_kind = groups.schema["label"].dataType.simpleString()
    index = map_arrow(groups.join(labels, "label").select("g", "label", "n", "lists", "values"), assign, f"g long, label {label_kind}, n long, lists int, list int, probes array<int>, x binary, codes binary, lost double")
    index = written(index, "index")
    asks = index.select("g", "label", "n", "lists", F.col("list").alias("home"), F.explode(F.concat(F.array("list"), "probes")).alias("list"), "x").withColumn("home", F.col("home") == F.col("list"))
    blocks = lambda d, most, name: d.groupBy("label", "list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = sized(blocks(index, BLOCK_ROWS, "kept_blocks").join(blocks(asks, ASK_ROWS, "ask_blocks"), ["label", "list"]), "sizes")
    spread = lambda name: F.sequence(F.lit(0), F.col(name) - 1)
    own_block = lambda name: F.pmod(F.xxhash64("g"), F.col(name)).cast("int")
    none = lambda k: F.lit(None).cast(k)
    own = ["g", "label", "n", "lists", "list"]
    kept = index.join(sizes, ["label", "list"]).select(*own, own_block("kept_blocks").alias("kb"), F.explode(spread("ask_blocks")).alias("ab"), "x", "codes", "lost")
    asked = asks.join(sizes, ["label", "list"]).select(*own, F.explode(spread("kept_blocks")).alias("kb"), own_block("ask_blocks").alias("ab"), "x", none("binary").alias("codes"), none("double").alias("lost"), "home")

    def compare(group: pa.Table) -> pa.Table:
        is_kept = np.asarray(group.column("lost").is_valid())
        k, a = group.filter(pa.array(is_kept)), group.filter(pa.array(~is_kept))
        if not k.num_rows or not a.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "n")})
        q = shared.value[k.column("lists")[0].as_py()]
        matrix = lambda t, c, kind, w: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(-1, w)
        kx, ax = (of_length_one(matrix(t, "x", number, width).astype(float)) for t in (k, a))
        codes, lost = matrix(k, "codes", np.uint8, SUBSPACES), k.column("lost").to_numpy()
        centroid = q.centroids[k.column("list")[0].as_py()]
        pairs_k, pairs_a = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(ax), 512):
            part = ax[at : at + 512]
            tables = q.tables(part - centroid).astype(np.float32)
            d = np.zeros((len(part), len(kx)), np.float32)
            for s in range(SUBSPACES):
                d += tables[s][:, codes[:, s]]
            i, j = np.nonzero(d <= ((reach + lost) ** 2 * (1 + 1e-4) + 1e-4)[None])
            for some in range(0, len(i), 1 << 18):
                ii, jj = i[some : some + (1 << 18)], j[some : some + (1 << 18)]
                link = np.einsum("ij,ij->i", part[ii], kx[jj]) >= cosine
                pairs_a.append(ii[link] + at)
                pairs_k.append(jj[link])
        pk, pa_ = np.concatenate(pairs_k), np.concatenate(pairs_a)
        ids, inverse = np.unique(np.concatenate([k.column("g").to_numpy(), a.column("g").to_numpy()]), return_inverse=True)
        weight = np.zeros(len(ids), np.int64)
        weight[inverse] = np.concatenate([k.column("n").to_numpy(), a.column("n").to_numpy()])
        nk, na = inverse[: len(kx)][pk], inverse[len(kx) :][pa_]
        # In its own list a pair is met from both sides, elsewhere once; a row meets itself.
        same_list = np.zeros(len(ids), bool)
        same_list[inverse[len(kx) :]] = np.asarray(a.column("home").to_numpy(zero_copy_only=False), bool)
        use = (nk != na) & (~same_list[na] | (na < nk))
        nk, na = nk[use], na[use]
        links = np.bincount(nk, weight[na], minlength=len(ids)) + np.bincount(na, weight[nk], minlength=len(ids))
        some = np.flatnonzero(links)
        root = _forest(len(ids), nk, na)
        tied = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({
            "a": pa.array(np.concatenate([ids[some], ids[tied]])),
            "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[root[tied]])]),
            "n": pa.array(np.concatenate([links[some], np.zeros(len(tied))]).astype(np.int64)),
        })

    both = kept.withColumn("home", F.lit(True)).unionByName(asked)
    found = written(both.groupBy("label", "list", "kb", "ab").applyInArrow(compare, "a long, b long, n long"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("g")).agg(F.sum("n").alias("links"))
    linked = written(components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "g"), "components")
    least = groups.join(linked, "g").groupBy("component").agg(F.min("id").alias("component_id"))
    linked = linked.join(least, "component").select("g", "component_id")
    of_group = groups.join(links, "g", "left").join(linked, "g", "left").select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    named = copies.join(of_group, ["label", "h1", "h2"]).select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    bad = rows.where(~F.coalesce(F.expr("id is not null and label is not null and size(values) > 0") & finite, F.lit(False)))
    return named.unionByName(alone(bad))


def op8(spark, sf_dir: str) -> DataFrame:
    """All embeddings: vec_id, n_links, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
with v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), u as (
  select vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v
), l as materialized (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) >= 0.93
), r as (
  with recursive w(a, b) as (select vec_id, vec_id from u where vec_id in (select a from l) union select w.a, l.b from w join l on w.b = l.a)
  select a, min(b) as c from w group by a
), n as (
  select a, count(*) as n from l group by a
)
select e.vec_id, coalesce(n.n, 0) as n_links, coalesce(r.c, e.vec_id) as component_id, coalesce(r.c, e.vec_id) is not distinct from e.vec_id as kept
from embeddings e left join n on n.a = e.vec_id left join r on r.a = e.vec_id
"""
