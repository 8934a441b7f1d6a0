"""Vector code compression: product codebooks trained on integers, assigned by Exponion search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_arrow, sized, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components stay below this, so that squared distances and their sums are exact in 64 bits.
MOST = 1 << 26


def integers(values: pa.Array, width: int) -> np.ndarray:
    """(rows, PARTS, width / PARTS); shorter vectors end in zeros."""
    lengths = np.diff(values.offsets.to_numpy())
    out = np.zeros((len(values), width), np.int64)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(values)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out.reshape(len(values), PARTS, -1)


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries by distance from each entry, the squared distances, ascending)."""
    d = ((book[:, None] - book[None]) ** 2).sum(2)
    order = np.argsort(d, axis=1, kind="stable")
    return order, np.take_along_axis(d, order, 1)


def nearest(x: np.ndarray, book: np.ndarray, near: tuple[np.ndarray, np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the entry nearest to each row, the lowest index of equally near ones.

    The search starts at `start`. An entry as near as that one lies within twice the start's distance of it, by the
    triangle inequality (four times, squared), so only so much of the start's list of neighbours is scanned."""
    order, far = near
    best = start.copy()
    least = ((x - book[start]) ** 2).sum(1)
    radius = 4 * least
    reach = np.empty(len(x), np.int64)
    for entry in np.unique(start):
        of = start == entry
        reach[of] = np.searchsorted(far[entry], radius[of], "right")
    rows = np.argsort(-reach, kind="stable")
    ends = np.searchsorted(-reach[rows], -np.arange(len(book)), "left")  # how many rows reach beyond neighbour k
    for k in range(len(book)):
        some = rows[: ends[k]]
        if not len(some):
            break
        entry = order[start[some], k]
        d = ((x[some] - book[entry]) ** 2).sum(1)
        better = (d < least[some]) | ((d == least[some]) & (entry < best[some]))
        best[some[better]], least[some[better]] = entry[better], d[better]
    return best, least


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64)


def _assigned(rows: DataFrame, books: np.ndarray, width: int, name: str) -> DataFrame:
    """rows with each part's nearest entry in `codes`, searched from the entry there before, and `error`, their squared distances."""
    near = [neighbours(b) for b in books]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, old = integers(batch.column("q"), width), _codes(batch.column("codes"))
            new, error = np.empty_like(old), np.zeros(len(old), np.int64)
            for p in range(PARTS):
                new[:, p], d = nearest(x[:, p], books[p], near[p], old[:, p])
                error += d
            codes = pa.array([r.tobytes() for r in new.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "label", "q")], codes, pa.array(error)], ["id", "label", "q", "codes", "error"])

    kind = dict(rows.dtypes)
    return written(map_arrow(rows, assign, f"id {kind['id']}, label {kind['label']}, q array<int>, codes binary, error long"), name)


def _means(rows: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """Each entry replaced by floor(sum / count) of the parts assigned to it; unused ones stay."""
    _, entries, w = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((PARTS * entries, w), np.int64), np.zeros(PARTS * entries, np.int64)
        for batch in batches:
            x = integers(batch.column("q"), width).reshape(-1, w)
            at = (_codes(batch.column("codes")) + np.arange(PARTS) * entries).ravel()
            np.add.at(total, at, x)
            count += np.bincount(at, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["at", "n", "total"])

    partial = map_arrow(rows.select("q", "codes"), sums, "at long, n long, total array<long>")
    exact = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"t{k}") for k in range(w)]
    new = books.reshape(PARTS * entries, w).copy()
    for r in partial.groupBy("at").agg(F.sum("n").alias("n"), *exact).collect():  # PARTS * ENTRIES rows at most
        new[r["at"]] = [int(r[f"t{k}"]) // r["n"] for k in range(w)]
    return new.reshape(books.shape)


def compress(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): of every vector its id, label, `codes` (binary, one byte a part) and `error` (long), and the
    codebooks of integers (PARTS, entries, width of a part).

    Vectors that are null or hold null or non-finite components are left out. Components x become floor(256 x). A part
    position's codebook starts as that part of the 64 smallest ids (nulls last, equal ids by their vector; fewer rows,
    fewer entries); two rounds assign and average it, then parts are assigned a last time. Vectors of different widths
    count as filled up with zeros to the greatest one, that to a multiple of 16; an empty vector is all zeros. Repeated
    ids and equal vectors are rows of their own. Components of 2**26 / 256 or more are an error, as their squares would
    leave 64 bits. No rows, no result, and no codebooks; other columns don't matter.

    Each round is one pass over a table written with the codes of the round before; a task returns one sum per entry.
    """
    q = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: F.floor(SCALE * x))
    rows = embeddings.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.where("v is not null").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    fits = F.forall("v", lambda x: F.abs(x) < MOST // SCALE)
    q = F.transform(F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit("a component is too large to compress"))), lambda x: F.floor(SCALE * x).cast("int"))
    kind = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    first = written(rows.select("id", "label", q.alias("q"), F.lit(bytes(PARTS)).alias("codes")), "vectors")
    width = first.agg(F.max(F.size("q"))).first()[0]
    if width is None:
        return first.sparkSession.createDataFrame([], f"id {kind[0]}, label {kind[1]}, codes binary, error long"), np.empty((PARTS, 0, 0), np.int64)
    width = max(PARTS, -(-width // PARTS) * PARTS)
    seeds = first.orderBy(F.col("id").asc_nulls_last(), "q").limit(ENTRIES).select("q").toArrow().column(0).combine_chunks()
    books = integers(seeds, width).transpose(1, 0, 2).copy()
    for k in range(ROUNDS + 1):
        assigned = _assigned(first, books, width, f"codes{k}")
        forget(first)
        if k < ROUNDS:
            books = _means(assigned, books, width)
        first = assigned
    return first.select("id", "label", "codes", "error"), books


def op13(spark, sf_dir: str) -> DataFrame:
    """All embeddings with finite vectors: vec_id, code, error, label_error, codebooks_sha256."""
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    of_label = sized(rows.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "label_errors")
    named = rows.join(of_label, F.expr("label <=> l"))
    return named.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round(k: int, book: str, replace: bool = True) -> str:
    """Assignment to a codebook of 16 parts; then the codebook of means."""
    assigned = f"""
a{k} as materialized (
  select p.r, p.part, min((d, b.entry)) as best
  from p join (select part, entry, e from {book}) b on p.part = b.part,
    lateral (select list_sum(list_transform(list_zip(p.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d) t
  group by p.r, p.part
)"""
    means = f""", m{k} as (
  select part, entry, list(s order by i) as e from (
    select a{k}.part, best[2] as entry, i, floor(sum(p.e[i])::decimal(38, 0) / count(*))::bigint as s
    from a{k} join p on p.r = a{k}.r and p.part = a{k}.part, range(1, 5) g(i) group by a{k}.part, best[2], i
  ) group by part, entry
), b{k} as materialized (
  select b.part, b.entry, coalesce(m{k}.e, b.e) as e from {book} b left join m{k} on m{k}.part = b.part and m{k}.entry = b.entry
)"""
    return assigned + (means if replace else "")


OP13_SQL = f"""
with v as materialized (
  select row_number() over (order by vec_id, embedding) - 1 as r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), p as materialized (
  select r, part, q[4 * part + 1 : 4 * part + 4] as e from v, range(16) g(part)
), b as materialized (
  select part, r as entry, e from p where r < 64
), {_round(0, "b")}, {_round(1, "b0")}, {_round(2, "b1", False)}, f as materialized (
  select r, string_agg(printf('%02x', best[2]), '' order by part) as code, sum(best[1])::bigint as error from a2 group by r
), h as (
  select sha256(string_agg(array_to_string(e, ','), ',' order by part, entry)) as s from b1
)
select v.vec_id, f.code, f.error, sum(f.error) over (partition by v.label)::bigint as label_error, h.s as codebooks_sha256 from v join f on f.r = v.r, h
"""
