"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import forget, map_arrow, table, written
from .textvec import U

#: What a label column must be for its category to hold, in the order of the chain; the last one decides.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic > 0"}
PREFIXES = (4, 5, 6)


@dataclass
class Chain:
    categories: list[str]
    features: np.ndarray  # sorted hashes
    weights: list[np.ndarray]  # per category: of the features, of the earlier probabilities, the intercept
    threshold: float = 0.5

    def probabilities(self, feature: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """(rows, categories). feature: positions in self.features, distinct within a row."""
        out = np.zeros((rows, len(self.categories)))
        n = len(self.features)
        for c, w in enumerate(self.weights):
            z = np.bincount(row, w[feature], minlength=rows) + w[-1]
            if c:
                z = z + out[:, :c] @ w[n : n + c]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of words and of the beginnings of words, in lower case, with repetitions."""
    start, end, row = tv.word_spans(data, offsets)
    sums = tv.prefix_sums(data)
    out, rows = [tv.span_hash(sums, start, end)], [row]
    for n in PREFIXES:
        long = end - start > n
        out.append(tv.span_hash(sums, start[long], start[long] + n) ^ U(n))
        rows.append(row[long])
    return np.concatenate(out), np.concatenate(rows)


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(row, kind="stable")
    h, row, nth = tv.occurrences(h[order], row[order])
    return h[nth == 0], row[nth == 0]


def _known(known: np.ndarray):
    """h -> (positions in known, which of h), by a bitmap of 16 bits before the search."""
    bitmap = np.zeros(1 << 16, bool)
    bitmap[(known & U(0xFFFF)).astype(np.int64)] = True

    def find(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.flatnonzero(bitmap[(h & U(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(known, h[of])
        hit = known[np.minimum(at, len(known) - 1)] == h[of] if len(known) else np.zeros(len(of), bool)
        return at[hit], of[hit]

    return find


def _fit_linear(feature: np.ndarray, row: np.ndarray, dense: np.ndarray, y: np.ndarray, n: int, l2: float = 3e-5, steps: int = 300, rate: float = 0.1) -> np.ndarray:
    """Logistic regression by Adam steps, of falling size, on all rows of sparse binary features and a few dense columns."""
    rows, d = len(y), dense.shape[1]
    w = np.zeros(n + d + 1)
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        z = np.bincount(row, w[feature], minlength=rows) + dense @ w[n : n + d] + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        g = np.concatenate([np.bincount(feature, error[row], minlength=n), error @ dense, [error.sum()]]) / rows
        g[:-1] += l2 * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= rate * (1 - k / (steps + 1)) * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-10)
    return w


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, max_rows: int = 20_000, per_category: int = 1_500, folds: int = 3) -> Chain | None:
    """The chain, fitted on max_rows labelled rows at most (those of the smallest hashes of doc_id); None without any.

    categories: name to condition on labels (doc_id and any label columns), in the order of the chain; the last one
    decides. A null condition is false, rows that repeat a doc_id hold what one of them holds, and rows of labels whose
    deciding condition is null aren't labelled.

    Features are chosen and counted on the executors: per category the per_category ones with the largest positive
    association. The models of a category, one per fold and one on all rows, are fitted side by side in tasks that get
    the sample: at most that many hashes, and for each of max_rows texts the positions of the chosen features in it.
    Earlier probabilities enter later models as out-of-fold predictions. The threshold is what one clean text in 1,000
    passes out of fold, 0.1 at least and 0.5 at most."""
    categories = categories or CATEGORIES
    names = list(categories)
    held = [F.expr(f"max(cast(coalesce({condition}, false) as int))").alias(c) for c, condition in categories.items()]
    y = labels.where("doc_id is not null").where(F.expr(f"({categories[names[-1]]}) is not null")).groupBy("doc_id").agg(*held)
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", "text").where("doc_id is not null and text is not null").join(F.broadcast(y), "doc_id").dropDuplicates(["doc_id"])
    sample = written(sample.select("doc_id", "text", *names), "labelled")
    total = sample.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in names]).first()
    if not total[0]:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [batch.column(c).to_numpy().astype(np.int64) for c in names]
            for first, data, offsets in tv.slices(tv.lower(batch.column("text"))):
                h, row = _distinct(*features(data, offsets))
                u, inverse = np.unique(h, return_inverse=True)
                sums = [np.bincount(inverse, y[first + row], minlength=len(u)).astype(np.int64) for y in of]
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(inverse, minlength=len(u))), *map(pa.array, sums)], ["h", "n", *names])

    counts = map_arrow(sample, count, "h long, n long, " + ", ".join(f"{c} long" for c in names)).groupBy("h").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).where("n >= 3")
    counts = written(counts, "associations")
    chosen: set[int] = set()
    for i, c in enumerate(names):
        n, p = float(total[0]), float(total[i + 1])
        a, b = F.col(c).cast("double"), (F.col("n") - F.col(c)).cast("double")
        lift = a * (n - p - b) - b * (p - a)
        score = F.when(lift > 0, lift * lift / (F.col("n") * (n - F.col("n")) + 1.0))
        chosen |= {r.h for r in counts.select("h", score.alias("s")).where("s is not null").orderBy(F.desc("s"), "h").limit(per_category).collect()}
    known = np.sort(np.array(sorted(chosen), np.int64).view(U))
    find = _known(known)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in tv.slices(tv.lower(batch.column("text"))):
                h, row = features(data, offsets)
                at, of = find(h)
                pair = np.unique(row[of].astype(np.int64) << 32 | at)
                ends = np.append(0, np.cumsum(np.bincount(pair >> 32, minlength=len(offsets) - 1))).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array((pair & 0xFFFFFFFF).astype(np.int32)))
                part = batch.slice(first, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, *[part.column(c) for c in names]], ["doc_id", "at", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(sample, pick, f"doc_id {kind}, at array<int>, " + ", ".join(f"{c} int" for c in names)).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    forget(sample, counts)
    at = rows.column("at").combine_chunks()
    row = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((at.flatten().to_numpy(), row, {c: rows.column(c).to_numpy().astype(float) for c in names}))
    given = np.zeros((len(at), 0))
    weights = []
    for c in names:
        earlier = context.broadcast(given)

        def fit(batches: Iterator[pa.RecordBatch], c: str = c, earlier=earlier) -> Iterator[pa.RecordBatch]:
            """The model without each of the given folds, or of all rows, and its probabilities of the rows left out."""
            (feature, row, y), dense = shared.value, earlier.value
            rows = np.arange(len(dense))
            for batch in batches:
                for fold in batch.column("fold").to_pylist():
                    inside = rows % folds != fold
                    outside = ~inside if fold < folds else inside
                    inside = inside if inside.any() else ~inside
                    of = np.cumsum(inside) - 1
                    w = _fit_linear(feature[inside[row]], of[row[inside[row]]], dense[inside], y[c][inside], len(known))
                    z = np.bincount(row, w[feature], minlength=len(dense)) + dense @ w[len(known) : -1] + w[-1]
                    p = 1 / (1 + np.exp(-np.clip(z[outside], -500, 500)))
                    yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([w.tolist()]), pa.array([rows[outside].tolist()], pa.list_(pa.int64())), pa.array([p.tolist()], pa.list_(pa.float64()))], ["fold", "w", "row", "p"])

        each = docs.sparkSession.range(0, folds + 1, 1, folds + 1).select(F.col("id").cast("int").alias("fold"))
        models = map_arrow(each, fit, "fold int, w array<double>, row array<long>, p array<double>").collect()
        out = np.zeros(len(at))
        for m in models:
            if m.fold < folds:
                out[m.row] = m.p
            else:
                weights.append(np.array(m.w))
        given = np.column_stack([given, out])
    clean = given[rows.column(names[-1]).to_numpy() == 0, -1]
    threshold = float(np.clip(np.quantile(clean, 0.999), 0.1, 0.5)) if len(clean) else 0.5
    return Chain(names, known, weights, threshold)


def classify(docs: DataFrame, chain: Chain | None, text: str = "text") -> DataFrame:
    """docs plus p_<category> for each category of the chain and is_toxic: the last one reaches the threshold.

    Whole texts are scored, row by row and without a shuffle. A null or empty text has no features and gets what the
    intercepts give; repeated rows get the same. Without a chain all probabilities are 0. Empty docs give no rows; columns
    named like added ones are replaced."""
    names = chain.categories if chain else list(CATEGORIES)
    docs = docs.drop(*[f"p_{c}" for c in names], "is_toxic")
    if chain is None:
        return docs.select("*", *[F.lit(0.0).alias(f"p_{c}") for c in names], F.lit(False).alias("is_toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        find = _known(model.features)
        for batch in batches:
            for first, data, offsets in tv.slices(tv.lower(batch.column(text))):
                n = len(offsets) - 1
                h, row = features(data, offsets)
                at, of = find(h)
                pair = np.unique(row[of].astype(np.int64) << 32 | at)
                p = model.probabilities(pair & 0xFFFFFFFF, pair >> 32, n)
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[pa.array(p[:, c]) for c in range(len(names))], pa.array(p[:, -1] >= model.threshold)], [*part.schema.names, *[f"p_{c}" for c in names], "is_toxic"]
                )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *[f"p_{c} double" for c in names], "is_toxic boolean"])
    return map_arrow(docs, work, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, p_low_quality, p_toxic, is_toxic."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs.select("doc_id", "text"), fit_chain(docs, table(spark, sf_dir, "labels"))).drop("text")
