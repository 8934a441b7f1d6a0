"""Near-duplicate documents by DartMinHash over weighted five-word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import forget, map_arrow, sized, table, written
from .lsh import classes, parity_sketch, shared_keys, sketch_columns
from .textvec import U

N_WORDS, BANDS, ROWS, SKETCH_WORDS = 5, 24, 6, 16
_EMPTY = np.iinfo(np.uint64).max


def _poisson_cdf(area: float) -> np.ndarray:
    """Thresholds on 53 random bits: as many darts fall as thresholds are passed."""
    p, total, out, k = math.exp(-area), 0.0, [], 0
    while k < 40 and total < 1 - 1e-15:
        total += p
        out.append(min(total, 1.0))
        k += 1
        p *= area / k
    return (np.array(out) * 2.0**53).astype(U)


def dart_signatures(h: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, k: int) -> np.ndarray:
    """Weighted MinHash signatures, (docs, k) of 32-bit dart names: two sets agree in a coordinate with the probability of
    their weighted Jaccard similarity. h, weight, doc: hash, weight > 0 and document of each distinct element.

    Darts fall on the plane of (element and position within its weight, rank) with density one; which ones fall into a
    cell of that plane is decided by hashes of the cell alone, so that all documents see the same darts. A document takes
    the darts below its weights and below the rank at which about k ln k + 3k have been met, deals them to coordinates by
    hash and keeps the one of least rank in each. Documents with an empty coordinate double the rank. The work per
    document is about k ln k, however long it is. Documents without elements get the largest value throughout.
    """
    out = np.full(docs * k, _EMPTY, U)

    def throw(e: np.ndarray, begin, length: float, cell, layer: int, low: float, width: float) -> None:
        """The darts of one cell per element e: rank from begin, weight from low, named by (layer, cell)."""
        u = tv.mix(eh[e] ^ (U((layer << 40) + 1) + (cell if isinstance(cell, np.ndarray) else U(cell))))
        fallen = np.searchsorted(_poisson_cdf(length), u >> U(11), "right")
        nth = 0
        while (of := np.flatnonzero(fallen > nth)).size:
            g = tv.mix(u[of] + U((nth + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            g2 = tv.mix(g)
            mine = e[of]
            height = low + width * ((g >> U(32)).astype(float) / 2.0**32)
            rank = ((begin[of] if isinstance(begin, np.ndarray) else begin) + length * ((g2 >> U(24)).astype(float) / 2.0**40)) / width
            keep = (height < ew[mine]) & (rank < theta[mine])
            g2, mine, rank = g2[keep], mine[keep], rank[keep]
            value = (rank.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (tv.mix(g2) & U(0xFFFFFFFF))
            np.minimum.at(out, ed[mine].astype(np.int64) * k + ((g2 & U(0xFFFFFF)) % U(k)).astype(np.int64), value)
            nth += 1

    norm = np.bincount(doc, weight, minlength=docs)
    todo, darts = norm > 0, k * math.log(k) + 3 * k
    while todo.any():
        mine = todo[doc]
        eh, ew, ed = h[mine], weight[mine], doc[mine]
        theta = darts / norm[ed]
        low, width, layer = 0.0, 1.0, 0
        while True:  # layers of weight: [0, 1), [1, 2), [2, 4), ...
            tall = np.flatnonzero(ew > low)
            if not len(tall):
                break
            reach = theta[tall] * width  # ranks in units in which a cell's area is its length
            for begin, length, cell in ((0.0, 0.125, 0), (0.125, 0.125, 1), (0.25, 0.25, 2), (0.5, 0.5, 3)):
                throw(tall[reach > begin], begin, length, cell, layer, low, width)
            far = tall[reach > 1]  # cells of length one from there on, all at once
            cells = np.ceil(reach[reach > 1]).astype(np.int64) - 1
            nth_cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
            throw(np.repeat(far, cells), nth_cell + 1.0, 1.0, nth_cell.astype(U) + U(4), layer, low, width)
            low, width, layer = low + width, (width if layer == 0 else width * 2), layer + 1
        todo &= (out.reshape(docs, k) == _EMPTY).any(1)
        out.reshape(docs, k)[todo] = _EMPTY
        darts *= 2
    return (out & U(0xFFFFFFFF)).astype(np.uint32).reshape(docs, k) if docs else np.empty((0, k), np.uint32)


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end, row = tv.word_spans(data, offsets)
    return tv.occurrences(*tv.shingle_hashes(tv.span_hash(tv.prefix_sums(data), start, end), row, len(offsets) - 1, N_WORDS))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in tv.slices(tv.lower(batch.column("text"))):
            n = len(offsets) - 1
            h, r, nth = _shingles(data, offsets)
            first = np.flatnonzero(nth == 0)
            count = np.diff(np.append(first, len(h))).astype(float)
            sig = dart_signatures(h[first], count, r[first], n, BANDS * ROWS)
            keys = np.zeros((n, BANDS), U)
            for b in range(BANDS):
                key = np.full(n, b + 1, U)
                for c in range(b * ROWS, (b + 1) * ROWS):
                    key = tv.mix(key * U(31) + sig[:, c])
                keys[:, b] = key
            some = np.bincount(r, minlength=n) > 0
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(some * BANDS)).astype(np.int32), pa.array(keys[some].ravel().view(np.int64)))
            part = batch.slice(row, n)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h1"), part.column("h2"), lists], ["doc_id", "h1", "h2", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbered occurrences of shingles: the Jaccard similarity of such sets is the weighted one."""
    for batch in batches:
        for first, data, offsets in tv.slices(tv.lower(batch.column("text"))):
            rows = len(offsets) - 1
            h, row, nth = _shingles(data, offsets)
            h, row = tv.distinct(tv.mix(h + nth.astype(U) * U(0xD6E8FEB86659FD93)), row)
            n = np.bincount(row, minlength=rows)
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(h.view(np.int64)))
            marks = parity_sketch(h, row, rows, SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays([batch.slice(first, rows).column("id"), pa.array(n), *marks, lists], ["id", "n", *sketch_columns(SKETCH_WORDS), "payload"])


def _elements(payload: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(payload.offsets.to_numpy())
    return payload.flatten().to_numpy().view(U), np.repeat(np.arange(len(payload)), n)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id) for every row of docs: documents linked, directly or over others, by a weighted Jaccard
    similarity of 0.8 or more share a class, named by its smallest doc_id.

    The elements are five-word shingles (lower case, words of letters and digits) and their weights the number of times
    they stand in the text; a text of fewer words is one shingle. Equal texts are one class whatever they hold. Texts
    without a word, and null texts, equal nothing but themselves: each such row keeps its own doc_id, except equal
    texts that aren't null. Rows with a null doc_id are kept with a null class. Rows that repeat a doc_id are classed by
    their own texts. Empty docs give no rows; other columns of docs don't matter.
    """
    return classified(docs, id_col, text).select("doc_id", "class_id")


def classified(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """near_duplicates() with two hashes of the row's text, h1 and h2."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    prints = written(map_arrow(own.where("doc_id is not null and text is not null"), _bands, f"doc_id {kind}, h1 long, h2 long, keys array<long>"), "prints")
    texts = prints.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    shared = written(shared_keys(texts.select("id", F.explode("keys").alias("key"))), "bands")
    wanted = sized(texts.join(shared.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "h1", "h2"), "wanted")
    found = own.select("doc_id", "text", "h1", "h2").join(wanted, ["doc_id", "h1", "h2"]).select("id", "text")
    sets = written(map_arrow(found, _sets, "id long, n long, " + "".join(f"{c} long, " for c in sketch_columns(SKETCH_WORDS)) + "payload array<long>"), "sets")
    linked = written(classes(shared, sets, SKETCH_WORDS, _elements), "classes")
    forget(shared, sets, wanted)
    least = texts.join(linked, "id").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    of_text = texts.join(linked, "id", "left").join(least, "component", "left").select("h1", "h2", F.coalesce("class_id", "doc_id").alias("class_id"))
    # Copies of a text may be a third of all rows: the join is on the text's hash, unique on the right.
    named = prints.select("doc_id", "h1", "h2").join(of_text, ["h1", "h2"]).select("doc_id", "h1", "h2", "class_id")
    rest = own.where("doc_id is null or text is null").select("doc_id", "h1", "h2", F.col("doc_id").alias("class_id"))
    return named.unionByName(rest)


def op7(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, class_id (the smallest doc_id of its near-duplicate class), kept (the class is its own)."""
    return near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))
