"""Fuzzy line deduplication: MinHash over character shingles, exact Jaccard verification, distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import textvec as tv
from .common import map_arrow, numbered, sized, table, written
from .lsh import classes, parity_sketch, shared_keys_once, sketch_columns
from .textvec import U

N_CHARS, BANDS, ROWS, SKETCH_WORDS = 8, 12, 5, 8
#: A line is frequent if it has more than one in so many of all lines; there are no more frequent lines than that.
FREQUENT = 10_000
_NONE = np.uint32(0xFFFFFFFF)
_FACTOR = 0x9E37_79B9_7F4A_7C15
_SPACE = b" \t\r\f\x0b"
_IS_SPACE = np.isin(np.arange(256), list(_SPACE))


def code_points(lines: list[str]) -> np.ndarray:
    """Texts one after the other, a newline between them."""
    return np.frombuffer("\n".join(lines).encode("utf-32-le"), np.uint32)


def spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start and end of each line."""
    breaks = np.flatnonzero(points == 10)
    return np.append(0, breaks + 1), np.append(breaks, len(points))


def char_shingles(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all N_CHARS-character shingles of spans, in order; a shorter span is one shingle, an empty one none."""
    c = points.astype(U)
    width, factor = 1, np.array([_FACTOR], U)  # an array: its products wrap without a warning
    while width < N_CHARS and len(c) > width:  # c: hashes of all runs of so many characters
        c = c[:-width] * factor + c[width:]
        width, factor = 2 * width, factor * factor
    n = end - start
    long = n >= N_CHARS
    count = np.where(long, n - N_CHARS + 1, n > 0)
    out = np.empty(count.sum(), U)
    row = np.repeat(np.arange(len(n)), count)
    inside = np.zeros(len(points) + 1, np.int8)
    inside[start[long]] = 1
    inside[end[long] - N_CHARS + 1] = -1
    of_long = long[row]
    out[of_long] = c[np.cumsum(inside, dtype=np.int8)[: len(c)].view(bool)] if long.any() else 0
    short = np.flatnonzero((n > 0) & ~long)
    if len(short):
        at, left = start[short], n[short]
        h = left.astype(U)
        for k in range(N_CHARS - 1):
            h = np.where(k < left, h * U(_FACTOR) + points[np.minimum(at + k, len(points) - 1)], h)
        out[~of_long] = h
    return tv.mix(out), row


def signatures(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """MinHash signatures of the rows that have shingles: (row numbers, their signatures).

    One hash per shingle: its upper half names the coordinate, where the least of its lower halves stays. A coordinate that
    got none takes the value of another, drawn by a hash of the coordinate and the attempt alone."""
    have = np.flatnonzero(np.bincount(row, minlength=rows))
    k = BANDS * ROWS
    at = np.zeros(rows, np.int64)
    at[have] = np.arange(len(have))
    sig = np.full(len(have) * k, _NONE, np.uint32)
    np.minimum.at(sig, at[row] * k + (((h >> U(32)) * U(k)) >> U(32)).astype(np.int64), h.astype(np.uint32) & np.uint32(0xFFFFFFFE))
    sig = sig.reshape(len(have), k)
    full = sig.copy()
    open_row, open_bin = np.nonzero(sig == _NONE)
    attempt = 0
    while len(open_row):
        attempt += 1
        taken = sig[open_row, (tv.mix(open_bin.astype(U) + U(attempt * 1_000_003)) % U(k)).astype(np.int64)]
        full[open_row, open_bin] = taken
        still = taken == _NONE
        open_row, open_bin = open_row[still], open_bin[still]
    return have, full


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per line that isn't blank: where it stands, two hashes, and band keys, which a line gets where the task meets
    it first (it remembers a bounded number of lines, so some get them again)."""
    seen: set[int] = set()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
        for a, b in _runs(sizes, 1 << 22) if len(sizes) else ():
            if len(seen) > 200_000:
                seen.clear()
            yield _lines_of(batch.slice(a, b - a), seen)


def _lines_of(batch: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
    text = batch.column("text").cast(pa.large_string())
    (_, data, offsets), *_ = tv.slices(text, len(text) + text.nbytes)
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))  # a null text is an empty line
    end = np.sort(np.concatenate([breaks, offsets[1:]]))
    per_text = 1 + np.diff(np.searchsorted(breaks, offsets))
    upto = np.append(0, np.cumsum(per_text))
    raw = data.tobytes()
    filled = end > start
    filled[filled] = [bool(raw[s:e].strip(_SPACE)) if b else True for s, e, b in zip(start[filled].tolist(), end[filled].tolist(), _IS_SPACE[data[start[filled]]].tolist())]
    kept = np.flatnonzero(filled)
    row = np.repeat(np.arange(len(text)), per_text)[kept]
    names = np.frombuffer(b"".join([xxh3_128_digest(raw[s:e]) for s, e in zip(start[kept].tolist(), end[kept].tolist())]), ">i8").reshape(-1, 2).astype(np.int64)
    first = np.sort(np.unique(names[:, 0], return_index=True)[1])
    first = first[[i not in seen for i in names[first, 0].tolist()]]
    seen.update(names[first, 0].tolist())
    low = tv.lower(text)
    keys = []
    for a, b in _runs(np.diff(offsets)):
        wanted = kept[first[slice(*np.searchsorted(kept[first], (upto[a], upto[b])))]] - upto[a]
        if len(wanted):
            points = code_points([t or "" for t in low.slice(a, b - a).to_pylist()])
            s, e = spans(points)
            keys.append(band_keys(signatures(*char_shingles(points, s[wanted], e[wanted]), len(wanted))[1]))
    has = np.zeros(len(kept), bool)
    has[first] = True
    flat = np.concatenate(keys).ravel().view(np.int64) if keys else np.empty(0, np.int64)
    ends = pa.array(np.append(0, np.cumsum(has * BANDS)).astype(np.int32), mask=np.append(~has, False))
    of = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc").take(of), batch.column("th").take(of), pa.array((kept - upto[row]).astype(np.int32)), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.ListArray.from_arrays(ends, pa.array(flat))],
        ["doc", "th", "no", "id", "id2", "keys"],
    )


def _runs(sizes: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` bytes each."""
    of = (np.cumsum(sizes) - sizes) // most
    cuts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(sizes)).tolist()
    yield from zip(cuts, cuts[1:])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS)"""
    out = np.empty((len(sig), BANDS), U)
    for b in range(BANDS):
        key = np.full(len(sig), b + 1, U)
        for c in range(b * ROWS, (b + 1) * ROWS):
            key = tv.mix(key * U(31) + sig[:, c])
        out[:, b] = key
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of texts, in lower case, with sketches of their shingles."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            lines, ids, ids2 = [], [], []
            for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
                parts = text.split("\n")
                for w in wanted:
                    lines.append(parts[w["no"]])
                    ids.append(w["id"])
                    ids2.append(w["id2"])
            low = tv.lower(pa.array(lines, pa.large_string()))
            for first, end in _runs(np.array([len(x) for x in lines], int)):
                rows, of = end - first, slice(first, end)
                h, row = _elements(low.slice(first, rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[of]), pa.array(ids2[of]), pa.array(np.bincount(row, minlength=rows)), *parity_sketch(h, row, rows, SKETCH_WORDS), low.slice(first, rows).cast(pa.string())],
                    ["id", "id2", "n", *sketch_columns(SKETCH_WORDS), "payload"],
                )


def _elements(payload: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of lines in lower case, sorted."""
    points = code_points(payload.to_pylist())
    return tv.distinct(*char_shingles(points, *spans(points)))


def _is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\f\x0b")) == ""


def _classes(rows: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(id, id2, component) of the lines that have a near one."""
    # A line that much of the corpus holds takes part once; the others as they come, once per batch.
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = F.broadcast(firsts.where(F.col("n") > max(1, total // FREQUENT)).select("id", "id2"))
    with_keys = lines.where("keys is not null").select("id", "id2", "keys")
    each = with_keys.join(frequent, ["id", "id2"], "left_anti").unionByName(with_keys.join(frequent, ["id", "id2"]).groupBy("id", "id2").agg(F.first("keys").alias("keys")))
    shared = written(shared_keys_once(each.select("id", F.explode("keys").alias("key"))), "bands")
    ids = sized(shared.select("id").distinct(), "candidates")
    wanted = firsts.join(ids, "id").groupBy(F.col("first.doc").alias("d"), F.col("first.th").alias("t")).agg(F.collect_list(F.struct(F.col("first.no").alias("no"), "id", "id2")).alias("wanted"))
    wanted = sized(wanted, "wanted", 4_000_000, 3 * F.size("wanted"))
    found = rows.join(wanted, F.expr("doc <=> d and th = t")).select("text", "wanted")
    schema = "id long, id2 long, n long, " + "".join(f"{c} long, " for c in sketch_columns(SKETCH_WORDS)) + "payload string"
    sets = written(map_arrow(found, _sets, schema).dropDuplicates(["id"]), "sets")
    return classes(shared, sets, SKETCH_WORDS, _elements).join(sets.select("id", "id2"), "id")


def _deduplicated(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, dict[str, str], Column, Column, Column]:
    """(rows, the names of docs in them, text left, lines that aren't blank, lines dropped)."""
    own, names = numbered(docs)
    doc, text = names[id_col], names[text_col]
    own = own.withColumn("th", F.xxhash64(text))
    rows = own.select(F.col(doc).alias("doc"), F.col(text).alias("text"), "th")
    kind = rows.schema["doc"].dataType.simpleString()
    lines = written(map_arrow(rows.select("doc", "text", "th"), _lines, f"doc {kind}, th long, no int, id long, id2 long, keys array<long>"), "lines")
    at = F.struct("doc", "th", "no")
    firsts = written(lines.groupBy("id", "id2").agg(F.min(at).alias("first"), F.count("*").alias("n")), "firsts")
    named = firsts.join(_classes(rows, lines, firsts), ["id", "id2"], "left")
    groups = named.where("component is not null").groupBy("component").agg(F.min("first").alias("keeper"))
    keepers = (
        named.where("component is not null").join(groups, "component").select("id", "id2", "keeper")
        .unionByName(named.where("component is null and n > 1").select("id", "id2", F.col("first").alias("keeper")))
    )
    dropped = lines.select("id", "id2", at.alias("at")).join(sized(keepers, "keepers"), ["id", "id2"]).where("not (at <=> keeper)")
    per_doc = sized(dropped.groupBy("at.doc", "at.th").agg(F.collect_set("at.no").alias("gone")), "dropped", 4_000_000, F.size("gone"))
    per_doc = per_doc.select(F.col("doc").alias("d"), F.col("th").alias("t"), "gone")
    own = own.join(per_doc, F.expr(f"{doc} <=> d and th = t"), "left")
    all_lines = F.split(text, "\n")
    # A set's difference, then a lookup each, so that the time grows with the lines alone; the lines are split once.
    stay = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    left = F.get(F.transform(F.array(all_lines), lambda parts: F.array_join(F.transform(stay(parts), lambda i: F.get(parts, i)), "\n")), 0)
    return (
        own,
        names,
        F.when(F.col("gone").isNull(), F.col(text)).otherwise(left),
        F.coalesce(F.size(F.filter(all_lines, lambda x: ~_is_blank(x))), F.lit(0)).cast("long"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every line kept once: of lines linked, directly or over others, by a Jaccard similarity of 0.8 or more of
    their 8-character shingles (lower case; a shorter line is one shingle), the one that stands first stays. Adds
    n_lines and n_dropped (0 for a null text).

    First is the order of doc_id (null before all), then of a hash of the text, then in the text. Blank lines stay. All
    rows stay, with the text that is left; it is empty if no line is. Rows that repeat both doc_id and text are one
    document and get one result. Empty docs give no rows; columns named like an added one are replaced, all others stay
    whatever their names.

    12 bands of 5 find a pair of the least similarity with a probability of 0.991. Bands and links go by one 64-bit hash
    of a line; of two lines that it doesn't tell apart, one takes part in them, and the second hash keeps the other out
    of the result. Joins back to the documents broadcast only what is counted small.
    """
    docs = docs.drop("n_lines", "n_dropped")
    rows, names, left, n_lines, n_dropped = _deduplicated(docs, id_col, text)
    return rows.select(*[(left if c == text else F.col(n)).alias(c) for c, n in names.items()], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """As dedup_lines(), with the columns of docs alone; those of dropped lines get the new length of their text in `length`."""
    rows, names, left, _, n_dropped = _deduplicated(docs, id_col, text)
    new = {text: left}
    if length is not None:
        new[length] = F.when(n_dropped > 0, F.length(left).cast(docs.schema[length].dataType)).otherwise(F.col(names[length]))
    return rows.select(*[new.get(c, F.col(n)).alias(c) for c, n in names.items()])


def op9(spark, sf_dir: str) -> DataFrame:
    """All documents after line deduplication: doc_id, text, n_lines, n_dropped."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
