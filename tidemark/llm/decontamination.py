"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answer checks."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textvec as tv
from .common import forget, map_arrow, numbered, sized, table, written
from .textvec import U

WINDOW, STRIDE = 48, 24
#: Parts of items in a latent space, its rank, and parts that are searched in one reading of the documents.
BLOCK_PARTS, RANK, PASS_PARTS = 256, 128, 2_048
#: Passes whose words are counted in one reading of the documents.
COUNTED_PASSES = 16
#: Pairs of words that a task sorts at once, distinct ones it holds before it gives them out, and rows of a batch it gives.
SORTED_PAIRS, HELD_PAIRS, GIVEN_PAIRS = 1 << 18, 1 << 19, 1 << 16
#: Counters of pairs of frequent words in a task, for all blocks of a pass together.
COUNTERS = 1 << 21
#: Places of words whose pairs, and passages whose latent vectors, a task makes at once.
PAIRED_PLACES, PROJECTED_WINDOWS = 2_048, 256
COSINE, COVER, LCS, ANSWER = 0.35, 0.4, 0.6, 0.5


@dataclass
class Block:
    """Parts of items, short ones whole, with a latent space of their own."""

    ids: list
    parts: list[tuple[int, int]]  # (first word, last word + 1) in the item
    words: list[list[int]]  # of the whole item of each part, as positions in the vocabulary
    keys: list[set[int]]  # the answer's words, or the five of the largest idf
    own: np.ndarray  # (vocabulary,): number of a term in this block, -1 for those of other blocks
    term: np.ndarray  # (terms, rank): latent vector of one occurrence of a term
    most: np.ndarray  # (terms,): the most that one occurrence of a term adds to the product with any part
    latent: np.ndarray  # (rank, parts), of length 1
    norm: np.ndarray  # (parts,): length of the latent vectors

    def __post_init__(self) -> None:
        """Which parts a term is a key of: parts of term t are key_parts[key_at[t] : key_at[t + 1]]."""
        pairs = np.array(sorted((t, i) for i, keys in enumerate(self.keys) for t in keys), np.int64).reshape(-1, 2)
        self.key_parts = pairs[:, 1]
        self.key_at = np.searchsorted(pairs[:, 0], np.arange(len(self.own) + 1))
        self.keys_needed = np.array([ANSWER * len(k) for k in self.keys])

    def with_keys(self, t: np.ndarray, row: np.ndarray) -> np.ndarray:
        """row * parts + part, sorted, where a whole text holds as many of a part's keys as a match needs. t, row: term (-1
        for others) and text of each word."""
        known = np.flatnonzero(t >= 0)
        n = (self.key_at[t[known] + 1] - self.key_at[t[known]]).astype(np.int64)
        known, n = known[n > 0], n[n > 0]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        part = self.key_parts[np.repeat(self.key_at[t[known]], n) + nth]
        of = np.repeat(row[known], n).astype(np.int64) * len(self.keys) + part
        terms = np.int64(len(self.own))
        pair, count = np.unique(np.unique(of * terms + np.repeat(t[known], n)) // terms, return_counts=True)
        return pair[count >= self.keys_needed[pair % len(self.keys)]]


def _words(batch_column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, word hashes, row of each word)."""
    for first, data, offsets in tv.slices(tv.lower(batch_column)):
        start, end, row = tv.word_spans(data, offsets)
        yield first, len(offsets) - 1, tv.span_hash(tv.prefix_sums(data), start, end), row


def _find(vocabulary: np.ndarray):
    """hashes -> their positions in the sorted vocabulary, -1 for others."""
    slot = np.full(1 << 18, -1, np.int32)
    slot[(vocabulary & U(0x3FFFF)).astype(np.int64)] = np.arange(len(vocabulary))

    def find(h: np.ndarray) -> np.ndarray:
        out = slot[(h & U(0x3FFFF)).astype(np.int64)].astype(np.int64)
        of = np.flatnonzero(out >= 0)
        of = of[vocabulary[out[of]] != h[of]]  # another word's slot, which may have taken it from this one
        at = np.minimum(np.searchsorted(vocabulary, h[of]), len(vocabulary) - 1)
        out[of] = np.where(vocabulary[at] == h[of], at, -1)
        return out

    return find


def _windows(term: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word + 1, row) of the windows of every text; the last window of a text ends with it."""
    begin = np.searchsorted(row, np.arange(rows + 1))
    n = np.diff(begin)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    of = np.repeat(np.arange(rows), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[of] + nth * STRIDE
    return start, np.minimum(start + WINDOW, begin[of + 1]), of


def _parts(n: int) -> list[tuple[int, int, bool]]:
    """(first word, last word + 1, whether the latent space is fitted on it) of the parts by which an item of n words is found.

    Two passages in a row, side by side, hold any text of WINDOW + STRIDE words, so one of them has half of it: up to
    there an item is a part. A longer item than a window is also cut into windows."""
    whole = n <= WINDOW + STRIDE
    starts = [*range(0, n - WINDOW, STRIDE), n - WINDOW] if n > WINDOW else []
    return [(0, n, True)] * whole + [(s, s + WINDOW, not whole) for s in starts]


def _sum_of_parts(table_: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.float64) for b in table_.column("z").to_pylist())
    return pa.table({"part": table_.column("part").slice(0, 1), "z": pa.array([total.tobytes()], pa.binary())})


def _summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts, which are taken out of the list."""
    keys, n = (np.concatenate(x) for x in zip(*counts))
    counts.clear()
    n = n[np.argsort(keys)]
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the span, place) of each place from first up to last of every span."""
    n = last - first
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def _place_pairs(term: np.ndarray, row: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of the windows of every text, over the terms of its words (-1: none): (terms of p, terms of q, number of windows that
    hold both) for all pairs of places p <= q with a term, and the same again for p < q of one term, which adds up to the
    products of counts.

    A window is two halves of STRIDE words, and a half is in two windows but at the ends of a text: pairs within a half are
    made once for both windows, besides those with the next half."""
    begin = np.searchsorted(row, np.arange(rows + 1))
    hits = np.flatnonzero(term >= 0)
    of, text = term[hits], row[hits]
    half = (hits - begin[text]) // STRIDE
    end = np.minimum(begin[text] + (half + 1) * STRIDE, begin[text + 1])
    own, both = np.searchsorted(hits, end), np.searchsorted(hits, np.minimum(end + STRIDE, begin[text + 1]))
    windows = np.maximum(0, -(-(np.diff(begin) - WINDOW) // STRIDE)) + 1
    twice = (half > 0) & (half < windows[text])
    place = np.arange(len(hits))
    for some, times in ((place[~twice], 1), (place[twice], 2)):
        yield of[some], of[some], times
    for a in range(0, len(hits), PAIRED_PLACES):
        some = place[a : a + PAIRED_PLACES]
        middle = some[twice[some]]
        for p, first, last, times in ((middle, middle + 1, own[middle], 2), (some, np.where(twice[some], own[some], some + 1), both[some], 1)):
            at, q = _spans(first, last)
            x, y = of[p[at]], of[q]
            yield x, y, times
            same = np.flatnonzero(x == y)
            yield x[same], y[same], times


def _pair_counts(vocabulary: np.ndarray, owns: list[np.ndarray], often: np.ndarray | None = None):
    """Of batches of texts: rows (block << 40 | i << 20 | j, number), a key several times at most if it is rare, and one of key
    -1 with the number of windows. Pairs of a block's terms that are `often` in the texts have a counter each, the others
    are sorted. What is held at once doesn't grow with a text or a batch."""
    most = int(np.sqrt(2 * COUNTERS / len(owns)))
    ranked = []  # of each block: its terms, frequent ones first, and the rank of each word of the vocabulary, -1 for others
    for own in owns:
        words = np.flatnonzero(own >= 0)
        if often is not None:
            words = words[np.argsort(-often[words], kind="stable")]
        rank = np.full(len(own), -1, np.int32)
        rank[words] = np.arange(len(words))
        ranked.append((own[words].astype(np.int64), rank))
    row_at = np.arange(most + 1, dtype=np.int64) * np.arange(1, most + 2) // 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, windows, new, size, held = _find(vocabulary), 0, [], 0, []
        counters = [np.zeros(row_at[min(most, len(terms))], np.int64) for terms, _ in ranked]

        def give(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys), GIVEN_PAIRS):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + GIVEN_PAIRS]) for x in (keys, n)], ["key", "n"])

        def key(b: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            terms, _ = ranked[b]
            return b << 40 | np.minimum(terms[x], terms[y]) << 20 | np.maximum(terms[x], terms[y])

        def fold() -> Iterator[pa.RecordBatch]:
            nonlocal new, size, held
            if size:
                keys = np.concatenate(new)
                keys.sort()
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                held.append((keys[first], np.diff(first, append=len(keys))))
            new, size = [], 0
            if sum(len(k) for k, _ in held) > 2 * HELD_PAIRS:
                held = [_summed(held)]
                if len(held[0][0]) > HELD_PAIRS:
                    yield from give(*held.pop())

        for batch in batches:
            for _, n, h, row in _words(batch.column(0)):
                t = find(h)
                windows += len(_windows(t, row, n)[0])
                for b, (_, rank) in enumerate(ranked):
                    for x, y, times in _place_pairs(np.where(t >= 0, rank[t], -1), row, n):
                        less, more = np.minimum(x, y), np.maximum(x, y)
                        frequent = more < most
                        np.add.at(counters[b], row_at[more[frequent]] + less[frequent], times)
                        if not frequent.all():
                            keys = key(b, x[~frequent], y[~frequent])
                            new += [keys] * times
                            size += len(keys) * times
                            if size > SORTED_PAIRS:
                                yield from fold()
        yield from fold()
        if held:
            yield from give(*_summed(held))
        for b, counter in enumerate(counters):
            for a in range(0, len(counter), GIVEN_PAIRS):
                cell = a + np.flatnonzero(counter[a : a + GIVEN_PAIRS])
                x = np.searchsorted(row_at, cell, "right") - 1
                yield from give(key(b, x, cell - row_at[x]), counter[cell])
        yield from give(np.array([-1]), np.array([windows]))

    return count


def products(texts: DataFrame, vocabulary: np.ndarray, owns: list[np.ndarray], often: np.ndarray | None = None) -> tuple[DataFrame, int]:
    """(table (block, i, j, n), windows of all texts), in one reading: the sum over all windows of the counts of terms i and j
    in it, both ways round, of each block, whose terms own[position in the vocabulary] numbers. At most the square of a
    block's terms, however many texts; whole numbers, so the same in any order. often: how frequent the vocabulary's words
    are, for speed alone."""
    counts = map_arrow(texts.select("text"), _pair_counts(vocabulary, owns, often), "key long, n long")
    # A task has added up its own counts, so a hash table of its keys before the shuffle would only hold them again.
    sums = written(counts.repartition("key").groupBy("key").agg(F.sum("n").alias("n")), "sums")
    windows = sums.where("key = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    i, j = F.expr("cast(key >> 20 & 1048575 as int)").alias("i"), F.expr("cast(key & 1048575 as int)").alias("j")
    half = sums.where("key >= 0").select(F.expr("cast(key >> 40 as int)").alias("block"), i, j, "n")
    both = half.unionByName(half.where("i < j").select("block", F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    rows = written(both.repartitionByRange("block", "i").sortWithinPartitions("block", "i"), "products")
    forget(sums)
    return rows, windows


def randomised_svd(rows: DataFrame, weight: np.ndarray, rank: int, more: np.ndarray, passes: int = 2, seed: int = 4) -> np.ndarray:
    """The leading right singular vectors (terms, rank) of a matrix A of counts times the terms' weights, of which `rows`
    (i, j, n) are products() of counts, and of the dense rows `more` below it.

    Subspace iteration from a random start: every task multiplies its rows of the products with the present basis, the
    parts (bounded: n_terms by rank) are summed by blocks of terms, and the driver orthonormalises their sum."""
    spark, n_terms, step = rows.sparkSession, more.shape[1], 256
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, rank)))[0]
    for _ in range(passes):
        basis = spark.sparkContext.broadcast(q.astype(np.float32))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z = {}
            for batch in batches:
                i, j, n = (batch.column(c).to_numpy() for c in ("i", "j", "n"))
                x = n * weight[i] * weight[j]
                for part in np.unique(i // step).tolist():
                    some = np.flatnonzero(i // step == part)
                    dense = np.zeros((min(step, n_terms - part * step), n_terms), np.float32)
                    dense[i[some] - part * step, j[some]] = x[some]
                    z[part] = z.get(part, 0) + (dense @ basis.value).astype(np.float64)
            for part, sums in z.items():
                yield pa.RecordBatch.from_arrays([pa.array([part * step], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["part", "z"])

        parts = map_arrow(rows, multiply, "part int, z binary").groupBy("part").applyInArrow(_sum_of_parts, "part int, z binary").collect()
        z = more.T @ (more @ q)
        for r in parts:
            got = np.frombuffer(r.z, np.float64).reshape(-1, rank)
            z[r.part : r.part + len(got)] += got
        values, turn = np.linalg.eigh(q.T @ z)
        q, _ = np.linalg.qr(z @ turn[:, ::-1])
        basis.unpersist()
    return q


def _item_words(items: pa.Table, column: str) -> list[np.ndarray]:
    """Word hashes of each item's text."""
    out: list[np.ndarray] = [np.empty(0, U)] * items.num_rows
    if column in items.column_names:
        for first, n, h, row in _words(items.column(column).combine_chunks().cast(pa.large_string())):
            for i in range(n):
                out[first + i] = h[row == i]
    return out


def frequencies(texts: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """(number of texts that hold each word of the vocabulary, number of texts), in one reading."""
    find, n_terms = _find(vocabulary), len(vocabulary)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            texts += batch.num_rows
            for _, n, h, row in _words(batch.column(0)):
                t = find(h)
                hit = t >= 0
                total += np.bincount(np.unique(row[hit].astype(np.int64) * n_terms + t[hit]) % n_terms, minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, some).astype(np.int32)), pa.array(np.append(texts, total[some]))], ["term", "n"])

    counts = map_arrow(texts.select("text"), held, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = counts.column("term").to_numpy(), counts.column("n").to_numpy()
    df = np.zeros(n_terms)
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


def build_index(texts: DataFrame, ids: list, hashes: list[np.ndarray], answers: list[np.ndarray], vocabulary: np.ndarray, idf: np.ndarray) -> list[Block]:
    """What one reading of the documents needs of the items of one pass; see screen(). vocabulary: all words of these items,
    ascending, with their idf over all documents.

    Each block of 256 parts of items has a latent space of rank 128 (half as many dimensions as parts, or fewer) over the
    words of its items. It is fitted on the TF-IDF passages of all texts, by the products of their terms' counts, and on the
    parts themselves, which weigh as much as the texts, so that rare items get directions too. A block has 6 MB at most, for
    256 parts of up to 72 words."""
    find, n_terms = _find(vocabulary), len(vocabulary)
    blocks = []
    words, keys, parts = {}, {}, []
    for i in range(len(ids)):
        if len(hashes[i]):
            words[i] = find(hashes[i]).tolist()
            rare = sorted(dict.fromkeys(words[i]), key=lambda t: -idf[t])[:5]
            keys[i] = {t for t in find(answers[i]).tolist() if t >= 0} or set(rare)
            parts += [(i, *p) for p in _parts(len(words[i]))]
    number = np.cumsum([0, *(fitted for *_, fitted in parts)])[:-1] // BLOCK_PARTS  # parts that aren't fitted stay with the next or a former one
    of_block, owns = [[p for p, at in zip(parts, number) if at == b] for b in np.unique(number)], []
    for block in of_block:
        terms = np.unique(np.concatenate([words[i] for i, *_ in block]))
        owns.append(np.full(n_terms, -1, np.int32))
        owns[-1][terms] = np.arange(len(terms))
        if len(terms) > 1 << 20:
            raise ValueError("items of more than 2**20 distinct words aren't searched for")
    if not owns:
        return []
    rows, n_rows = products(texts, vocabulary, owns, -idf)
    for b, (block, mine) in enumerate(zip(of_block, owns)):
        terms = np.flatnonzero(mine >= 0)
        tfidf = np.stack([np.bincount(mine[words[i][s:e]], minlength=len(terms)) * idf[terms] for i, s, e, _ in block])
        fitted = tfidf[[p[3] for p in block]]
        weight = np.sqrt(max(n_rows, 1) / max(len(fitted), 1))
        rank = min(len(terms), RANK, max(16, len(fitted) // 2))
        basis = randomised_svd(rows.where(F.col("block") == b), idf[terms], rank, fitted * weight)
        latent = tfidf @ basis
        norm = np.linalg.norm(latent, axis=1)
        term = (basis * idf[terms][:, None]).astype(np.float32)
        unit = (latent / np.maximum(norm, 1e-12)[:, None]).T.astype(np.float32)
        blocks.append(Block([ids[i] for i, *_ in block], [(s, e) for _, s, e, _ in block], [words[i] for i, *_ in block], [keys[i] for i, *_ in block], mine, term, np.maximum((term @ unit).max(1), 0), unit, norm.astype(np.float32)))
    forget(rows)
    return blocks


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def screen(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs plus matches, array<struct<item_id, cosine, lcs, answer>>: the items of the benchmark (item_id, text, and answer
    if there is one) that a text holds, whole or in other words.

    Passages are windows of 48 words, one every 24. A passage is a candidate for an item if the cosine of their latent
    vectors is 0.35 or more and it covers 0.4 of the item's vector, or both hold of a window of 48 words of a longer item;
    passages whose words can't add up to that, and texts that lack the words of the answer check, are left out before. A candidate matches if the longest common subsequence
    of its surroundings (24 words on both sides, and 1.5 times what the item has before and after that window) with the
    item has 0.6 or more of the item's words and half of the answer's words (without an answer: of the item's five
    rarest) are there. The best passage of each item counts.

    There is no shuffle of texts, and no text is written; each is read whole. Items are taken to the
    driver and to the tasks in passes of about 2,048 parts, dealt by a hash of item_id, so that what is held there doesn't
    grow with the benchmark. One pass takes two readings of docs, one to fit its spaces on all of them and one that
    returns the matches under two hashes of the text; for each 16 passes, one reading more counts the documents that hold their words. Items with a null id or no word are left
    out; item_id keeps its type; rows that repeat an item_id are one item with several texts. Null and empty texts match
    nothing. Empty docs give no rows; repeated rows get one result; a column named matches is replaced, all others stay."""
    item_kind = benchmark.schema["item_id"].dataType
    kind = f"array<struct<item_id: {item_kind.simpleString()}, cosine: double, lcs: double, answer: double>>"
    docs = docs.drop("matches")
    rows, names = numbered(docs)
    own_text = F.col(names[text])
    own = rows.select(own_text.alias("text"), F.xxhash64(own_text).alias("h1"), F.xxhash64(F.lit(1), own_text).alias("h2")).where("text is not null")
    answer = ["answer"] if "answer" in benchmark.columns else []
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text", *answer)
    parts = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")) / STRIDE + 1), F.lit(0))).first()[0]
    passes = max(1, -(-int(parts) // PASS_PARTS))
    items = items.withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)).cast("int"))
    found = []
    for first in range(0, passes, COUNTED_PASSES):
        some = items.where(F.col("pass").between(first, first + COUNTED_PASSES - 1)).orderBy("pass", "item_id", "text").toArrow()
        hashes, answers = _item_words(some, "text"), _item_words(some, "answer")
        words = np.unique(np.concatenate([np.empty(0, U), *hashes, *answers]))
        if not len(words):
            continue
        df, n_docs = frequencies(own, words)
        idf = np.log((n_docs + 1.0) / (df + 1.0)) + 0.1
        number, ids = some.column("pass").to_numpy(), some.column("item_id").to_pylist()
        for p in np.unique(number).tolist():
            a, b = np.searchsorted(number, (p, p + 1)).tolist()
            vocabulary = np.unique(np.concatenate([np.empty(0, U), *hashes[a:b], *answers[a:b]]))
            blocks = build_index(own, ids[a:b], hashes[a:b], answers[a:b], vocabulary, idf[np.searchsorted(words, vocabulary)]) if len(vocabulary) else []
            if blocks:
                found.append(written(_search(own, (vocabulary, blocks), kind, item_kind).withColumn("pass", F.lit(p)), "matches"))
    if not found:
        return docs.withColumn("matches", F.expr(f"cast(array() as {kind})"))
    every = functools.reduce(DataFrame.unionByName, found).groupBy("h1", "h2", "pass").agg(F.first("matches").alias("matches"))
    of_text = every.groupBy("h1", "h2").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    of_text = sized(of_text, "found", length=4 * F.size("matches"))
    held = rows.join(of_text, (F.xxhash64(own_text) == F.col("h1")) & (F.xxhash64(F.lit(1), own_text) == F.col("h2")), "left")
    return held.select(*[F.col(n).alias(c) for c, n in names.items()], F.coalesce("matches", F.expr(f"cast(array() as {kind})")).alias("matches"))


def _search(texts: DataFrame, index: tuple[np.ndarray, list[Block]], kind: str, item_kind) -> DataFrame:
    """(h1, h2, matches) of the texts (text, h1, h2) that match an item of the index."""
    shared = texts.sparkSession.sparkContext.broadcast(index)
    of_match = pa.list_(pa.struct([("item_id", to_arrow_type(item_kind)), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, blocks = shared.value
        find = _find(vocabulary)
        for batch in batches:
            for first, n, h, row in _words(batch.column("text")):
                best: list[dict[int, tuple]] = [{} for _ in range(n)]
                t = find(h)
                bounds = np.searchsorted(row, np.arange(n + 1))
                start, end, of = _windows(t, row, n)
                for block in blocks:
                    # A text without the keys that a match needs can't match, whatever its passages.
                    keyed = block.with_keys(t, row)
                    if not len(keyed):
                        continue
                    has_keys = np.zeros(n, bool)
                    has_keys[keyed // len(block.keys)] = True
                    mine = np.where(t >= 0, block.own[t], -1)
                    hits = np.flatnonzero(mine >= 0)
                    most = np.append(0.0, np.cumsum(block.most[mine[hits]], dtype=float))
                    a, b = np.searchsorted(hits, start), np.searchsorted(hits, end)
                    # A sum of the most that each word can add, below what the least item asks, rules a passage out.
                    heavy = np.flatnonzero(has_keys[of] & (b > a) & (most[b] - most[a] >= COVER * block.norm.min() * (1 - 1e-5)))
                    for some in np.array_split(heavy, max(1, -(-len(heavy) // PROJECTED_WINDOWS))):
                        if not len(some):
                            continue
                        lengths = b[some] - a[some]
                        which = np.repeat(a[some] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                        x = np.add.reduceat(block.term[mine[hits[which]]], np.cumsum(lengths) - lengths, axis=0)
                        dot = x @ block.latent
                        norm = np.maximum(np.linalg.norm(x, axis=1), 1e-12)
                        near_w, near_i = np.nonzero((dot >= COSINE * norm[:, None]) & (dot >= COVER * block.norm))
                        pair = of[some[near_w]].astype(np.int64) * len(block.keys) + near_i
                        held = keyed[np.minimum(np.searchsorted(keyed, pair), len(keyed) - 1)] == pair
                        for w, i in zip(near_w[held].tolist(), near_i[held].tolist()):
                            k = some[w]
                            d = of[k]
                            item, keys, (s, e) = block.words[i], block.keys[i], block.parts[i]
                            words = t[max(bounds[d], start[k] - STRIDE - s * 3 // 2) : min(bounds[d + 1], end[k] + STRIDE + (len(item) - e) * 3 // 2)].tolist()
                            answer = len(keys.intersection(words)) / len(keys)
                            if answer < ANSWER:
                                continue
                            lcs = lcs_length(item, words) / len(item)
                            if lcs >= LCS:
                                found = (lcs, answer, float(dot[w, i] / norm[w]))
                                best[d][block.ids[i]] = max(best[d].get(block.ids[i], found), found)
                some = [d for d in range(n) if best[d]]
                matches = [[{"item_id": i, "cosine": c, "lcs": s, "answer": w} for i, (s, w, c) in sorted(best[d].items())] for d in some]
                part = batch.slice(first, n).take(pa.array(some, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("h1"), part.column("h2"), pa.array(matches, of_match)], ["h1", "h2", "matches"])

    return map_arrow(texts.select("text", "h1", "h2"), work, f"h1 long, h2 long, matches {kind}")


def op4(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: doc_id, item_id, cosine, lcs, answer of every match."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = screen(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
