"""Spelling variants: a positional q-gram inverted index with a count filter finds the words one edit apart."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, map_arrow, ship_package, sized, table, written

Q = 2
#: One replaced character destroys Q grams of either word, so two words one edit apart share all but Q of the longer's.
LOST = Q
SHORTEST, FEWEST, RATIO = 6, 5, 5
BLOCK_ROWS, BUCKET_ROWS = 4_096, 100_000
#: Grams whose frequency decides their order; all others count as rarer. Any order gives the same pairs.
RANKED_GRAMS = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def grams(word: str) -> list[str]:
    return [word[i : i + Q] for i in range(len(word) - Q + 1)]


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else len(a) + 1 == len(b) and a[k:] == b[k + 1 :])


def entries_of(word: str, rank: dict[str, int]) -> Iterator[tuple[str, int, int, bool]]:
    """(gram, length, position, whether only words longer by one are meant) under which a word is kept and looks.

    Two words one edit apart share, of the LOST + 1 rarest grams of each, one distinct gram at least, and of that gram's
    first LOST + 1 places one that the edit has left: an edit takes LOST places away at most and adds as many."""
    own = grams(word)
    rarest = sorted(own, key=lambda g: (rank.get(g, 0), g))[: LOST + 1]
    n, seen = len(word), set()
    for gram in set(rarest):
        at = -1
        for _ in range(LOST + 1):
            at = next((i for i in range(at + 1, len(own)) if own[i] == gram), -1)
            if at < 0:
                break
            seen |= {(gram, n, at, False), (gram, n + 1, at, True), (gram, n + 1, at + 1, True)}
    yield from seen


def near_in_list(rows: list[tuple[str, int, bool, int]], length: int, apart: bool) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of rows (word, n, longer, block) of one list whose words are one edit apart; j's word has `length`
    characters, i's has as many or one fewer. apart: of different blocks only.

    The list's words of that length are the index: postings by gram and position, ascending. A word merges the postings
    of its own grams (at the same position, or the next one where an insertion may have shifted them) by a heap, but for
    the longest ones: a word that reaches the bound is in one of the others, and is then looked up in those."""
    kept = [j for j, r in enumerate(rows) if not r[2]]
    postings: dict[tuple[str, int], list[int]] = {}
    for j in kept:
        for p, gram in enumerate(grams(rows[j][0])):
            postings.setdefault((gram, p), []).append(j)
    sets: dict[int, set[int]] = {}

    def holds(lists: list[list[int]], j: int) -> bool:
        for x in lists:
            if id(x) not in sets:
                sets[id(x)] = set(x)
            if j in sets[id(x)]:
                return True
        return False

    bound = max(length - Q + 1 - LOST, 1)
    for i, (word, _, longer, block) in enumerate(rows):
        slots = []
        for p, gram in enumerate(grams(word)):
            here = postings.get((gram, p), ())
            lists = [x for x in (here, postings.get((gram, p + 1), ())) if x] if longer else [here] if here[-1] > i else []
            if lists:
                slots.append(lists)
        if len(slots) < bound:
            continue
        slots.sort(key=lambda lists: len(lists[0]) if len(lists) == 1 else len(lists[0]) + len(lists[1]))
        some = len(slots) - bound + 1
        # Words of one length meet from the side of the first, so only what comes after it is merged.
        merged = [x if longer else x[bisect_right(x, i) :] for lists in slots[:some] for x in lists]
        for j, run in groupby(heapq.merge(*merged)):
            if apart and rows[j][3] == block:
                continue
            missing = bound - sum(1 for _ in run)
            left = bound - 1
            for lists in slots[some:]:
                if missing <= 0 or missing > left:
                    break
                missing -= holds(lists, j)
                left -= 1
            if missing <= 0 and one_edit(word, rows[j][0]):
                yield i, j


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for every two of the distinct words (word, n) that differ by exactly one inserted, deleted
    or replaced character, in both directions. Words of fewer than Q + LOST characters are compared by none.

    A list is a gram with a length and a position. Lists are cut into blocks of 4,096 rows, each two blocks being worked on by
    themselves, so a frequent gram is spread; many short lists share a task's group."""
    each = words.where(F.length("word") < 1_000).select(F.explode(F.sequence(F.lit(1), F.length("word") - Q + 1)).alias("p"), "word")
    counts = each.groupBy(F.expr(f"substring(word, p, {Q})").alias("gram")).count().orderBy(F.desc("count"), "gram").limit(RANKED_GRAMS)
    rank = {r["gram"]: r["count"] for r in counts.collect()}
    ranks = words.sparkSession.sparkContext.broadcast(rank)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for batch in batches:
            out = [(*e, w, n) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()) for e in entries_of(w, rank)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64()))],
                ["gram", "len", "pos", "longer", "word", "n"],
            )

    key = ["gram", "len", "pos"]
    entries = written(map_arrow(words.select("word", "n"), enter, "gram string, len int, pos int, longer boolean, word string, n long"), "entries")
    total = entries.count()
    lists = entries.groupBy(*key).agg(F.count("*").alias("rows"), F.min("longer").alias("none"))
    hot = sized(lists.where(F.col("rows") > BLOCK_ROWS).select(*key, F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")), "lists")
    dealt = entries.join(hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word"), "blocks").cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*key, F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "longer", "word", "n")
    buckets = max(1, -(-total // BUCKET_ROWS))

    def compare(group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_pylist() for c in ("gram", "len", "pos", "i", "j", "word", "n", "longer", "own")]
        out = []
        for (_, length, _, i, j), same in groupby(sorted(zip(*columns)), key=lambda r: r[:5]):
            rows = [r[5:] for r in same]
            if len(rows) > 1:
                out += [(rows[a][0], rows[a][1], rows[b][0], rows[b][1]) for a, b in near_in_list(rows, length, i < j)]
        out = sorted(set(out))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n", "near", "near_n"])

    ship_package(words.sparkSession)
    bucket = F.pmod(F.xxhash64(*key, "i", "j"), F.lit(buckets))
    found = dealt.groupBy(bucket.alias("bucket")).applyInArrow(compare, "word string, n long, near string, near_n long").distinct()
    found = written(found, "near")
    forget(entries)
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def with_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Distinct words (word, n) with form, root, n_near, form_n: a word's form is its near word of largest n (of equal
    ones the smallest in code-point order) if that has at least `ratio` times its n, else null; root is where forms lead,
    the word itself if it has none."""
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("has", F.coalesce(-F.col("best.n") >= ratio * F.col("n"), F.lit(False)))
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best.near")).alias("form"), F.when(F.col("has"), -F.col("best.n")).alias("form_n")), "forms")
    leads = written(found.where("form is not null").select("word", F.col("form").alias("root")), "leads")
    while True:  # each round doubles the steps taken; n grows by the ratio with each step
        onward = leads.select(F.col("word").alias("at"), F.col("root").alias("to"))
        further = leads.join(onward, F.col("root") == F.col("at"), "left")
        former, leads = leads, written(further.select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "leads")
        forget(former)
        if not leads.where("moved").limit(1).count():
            break
        leads = leads.select("word", "root")
    return found.join(leads.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def slips(doc: Column, run: Column, one_in: int = 199) -> Column:
    """The run of letters, without one of its characters where `one_in` divides the crc32 of `<doc>:<run>`."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fewest: int = FEWEST, shortest: int = SHORTEST) -> DataFrame:
    """(word, n) of the runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, A-Z in lower case, slips() applied, that
    have `shortest` characters and occur `fewest` times at least."""
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))
    each = docs.select(F.col(f"`{id_col}`").alias("doc"), F.explode(runs).alias("run")).select("doc", F.translate("run", _UPPER, _LOWER).alias("run"))
    words = each.select(slips(F.col("doc"), F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of all texts (words_of) with their forms and roots (with_forms). Null and empty texts have no words, a
    null id counts as an empty one, repeated rows count each, no rows give no words; other columns don't matter."""
    return with_forms(written(words_of(docs, id_col, text), "words"))


def op11(spark, sf_dir: str) -> DataFrame:
    """All documents: word, form, root, n, n_near, form_n."""
    return variants(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with recursive crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i::bigint, range(8)::bigint[]), lambda a, _: case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end) as c from range(256) g(i)
  )
), runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents
), pairs as materialized (
  select run, count(*) as n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from runs group by doc_id, run
), hashed as materialized (
  select run, n, xor(list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(0, len(x), 2), lambda k: ('0x' || x[k + 1 : k + 2])::bigint)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::bigint) as h
  from pairs, crc_table
), w as materialized (
  select word, sum(n)::bigint as n from (
    select case when h % 199 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from hashed
  ) where length(word) >= 6 group by word having sum(n) >= 5
), cut as materialized (
  select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from w, lateral (select unnest(range(1, length(word) + 1)) as i)
), near as materialized (
  select a.word, b.word as near from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select c.word, w.word from cut c join w on w.word = c.rest
  union select w.word, c.word from cut c join w on w.word = c.rest
), best as (
  select near.word, count(*) as n_near, min((-w.n, near.near)) as b from near join w on w.word = near.near group by near.word
), forms as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when -b[1] >= 5 * w.n then b[2] end as form, case when -b[1] >= 5 * w.n then -b[1] end as form_n
  from w left join best on best.word = w.word
), chain(word, tip) as (
  select word, word from forms union all select chain.word, forms.form from chain join forms on forms.word = chain.tip where forms.form is not null
)
select forms.word, forms.form, chain.tip as root, forms.n, forms.n_near, forms.form_n
from forms join chain on chain.word = forms.word join forms l on l.word = chain.tip and l.form is null
"""
