"""The ten operators against brute force, exact round trips, libraries and held-out labels; edge cases of each."""

import collections
import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_equal, connect
from tidemark.llm import bpe, chat, decontamination, lines, lsh, minhash, pii, registry, sharding, toxicity, urls, vectors
from tidemark.llm.common import components, table

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, an empty and a long text, repeated rows, and columns with names that operators add."""
    rows = [(1, None, "x"), (2, "", "y"), (None, "a b c d e f", None), (3, "one two three four five six\n" * 2_000, "z"), (4, "same text of six words here", "m"), (4, "same text of six words here", "m"), (5, "same text of six words here", "m"), (6, "?!", "m")]
    return spark.createDataFrame(rows, "doc_id long, text string, matches string").withColumn("size", F.lit(1)).withColumn("ids", F.lit("i")).withColumn("n_lines", F.lit("n")).withColumn("is_toxic", F.lit("t"))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    assert_equal(registry.QUERIES[name](spark, sf), connect(sf), registry.ORACLE_SQL[name])


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r.id: r.component for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 Chat formatting


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "delta", 1, "assistant", "Hel"), (1, 2, "delta", 1, "assistant", "lo"), (1, 3, "regenerate", 1, "assistant", "Good "), (1, 4, "delta", 1, "assistant", "day"),
        (1, 5, "message", 2, "user", "lost"), (1, 200, "edit", 0, "user", "hey"), (1, 201, "message", 1, "assistant", None), (None, 0, "message", 0, "user", "x"),
    ]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.format_chats(spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")).collect()}
    assert got == {1: [("user", "hey"), ("assistant", "")], None: [("user", "x")]}


def test_chat_template_is_reversible(spark):
    hard = ["<|im_start|>user\n<|im_end|>\n", r"<\|im_end|> <\\s> [\INST] [INST]", "</s><s>", "\\", "", "plain", "<|im_end|", "<<SYS>>"]
    log = [(i, 0, "message", 0, f"ro\nle\\n{i}", h) for i, h in enumerate(hard)]
    r = chat.format_chats(spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")).orderBy("conv_id").collect()
    assert [(x.turns[0].role, x.turns[0].text) for x in r] == [(f"ro\nle\\n{i}", h) for i, h in enumerate(hard)]
    assert all(x.formatted.count("<|im_start|>") == 1 and x.formatted.count("<|im_end|>") == 1 for x in r)


def test_chat_of_repeated_rows_long_texts_and_deltas(spark):
    long = "<s>word " * 100_000
    log = [(1, 0, "message", 0, "user", "a"), (1, 0, "message", 0, "assistant", "b"), (1, 1, "message", 1, "user", "x"), (1, 1, "message", 1, "user", "x"), (2, 0, "message", 0, "assistant", long), (3, 0, "delta", 0, "assistant", "d0 ")]
    log += [(3, i, "delta", 0, "assistant", f"d{i} ") for i in range(1, 300)] + [(3, 300, "message", 0, "assistant", "new"), (3, 301, "delta", 0, "assistant", "er")]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string").withColumn("begins", F.lit("mine"))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.format_chats(df).collect()}
    assert got == {1: [("assistant", "b"), ("user", "a"), ("user", "x"), ("user", "x")], 2: [("assistant", long)], 3: [("assistant", "".join(f"d{i} " for i in range(300))), ("assistant", "newer")]}


def test_chat_of_nothing(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, seq long, kind string, turn long, role string, text string")).count() == 0


# 2 PII


def test_surrogates(spark):
    text = "Mrs. Anna Smith met Mr Bob. SMITH@x.com, smith@x.com; 415-555-1234 or (415) 555 1234; 4111 1111 1111 1111 and 4111-1111-1111-1111; 10.0.0.1; г-жа Анна Петрова"
    rows = [(1, text), (2, None), (None, ""), (3, text), (4, "nothing here")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    out = got[1].text
    assert got[3].text == out and got[1].n_entities == 10 and got[2].text is None and got[2].n_entities is None and got[4].text == "nothing here"
    for entity in ("smith@x.com", "415-555-1234", "4111 1111", "10.0.0.1", "Smith", "Петрова"):
        assert entity not in out
    a, b = re.findall(r"[\w.]+@[\w.]+\w", out)
    assert a.lower() == b and a.split('@')[0].isupper()  # one person, both forms
    phones = [re.sub(r"\D", "", p) for p in re.findall(r"\d{3}-\d{3}-\d{4}|\(\d{3}\) \d{3} \d{4}", out)]
    assert len(phones) == 2 and len(set(phones)) == 1
    cards = re.findall(r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}", out)
    assert cards == [" ", "-"]
    assert re.search(r"Mrs\. [A-Z]\w+ [A-Z]\w+ met Mr [A-Z]\w+\.", out) and re.search(r"г-жа [А-Я][а-я]+ [А-Я][а-я]+", out)
    assert pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "other").where("doc_id = 1").first().text != out


def test_surrogates_stay_distinct(spark):
    names = [(i, f"Mr {a}{b}") for i, (a, b) in enumerate((x, y) for x in ["Al", "Bo", "Cy", "Di"] for y in "abcdefghij")]
    got = [r.surrogate for r in pii.dictionary(spark.createDataFrame([("ip", f"10.0.{i // 9}.{i % 9}") for i, _ in names], "kind string, canon string"), "k").collect()]
    assert len(set(got)) == len(names)


def test_names_never_run_out(spark):
    """More one-word surnames than four syllables can name, and one-letter addresses of one domain."""
    n = 200_000
    entities = spark.range(n).selectExpr("'name' kind", "concat('m|latin|', lower(hex(id + 1000000)), 'x') canon").unionByName(spark.range(26).selectExpr("'email' kind", "concat(char(97 + id), '@b.com') canon"))
    got = pii.dictionary(entities, "k")
    assert got.count() == n + 26 and got.select("kind", "surrogate").distinct().count() == n + 26
    assert got.join(entities.withColumnRenamed("canon", "surrogate"), ["kind", "surrogate"], "left_semi").isEmpty()


def test_surrogates_of_other_scripts_and_edges(spark, odd):
    rows = [(1, "王小明@例子.中国 und דוד@דוגמה.com и иван@пример.рф"), (2, "order 9807915762804490 and card 4845168114407329")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(x not in got[1].text for x in ("王小明", "例子", "דוד", "דוגמה", "иван", "пример")) and got[1].n_entities == 3
    assert re.search(r"[\u4e00-\u9fff]{3}@[\u4e00-\u9fff]{2}\.中国 und [\u0590-\u05ff]{3}@[\u0590-\u05ff]{5}\.com и [а-я]{4}@[а-я]{6}\.рф", got[1].text)
    assert "9807915762804490" in got[2].text and "4845168114407329" not in got[2].text and got[2].n_entities == 1
    odd = odd.withColumn("_mentions", F.lit("mine")).withColumn("row", F.lit("mine"))
    out = pii.pseudonymise(odd)
    assert out.columns == [*odd.columns, "n_entities", "text_before_sha256"] and out.where("_mentions = 'mine' and row = 'mine' and coalesce(n_entities, 0) = 0").count() == 8
    assert pii.pseudonymise(odd.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000 + "a.b@c.com")], "doc_id long, text string")
    assert pii.pseudonymise(long).where("n_entities = 1 and not contains(text, 'a.b@c.com')").count() == 1


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10


def kind_by_rules(m):
    digits = re.sub(r"\D", "", m)
    if "@" in m:
        return "email", m.lower()
    if re.fullmatch(r"[\d.]+", m) and m.count(".") == 3:
        return "ip", m
    if re.fullmatch("[0-9a-f]{32,64}", m) and re.search("[a-f]", m):
        return "secret", m
    if re.search(r"[+(]", m) or re.fullmatch(r"\d{3}[.-]\d{3}[.-]\d{4}", m):
        return "phone", digits
    return ("card", digits) if luhn(digits) == 0 else (None, m)


def test_whole_table_by_brute_force(spark):
    """Every entity of every kind, found again by other patterns: replaced in its format, alike everywhere, by one of its own."""
    found = re.compile(r"[^\W_][\w.%+-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<!\w)[0-9a-f]{32,64}(?!\w)|\+\d{1,3} \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d(?:[ -]?\d){12,18}(?![ -]?\d)")
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    surrogate, n_kinds = {}, collections.Counter()
    for r in pii.op2(spark, sf).collect():
        before, after = texts[r.doc_id] or "", r.text or ""
        a, b = found.findall(before), found.findall(after)
        kinds = [kind_by_rules(m) for m in a]
        assert found.sub("#", before) == found.sub("#", after) and len(a) == len(b) and sum(k is not None for k, _ in kinds) == (r.n_entities or 0)
        for x, y, (kind, name) in zip(a, b, kinds):
            other, new = kind_by_rules(y)
            assert kind == other and (kind is None) == (x == y) and [len(p) for p in re.split(r"\w", x)] == [len(p) for p in re.split(r"\w", y)] or kind in ("ip", "email")
            assert surrogate.setdefault((kind, name), new) == new
            n_kinds[kind] += 1
    mine = {k: v for k, v in surrogate.items() if k[0]}
    assert len({(k[0], v) for k, v in mine.items()}) == len(mine) and not {(k[0], v) for k, v in mine.items()} & set(mine)
    assert all(n_kinds[k] for k in ("email", "ip", "secret", "phone", "card", None))


def test_one_person_in_a_text(spark):
    """Titles, partial names and bare mentions of one person; others of the same surname; further kinds of numbers."""
    rows = [
        "Frau Anna Schmidt kam. Dr Anna Schmidt sprach; Frau Schmidt ging. Anna Schmidt und Schmidt. Schmidtchen blieb. Herr Bruno Schmidt",
        "Dr Anna Schmidt allein, Anna Schmidt, Schmidt; Frau OTTO und Otto",
        "IBAN DE89 3704 0044 0532 0130 00 und GB82WEST12345698765432, nicht DE89 3704 0044 0532 0130 01; 123-45-6789; 2001:db8::8a2e:370:7334 std::vector a::b 12:30; 030 1234567, 0.5",
    ]
    got = {r.i: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "i int, text string"), "k").collect()}
    m = re.fullmatch(r"Frau (\w+) (\w+) kam\. Dr (\w+) (\w+) sprach; Frau (\w+) ging\. (\w+) (\w+) und (\w+)\. Schmidtchen blieb\. Herr (\w+) (\w+)", got[0].text)
    a, s, *rest = m.groups()
    assert rest[:6] == [a, s, s, a, s, s] and rest[7] == s and rest[6] != a and a in pii.GIVEN["f", "latin"] and rest[6] in pii.GIVEN["m", "latin"]
    m = re.fullmatch(r"Dr ([\w-]+) (\w+) allein, ([\w-]+) (\w+), Schmidt; Frau ([A-Z]+) und Otto", got[1].text)  # neither `Schmidt` nor `Otto` stands behind a title so
    assert m and m[1] == m[3] and m[2] == m[4] == s and m[1] in pii.GIVEN["n", "latin"]
    text = got[2].text
    assert got[2].n_entities == 5 and all(x not in text for x in ("3704 0044 0532 0130 00", "WEST12345698765432", "123-45-6789", "8a2e", "030 1234567")) and "0130 01" in text and "std::vector a::b 12:30" in text
    number = lambda i: int("".join(str(int(c, 36)) for c in i[4:] + i[:4]))
    ibans = re.findall(r"DE\d\d(?: \d{4}){4} \d\d|GB\d\d[A-Z]{4}\d{14}", text)
    assert [number(i.replace(" ", "")) % 97 for i in ibans] == [1, 1, number("DE89370400440532013001") % 97][: len(ibans)] or sum(number(i.replace(" ", "")) % 97 == 1 for i in ibans) == 2
    assert re.search(r"; \d{3}-\d{2}-\d{4}; [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4} std.*; 0\d\d \d{7}, 0\.5", text)


def test_names_of_the_whole_table_by_brute_force(spark, sf):
    """Names woven into every document, found again by plain code: one surrogate for each surname everywhere, none that is a
    surname itself, the same person throughout a text, and no name left in its own text."""
    titles = pii.TITLE.split("|")
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    first, last = ["Anna", "Bruno", "Иван", "Zoë"], ["Schmidt", "O'Neill", "Müller-Lang", "Петров", "Vega", "Li"]
    texts = {}
    for r in docs:
        i = r.doc_id
        title, other, given, surname = titles[i % len(titles)], titles[i * 7 % len(titles)], first[i % 4], f"{last[i % 6]}{'abcdefgh'[i % 8]}"
        words = (r.text or "").split(" ")
        woven = [f"{title} {given} {surname},", *words[: len(words) // 2], f"{other}. {surname};", *words[len(words) // 2 :], f"({given} {surname})", f"von {surname}."]
        texts[i] = " ".join(woven if i % 3 else [w for w in woven if w != f"{other}. {surname};"])
    out = pii.pseudonymise(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "k")
    word = r"[^\W\d_](?:[^\W\d_]|['’-])+"
    titled = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(titles)})\.?[ \xa0]({word})(?:[ \xa0]({word}))?")
    upper = lambda w: w is not None and w[0].isupper()
    named = lambda t: [(m[1], m[2] if upper(m[2]) else None) for m in titled.finditer(t) if upper(m[1])]
    alone = lambda full, t: re.search(rf"(?<![^\W\d_]){re.escape(full)}(?![^\W\d_])", t)
    surnames, n = {}, 0
    for r in out.collect():
        before, after = named(texts[r.doc_id]), named(r.text)
        assert len(before) == len(after) >= 1
        for (a, b), (c, d) in zip(before, after):
            assert (b is None) == (d is None) and surnames.setdefault((b or a).lower(), (d or c).lower()) == (d or c).lower()
            assert not alone(a if b is None else f"{a} {b}", r.text) and alone(c if d is None else f"{c} {d}", re.sub(rf"(?:{'|'.join(titles)})\.? ", "", r.text))
            n += 1
        (given, surname), *rest = after
        assert r.text.endswith(f"({given} {surname}) von {surname if rest else before[0][1]}.")
    assert n > 300 and len(set(surnames.values())) == len(surnames) and not set(surnames.values()) & set(surnames)


# 3 Toxicity


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    chain = toxicity.fit_chain(docs, labels.where("doc_id % 4 <> 0"))
    held = labels.where("doc_id % 4 = 0")
    r = toxicity.classify(docs.select("doc_id", "text"), chain).join(held, "doc_id").select("toxic", "is_toxic").toPandas()
    hit = (r.toxic == 1) & r.is_toxic
    assert hit.sum() / r.is_toxic.sum() > 0.95 and hit.sum() / (r.toxic == 1).sum() > 0.75
    assert [len(w) for w in chain.weights] == [len(chain.features) + c + 1 for c in range(len(chain.categories))]


def test_chain_by_brute_force(spark, sf):
    """The same chain over dense matrices: features by their definition, folds, out-of-fold inputs, threshold."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    chain = toxicity.fit_chain(docs, labels, max_rows=60, per_category=40)
    y = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(60).join(docs, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()

    def words_and_beginnings(text):
        return {(0, w) for w in words(text)} | {(n, w.encode()[:n]) for w in words(text) for n in toxicity.PREFIXES if len(w.encode()) > n}

    bags = [words_and_beginnings(r.text) for r in y]
    hashed = {}
    for n, w in set().union(*bags):
        raw = np.frombuffer(w.encode() if n == 0 else w + b"z", np.uint8)
        h, _ = toxicity.features(raw, np.array([0, len(raw)]))
        hashed[n, w] = int(h[0] if n == 0 else h[1 + toxicity.PREFIXES.index(n)])
    at = {h: i for i, h in enumerate(chain.features.tolist())}
    x = np.zeros((len(y), len(at)))
    for i, bag in enumerate(bags):
        for f in bag:
            if hashed[f] in at:
                x[i, at[hashed[f]]] = 1
    fold = np.arange(len(y)) % 3

    def fitted(x, t, n):
        w = np.zeros(x.shape[1] + 1)
        w[-1] = np.log((t.mean() + 1e-3) / (1 - t.mean() + 1e-3))
        m, v, one = np.zeros_like(w), np.zeros_like(w), np.column_stack([x, np.ones(len(x))])
        for k in range(1, 301):
            g = one.T @ (1 / (1 + np.exp(-one @ w)) - t) / len(t) + 3e-5 * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.1 * (1 - k / 301) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-10)
        return w

    given = x
    for c, t in enumerate([np.array([float(r.quality == 0) for r in y]), np.array([float(r.toxic) for r in y])]):
        assert np.allclose(chain.weights[c], fitted(given, t, c), atol=1e-3)
        out = np.zeros(len(y))
        for k in range(3):
            w = fitted(given[fold != k], t[fold != k], c)
            out[fold == k] = 1 / (1 + np.exp(-(given[fold == k] @ w[:-1] + w[-1])))
        given = np.column_stack([given, out])
    assert chain.threshold == pytest.approx(np.clip(np.quantile(given[t == 0, -1], 0.999), 0.1, 0.5), abs=1e-3)


def test_toxicity_edges(spark, odd):
    assert toxicity.classify(odd, None).where("not is_toxic and p_toxic = 0").count() == 8
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit_chain(odd, none) is None
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 1), (4, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(odd, toxicity.fit_chain(odd, labels)).count() == 8


# 4 Decontamination


def test_contamination_equals_brute_force(spark, sf, texts):
    items = {r.item_id: words(r.text) for r in table(spark, sf, "benchmark").collect()}
    expected = set()
    for d, text in texts.items():
        w = words(text)
        at = collections.defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        for i, item in items.items():
            starts = {p - k for k in range(len(item) - 2) for p in at.get(tuple(item[k : k + 3]), ())}
            if any(decontamination.lcs_length(item, w[max(0, p - 24) : p + len(item) + 24]) >= 0.6 * len(item) for p in starts):
                expected.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontamination.op4(spark, sf).collect()}
    assert expected and len(got & expected) >= 0.9 * len(expected) and got <= expected


def test_paraphrase_and_edges(spark, odd):
    item = "the quick brown foxes often jumped across seven sleepy hounds beside that muddy river bank yesterday evening"
    moved = "filler " * 300 + "the quick brown foxes sometimes jumped across seven sleepy dogs beside that muddy river bank yesterday evening " + "other " * 300
    docs = odd.select("doc_id", "text", "matches").unionByName(spark.createDataFrame([(10, moved, None), (11, "filler other " * 50, None)], "doc_id long, text string, matches string"))
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, "x")], "item_id long, text string")
    got = {r.doc_id: [m.item_id for m in r.matches] for r in decontamination.screen(docs, bench).collect()}
    assert got[10] == [7] and not any(v for k, v in got.items() if k != 10)
    assert decontamination.screen(docs, bench.limit(0)).where("size(matches) > 0").count() == 0


def test_items_longer_than_a_window(spark):
    rng = np.random.default_rng(4)
    item = {i: [f"w{x}" for x in rng.integers(0, 5_000, n)] for i, n in ((1, 300), (2, 130), (3, 60), (4, 20), (5, 700))}
    filler = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5_000, n))
    reworded = lambda w: [f"x{i}" if i % 4 == 1 else x for i, x in enumerate(w)]
    held = [(10 * i + j, f"{filler(37 * i)} {' '.join(f(w))} {filler(200)}") for i, w in item.items() for j, f in enumerate((list, reworded))]
    none = [(90, filler(2_000)), (91, " ".join(item[1][:150])), (92, " ".join(item[5][350:]))]
    docs = spark.createDataFrame(held + none, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w), f"{w[0]} {w[2]}") for i, w in item.items()], "item_id long, text string, answer string")
    got = {r.doc_id: [m.item_id for m in r.matches] for r in decontamination.screen(docs, bench).collect()}
    assert got == {d: [d // 10] for d, _ in held} | {d: [] for d, _ in none}


def test_recall_of_paraphrases(spark):
    """More items than the rank of their space; each stands once in other words (a quarter changed) among running text."""
    rng = np.random.default_rng(11)
    p = 1 / np.arange(1, 4_001)
    draw = lambda n: [f"w{x}" for x in rng.choice(4_000, n, p=p / p.sum())]
    items = {i: draw(int(rng.integers(16, 60))) for i in range(300)}
    held = [(i, " ".join(draw(150) + [f"x{j}" if j % 4 == 2 else w for j, w in enumerate(item)] + draw(150))) for i, item in items.items()]
    clean = [(1_000 + i, " ".join(draw(400))) for i in range(200)]
    docs = spark.createDataFrame(held + clean, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w), f"{w[0]} {w[3]} {w[-1]}") for i, w in items.items()], "item_id long, text string, answer string")
    got = {r.doc_id: {m.item_id for m in r.matches} for r in decontamination.screen(docs, bench).collect()}
    found, wrong = sum(i in got[i] for i in items), sum(bool(got[d]) for d, _ in clean)
    assert found >= 0.9 * len(items) and wrong <= 2, (found, wrong)


def test_lcs():
    assert decontamination.lcs_length([1, 2, 3, 2, 4], [2, 9, 3, 4, 4]) == 3 and decontamination.lcs_length([1], []) == 0


# 5 Sharding


def test_shards_are_even_and_gapless(spark, sf, docs, texts):
    rows = sharding.op5(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by = collections.defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by[r.shard].append(r.slot)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shuffle_is_repeatable_and_uniform(spark, docs):
    a, b, c = ([(r.shard, r.slot) for r in sharding.two_pass_shuffle(docs, 4, 20_000, seed).orderBy("doc_id").collect()] for seed in (1, 1, 2))
    assert a == b != c
    order = np.argsort([s * 10_000 + t for s, t in a])
    assert abs(np.corrcoef(np.arange(len(a)), order)[0, 1]) < 0.25


def test_sharding_edges(spark, odd):
    r = sharding.two_pass_shuffle(odd, 3, 1_000).collect()
    assert len(r) == 8 and sorted(collections.Counter(x.shard for x in r).values()) == [2, 3, 3]
    assert sharding.two_pass_shuffle(odd.limit(0)).count() == 0
    maps = odd.withColumn("extra", F.create_map(F.lit("k"), "text")).withColumn("shard", F.lit("mine"))
    assert sorted(x.extra["k"] or "" for x in sharding.two_pass_shuffle(maps, 3, 1_000).collect()) == sorted(x.text or "" for x in odd.collect())


def test_a_bucket_is_a_task(spark, docs):
    files = [f for f in sharding.two_pass_shuffle(docs, 4, 10_000).inputFiles() if "/buckets-" in f]
    written = spark.read.parquet(*files).select("bucket", F.input_file_name().alias("file")).distinct()
    assert len(files) > 20 and written.groupBy("file").count().where("count > 1").isEmpty() and written.groupBy("bucket").count().where("count > 1").isEmpty()


# 6 BPE


def test_bpe_equals_library(spark, sf, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.public_vocabulary())
    got = {r.doc_id: r for r in bpe.op6(spark, sf).collect()}
    for d, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_automaton_on_hard_texts():
    from tokenizers import Tokenizer

    with open(bpe.public_vocabulary(), "rb") as f:
        c = bpe.Codec(f.read())
    t = Tokenizer.from_file(bpe.public_vocabulary())
    rng = np.random.default_rng(0)
    hard = ["a" * 500, "<|endoftext|>x<|endoftext|>", "it's  I'LL\n\n we'll\t", "日本語 👩‍👩‍👧 \x00\x1c\x85 x", "=====----=====", "", "日本語の長い文" * 3_000]
    hard += ["".join(map(chr, rng.integers(1, 0x2FFF, 400))) for _ in range(5)]
    hard += [t.decode(rng.integers(0, 50256, 60).tolist()) for _ in range(200)]
    expected = [t.encode(h, add_special_tokens=False).ids for h in hard]
    assert c.encode(hard) == expected
    assert [c.decode(ids) for ids in expected] == [t.decode(ids, skip_special_tokens=False) for ids in expected]


def test_automaton_tables():
    """Arcs by the definition, on a small vocabulary: a pair of tokens is an arc if merging its bytes gives that pair. One
    arc of each label at most leaves a state, and each prefix of a word ends in one state."""
    rng = np.random.default_rng(1)
    parts, merges = ["a", "b", "c"], []

    def merged(word):
        at = list(word)
        while True:
            k = min((merges.index(p) for p in zip(at, at[1:]) if p in merges), default=None)
            if k is None:
                return at
            out, i = [], 0
            while i < len(at):
                two = tuple(at[i : i + 2]) == merges[k]
                out.append("".join(at[i : i + 1 + two]))
                i += 1 + two
            at = out

    while len(merges) < 60:  # as in training: a merge joins a pair that stands in a text
        u, v = (str(rng.choice(parts)) for _ in range(2))
        if len(u + v) < 9 and u + v not in parts and merged(u + v) == [u, v]:
            merges.append((u, v))
            parts.append(u + v)
    vocab = {p: i for i, p in enumerate(parts)}
    a = bpe.Automaton(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": [list(m) for m in merges]}}).encode())
    n = len(parts)
    got = a.has_arc(np.repeat(np.arange(n), n), np.tile(np.arange(n), n)).reshape(n, n)
    assert (got == np.array([[merged(u + v) == [u, v] for v in parts] for u in parts])).all() and a.has_arc(np.full(n, a.start), np.arange(n)).all()
    words_ = ["".join(rng.choice(["a", "b", "c"], int(rng.integers(1, 30)))) for _ in range(300)]
    paths = a.encode_words([w.encode() for w in words_])
    assert [[parts[i] for i in p] for p in paths] == [merged(w) for w in words_]
    for w in words_[:50]:
        ends = [t for t in range(n) if w.endswith(parts[t]) and (w == parts[t] or got[vocab[merged(w[: -len(parts[t])])[-1]], t])]
        assert len(ends) == 1


def test_vocabularies_that_ask_for_more():
    rules = json.loads(open(bpe.public_vocabulary(), "rb").read())
    assert bpe.unmet(rules) == []
    changes = [
        ("normalizer", {"type": "NFC"}), ("pre_tokenizer", rules["pre_tokenizer"] | {"add_prefix_space": True}), ("pre_tokenizer", rules["pre_tokenizer"] | {"use_regex": False}), ("pre_tokenizer", {"type": "Whitespace"}),
        ("pre_tokenizer", None), ("decoder", {"type": "WordPiece"}), ("model", rules["model"] | {"ignore_merges": True}), ("model", rules["model"] | {"byte_fallback": True}), ("added_tokens", [rules["added_tokens"][0] | {"lstrip": True}]),
    ]
    for key, value in changes:
        with pytest.raises(ValueError):
            bpe.Automaton(json.dumps(rules | {key: value}).encode())


def test_bpe_edges(spark, odd):
    v = bpe.public_vocabulary()
    r = {x.doc_id: x for x in bpe.decode(bpe.encode(odd, v), v).collect()}
    assert r[1].decoded == "" and r[2].ids == [] and r[5].decoded == r[5].text and r[3].decoded == r[3].text


# 7 MinHash


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a = rng.integers(1, 9, 300).astype(float)
    b = a.copy()
    b[:40] = 0
    b[50:60] += 2
    s = minhash.dart_signatures(np.concatenate([h, h[b > 0]]), np.concatenate([a, b[b > 0]]), np.repeat([0, 1], [300, (b > 0).sum()]), 2, 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def near_classes(ids, texts):
    bags = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else {} for t in texts]
    at = collections.defaultdict(list)
    for i, s in enumerate(bags):
        for k in s:
            at[k].append(i)
    edges = []
    for i, s in enumerate(bags):
        for j in {j for k in s for j in at[k] if j > i}:
            both = sum((s & bags[j]).values())
            if both >= 0.8 * (sum(s.values()) + sum(bags[j].values()) - both):
                edges.append((i, j))
    return {ids[i]: ids[r] for i, r in enumerate(roots(len(ids), edges))}


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(2_000)]
    bases = [list(rng.choice(vocabulary, 120)) for _ in range(12)]
    texts = []
    for i in range(150):
        t = list(bases[i % 12]) if i % 3 else list(rng.choice(vocabulary, 60))
        for _ in range(i % 4):
            t[int(rng.integers(len(t)))] = str(rng.choice(vocabulary))
        texts.append(" ".join(t))
    ids = list(range(150))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    assert got == near_classes(ids, texts)


def test_a_large_group_of_near_copies(spark):
    """Copies of one text, each with other changes, so that many share keys and are near only some of the others."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5_000, 100)]
    texts = []
    for i in range(400):
        t = list(base)
        for at in rng.choice(100, int(rng.integers(1, 5)), replace=False):
            t[at] = f"x{rng.integers(0, 5_000)}"
        texts.append(" ".join(t))
    ids = list(range(400))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    expected = near_classes(ids, texts)
    assert len(set(expected.values())) > 3 and np.mean([got[i] == expected[i] for i in ids]) > 0.98
    named = spark.createDataFrame([(f"d{i:03}", t) for i, t in zip(ids, texts)], "doc_id string, text string")
    assert {int(r.doc_id[1:]): int(r.class_id[1:]) for r in minhash.near_duplicates(named).collect()} == got


def test_keys_lose_no_link(spark, monkeypatch):
    """All pairs of three hot keys by brute force, some links only between members that no leader is near."""
    rng = np.random.default_rng(6)
    pools = [rng.integers(0, 2**62, 60) for _ in range(6)]
    sets = [np.unique(np.append(rng.choice(pools[i % 6], int(rng.integers(48, 60)), replace=False), rng.integers(0, 2**62, int(rng.integers(0, 9))))) for i in range(300)]
    marks = lsh.parity_sketch(np.concatenate(sets).astype(np.uint64), np.repeat(np.arange(300), [len(s) for s in sets]), 300, 4)
    table_ = spark.createDataFrame(pa.table([pa.array(range(300)), pa.array([len(s) for s in sets]), *marks, pa.array([s.tolist() for s in sets])], ["id", "n", *lsh.sketch_columns(4), "payload"]))
    keys = [(k, i) for k in range(3) for i in range(300) if k == 0 or i % (k + 1) == 0]
    monkeypatch.setattr(lsh, "BLOCK_ROWS", 40)
    got = {r.id: r.component for r in lsh.classes(spark.createDataFrame(keys, "key long, id long"), table_, 4, minhash._elements).collect()}
    edges = [(i, j) for i in range(300) for j in range(i + 1, 300) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))]
    root = roots(300, edges)
    assert got == {i: root[i] for i in range(300) if root.count(root[i]) > 1} and len(set(root)) > 5


def test_near_duplicate_edges(spark, odd):
    got = collections.Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(odd).collect())
    assert got == {(1, 1): 1, (2, 2): 1, (None, None): 1, (3, 3): 1, (4, 4): 2, (5, 4): 1, (6, 6): 1}
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


# 8 Vectors


def test_vector_edges_and_recall(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + 0.12 * rng.standard_normal(16)], int(i % 2)) for i in range(300)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, rows[0][1], None), (1004, rows[0][1], 0), (1005, [], 0), (1006, [None] + [1.0] * 15, 0)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [r for r in rows if r[0] < 1000 or r[0] == 1004]
    x = np.array([np.array(r[1], np.float32).astype(float) for r in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in good])
    link = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    root = roots(len(good), np.argwhere(np.triu(link)).tolist())
    for i, r in enumerate(good):
        assert (got[r[0]].n_links, got[r[0]].component_id) == (link[i].sum(), good[root[i]][0])
    for i in (1000, 1001, 1002, 1003, 1005, 1006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_of_a_large_label(spark):
    """One label with blocks that hold no pair, beside many labels of one vector; repeated ids; a clashing column."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4_500, 32))
    x[100] = x[4_000] + 0.01 * rng.standard_normal(32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5_000 + i, rng.standard_normal(32).tolist(), 1 + i) for i in range(30)] + [(7, x[7].tolist(), 0), (8, x[9].tolist(), 0)]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("g", F.lit("mine"))
    got = collections.defaultdict(list)
    for r in vectors.near_duplicates(table_).collect():
        got[r.vec_id].append((r.n_links, r.component_id))
    linked = {i: sorted(v) for i, v in got.items() if any(n for n, _ in v)}
    assert linked == {100: [(1, 100)], 4_000: [(1, 100)], 7: [(1, 7), (1, 7)], 8: [(0, 8), (1, 8)], 9: [(1, 8)]} and sum(map(len, got.values())) == len(rows)


@pytest.mark.parametrize("kind", ["random", "topical"])
def test_vectors_of_many_lists(spark, monkeypatch, kind):
    """One label of 20,000 vectors in 256 lists, with pairs at and above the threshold: asks are bounded, few links are missed,
    none is wrong."""
    monkeypatch.setattr(vectors, "LIST_ROWS", 80)
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(rng.standard_normal((19_000, 64)))
    if kind == "topical":
        x = unit(unit(rng.standard_normal((40, 64)))[rng.integers(0, 40, 19_000)] + 0.6 * x)
    side = rng.standard_normal((1_000, 64))
    side = unit(side - (side * x[:1_000]).sum(1)[:, None] * x[:1_000])
    cos = rng.uniform(0.9305, 0.99, 1_000)[:, None]
    x = np.concatenate([x, cos * x[:1_000] + np.sqrt(1 - cos**2) * side])
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>, label int")
    asked = []
    written = vectors.written
    monkeypatch.setattr(vectors, "written", lambda d, name: (t := written(d, name), asked.append(t) if name == "index" else None)[0])
    got = {r.vec_id: r for r in vectors.near_duplicates(frame).collect()}
    x32 = unit(x.astype(np.float32).astype(float))
    expected = np.zeros(len(x), int)
    for a in range(0, len(x), 2_000):
        expected[a : a + 2_000] = (x32[a : a + 2_000] @ x32.T >= 0.93).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert expected.sum() >= 2_000 and (found <= expected).all() and found.sum() >= 0.99 * expected.sum()
    probes, most, lists = asked[0].agg(F.avg(F.size("probes")), F.max(F.size("probes")), F.max("lists")).first()
    assert lists == 256 and most <= vectors.PROBES and probes <= vectors.PROBES / 2 + 1


# 9 Lines


def test_lines_equal_brute_force(spark, texts):
    docs = {d: texts[d] for d in sorted(texts)[:120]}
    every = [(d, n, s) for d, t in docs.items() for n, s in enumerate(t.split("\n")) if s.strip()]
    first = {}
    for d, n, s in every:
        first.setdefault(s, (d, n))
    kinds = list(first)
    sets = [{s.lower()[i : i + 8] for i in range(max(1, len(s) - 7))} for s in kinds]
    edges = [(i, j) for i in range(len(kinds)) for j in range(i + 1, len(kinds)) if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    root = roots(len(kinds), edges)
    keeper = {s: first[kinds[root[i]]] for i, s in enumerate(kinds)}
    gone = {(d, n) for d, n, s in every if keeper[s] != (d, n)}
    expected = {d: "\n".join(s for n, s in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in docs.items()}
    got = lines.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == expected and sum(r.n_dropped for r in got) == len(gone)


def test_lines_of_a_repeated_unit(spark):
    units = [("-", 20, 80), ("ha ", 10, 60), ("the ", 8, 90), ("=*", 9, 200)]
    rows = [(2 * i + j, (u * n)[:-1] if u[-1] == " " else u * n) for i, (u, *ns) in enumerate(units) for j, n in enumerate(ns)] + [(100, "a line of its own, with nothing repeated in it")]
    got = {r.doc_id: r.n_dropped for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d % 2 for d, _ in rows}


def test_line_edges(spark, odd):
    r = collections.defaultdict(list)
    for x in lines.dedup_lines(odd).collect():
        r[x.doc_id].append(x)
    assert sum(map(len, r.values())) == 8 and r[1][0].text is None and r[2][0].text == "" and r[5][0].text == ""
    assert r[3][0].n_lines == 2_000 and r[3][0].n_dropped == 1_999 and r[3][0].text.strip() == "one two three four five six"
    assert {x.text for x in r[4]} == {"same text of six words here"}
    assert lines.dedup_lines(odd.limit(0)).count() == 0


# 10 URL filters


def test_url_intervals_and_edges(spark):
    t = lambda s: f"2024-01-01 {s}"
    entries = [(1, "bad.example.com", True, t("10:00:00")), (2, "bad.example.com", False, t("12:00:00")), (3, "bad.example.com", True, t("12:00:00")), (4, "example.com", False, t("00:00:00")), (5, None, True, t("00:00:00")), (6, "bad.example.com", False, t("15:30:00"))]
    captures = [(1, "http://bad.example.com/x", t("09:59:59")), (2, "http://bad.example.com/x", t("10:00:00")), (3, "HTTPS://www.BAD.example.com:80/", t("12:00:00")), (4, "http://u@sub.bad.example.com", t("15:29:59")), (5, "http://bad.example.com", t("15:30:00")), (6, None, t("12:00:00")), (7, "http://bad.example.com", None)]
    c = spark.createDataFrame(captures, "capture_id long, url string, ts string").withColumn("ts", F.to_timestamp("ts")).withColumn("host", F.lit("clash"))
    e = spark.createDataFrame(entries, "entry_id long, pattern string, listed boolean, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.capture_id: (r.blocked, r.entry_id) for r in urls.as_of_lists(c, e).collect()}
    assert got == {1: (False, None), 2: (True, 1), 3: (True, 3), 4: (True, 3), 5: (False, None), 6: (False, None), 7: (False, None)}
    twice = urls.as_of_lists(c.unionByName(c.where("capture_id = 3")), e).where("capture_id = 3").collect()
    assert [(r.matches, r.entry_id) for r in twice] == [(2, 3)] * 2
    assert urls.as_of_lists(c, e.limit(0)).where("blocked").count() == 0 and urls.as_of_lists(c.limit(0), e).count() == 0


# Pipeline


def test_pipeline_stages_by_brute_force(spark, sf, docs):
    import corpus_pipeline as p

    at = docs
    for name, stage in p.STAGES:
        out = stage(spark, at, sf).cache()
        before, after = {r.doc_id: r for r in at.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "toxicity":
            toxic = {r.doc_id for r in table(spark, sf, "labels").where("toxic = 1").collect()}
            clean = {r.doc_id for r in table(spark, sf, "labels").where("toxic = 0").collect()}
            gone = set(before) - set(after)
            assert len(gone & toxic) >= 0.7 * len(toxic & set(before)) and len(gone & clean) <= 0.02 * len(clean)
        if name == "line_dedup":
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in after.values())
            kept = [s for r in after.values() for s in r.text.split("\n") if s.strip()]
            assert len(kept) == len(set(kept))
        if name == "minhash_dedup":
            ids = sorted(d for d in before if words(before[d].text))
            expected = {d for d, c in near_classes(ids, [before[d].text for d in ids]).items() if d == c}
            # Texts without a word are near equal ones alone.
            wordless = {}
            for d in sorted(set(before) - set(ids)):
                wordless.setdefault(before[d].text, d)
            assert set(after) == expected | set(wordless.values())
        if name == "decontamination":
            hits = {r.doc_id for r in decontamination.screen(at, table(spark, sf, "benchmark")).where("size(matches) > 0").collect()}
            assert set(after) == set(before) - hits
        at = out
    assert p.run(spark, sf).count() == at.count()


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "minhash_dedup", "decontamination", "bpe"])
def test_stage_edges(spark, sf, tmp_path, name):
    """Nulls, empty and long texts, repeated rows, clashing columns with values of their own, and empty tables."""
    import corpus_pipeline as p

    stage = dict(p.STAGES)[name]
    mine = {c: F.lit(f"my {c}") for c in ("matches", "n_lines", "n_dropped", "is_toxic", "p_toxic", "row", "th", "gone", "keys", "_id", "ids", "class_id", "n_tokens")}
    rows = [(1, None), (2, ""), (None, "a b c d e f g"), (None, None), (3, "one two three four five six\n" * 2_000), (4, "same text of six words here"), (4, "same text of six words here"), (5, "same text of six words here"), (6, "?!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).withColumns(mine)
    docs.write.parquet(f"file://{tmp_path}/docs")
    out = stage(spark, spark.read.parquet(f"file://{tmp_path}/docs"), sf)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    every = sorted((i is None, i or 0) for i, _ in rows)
    assert stage(spark, spark.read.parquet(f"file://{tmp_path}/docs").limit(0), sf).count() == 0
    if name == "bpe":
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and ids == every
        return
    assert out.columns == docs.columns and all(out.where(f"`{c}` <> 'my {c}' or `{c}` is null").isEmpty() for c in mine)
    if name == "minhash_dedup":
        assert ids == [e for e in every if e != (False, 5)]
    else:
        assert ids == every
    if name == "line_dedup":
        kept = [s for r in out.collect() for s in (r.text or "").split("\n") if s.strip()]
        assert sorted(kept) == sorted(["a b c d e f g", "one two three four five six", "same text of six words here", "same text of six words here", "?!"])
        assert out.where("n_chars <> length(text)").isEmpty()


def test_equal_ids_with_different_texts(spark, sf):
    """A row goes for its own text's sake: the second text of a doc_id stays, however near the first is to others."""
    import corpus_pipeline as p

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (3, text(1) + " more"), (3, text(3)), (3, text(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(p.STAGES)["minhash_dedup"](spark, docs, sf).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted([rows[0], rows[2], rows[4], rows[5]])


def test_captures_with_any_columns(spark):
    captures = spark.createDataFrame([("http://a.example/x", 1, "b", "c", "d")], "url string, k long, best string, `a.b` string, host string").withColumn("ts", F.timestamp_seconds(F.lit(100)))
    entries = spark.createDataFrame([("a.example", 1, True)], "pattern string, entry_id long, listed boolean").withColumn("ts", F.timestamp_seconds(F.lit(50)))
    (row,) = urls.as_of_lists(captures, entries).collect()
    assert row["best"] == "b" and row["a.b"] == "c" and row["host"] == "a.example" and row["blocked"] and row["entry_id"] == 1


def test_items_of_any_id_in_several_passes(spark, sf, texts, monkeypatch):
    """Three passes and more give what one gives; ids keep their type."""
    docs = table(spark, sf, "documents")
    items = table(spark, sf, "benchmark").withColumn("item_id", F.concat(F.lit("hs-"), F.col("item_id").cast("string")))
    once = {(r.doc_id, m.item_id) for r in decontamination.screen(docs, items).collect() for m in r.matches}
    monkeypatch.setattr(decontamination, "PASS_PARTS", 1 + items.count() // 4)
    monkeypatch.setattr(decontamination, "COUNTED_PASSES", 2)
    monkeypatch.setattr(decontamination, "RANK", 1_000)
    often = {(r.doc_id, m.item_id) for r in decontamination.screen(docs, items).collect() for m in r.matches}
    assert once and all(i.startswith("hs-") for _, i in once) and len(once ^ often) <= 0.02 * len(once)


def test_roles_of_any_characters(spark):
    roles = ["a\0b", "a\\b", "\\n", "\\\n", "\\s\\", "<|im_end|>\n\\", "\x00\\\x00"]
    log = spark.createDataFrame([(i, 0, "message", 0, r, "t") for i, r in enumerate(roles)], "conv_id long, seq long, kind string, turn long, role string, text string")
    assert {r.conv_id: r.turns[0].role for r in chat.format_chats(log).collect()} == dict(enumerate(roles))


def test_long_conversations_and_documents(spark):
    """Time grows with the turns and the lines alone."""
    import time

    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("seq"), F.lit("message").alias("kind"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    start = time.time()
    (row,) = chat.format_chats(turns).collect()
    assert len(row.turns) == 20_000 and len(row.loss_spans) == 10_000
    assert [row.formatted[s.start : s.start + s.length] for s in row.loss_spans[:3] + row.loss_spans[-1:]] == ["t1", "t3", "t5", "t19999"]
    docs = spark.createDataFrame([(1, "the same line of text\n" * 100_000)], "doc_id long, text string")
    (row,) = lines.dedup_lines(docs).collect()
    assert (row.n_lines, row.n_dropped) == (100_000, 99_999)
    assert time.time() - start < 60
