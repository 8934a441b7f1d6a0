"""PII: detected entities get keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, table, written

# Honorifics by gender, given names by gender and script.
MALE = "Mr|Herr|Señor|Sr|Monsieur|г-н|господин"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|г-жа|госпожа"
NEUTRAL = "Dr|Prof|Mx"
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karim Leon Marco Noel Oscar Paul".split(),
    ("f", "latin"): "Anna Berta Clara Diana Emma Flora Greta Helena Irene Julia Karla Laura Maria Nora Olga Paula".split(),
    ("n", "latin"): "Alex Billie Charlie Dana Eden Frankie Gray Harper Indigo Jules Kim Lee Morgan Nico Parker Quinn".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
    ("f", "cyrillic"): "Анна Белла Вера Галина Дарья Ева Зоя Инна Клара Лидия Мария Нина Ольга Полина Раиса София".split(),
    ("n", "cyrillic"): "Саша Женя Валя Слава Шура Паша Тоша Стася Мика Ника Рика Лика Вика Аля Юля Лёня".split(),
}
SYLLABLES = {
    "latin": "bar den fal gor hem jun kal lor mer nov pel ros sen tor val win".split(),
    "cyrillic": "бар ден фал гор хем жун кал лор мер нов пел рос сен тор вал вин".split(),
}
_WORD = r"\p{Lu}[\p{L}\p{M}'’-]+"
#: One alternation, the more particular kinds first; kind_of() tells them apart again.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
SECRET = r"(?<![\p{L}\p{N}])[0-9a-f]{32,64}(?![\p{L}\p{N}])"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?![ -]?\d)"
PHONE = r"(?<![\d\p{L}])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d\p{L}])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])"
IPV6 = r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
#: Three, two and four digits; a trunk zero with an area code and a number.
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
NATIONAL = r"(?<![\d\p{L}.,+-])0\d{2,4}[ /-]\d{3,4}[ -]?\d{2,5}(?![\d\p{L}-]|[.,]\d)"
TITLE = f"{MALE}|{FEMALE}|{NEUTRAL}"
NAME = rf"(?<!\p{{L}})(?:{TITLE})\.?[ \x{{A0}}]{_WORD}(?:[ \x{{A0}}]{_WORD})?"
ENTITY = "|".join([EMAIL, IP, IPV6, SECRET, IBAN, CARD, SSN, PHONE, NATIONAL, NAME])


def _has_title(text: Column) -> Column:
    named = F.lit(False)
    for title in TITLE.split("|"):
        named = named | F.contains(text, F.lit(title))
    return named


def may_have_entity(text: Column) -> Column:
    """A quick look: every entity has a digit, an @ or an honorific. Text without any is not searched."""
    return text.rlike("[0-9@]") | _has_title(text)


def kind_of(m: Column) -> Column:
    """The kind of a mention; null for a number of a card's length whose check digit isn't one."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(m, F.lit("@")), "email").when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), "ip").when(whole(r"[0-9A-Fa-f:]*:[0-9A-Fa-f:]*"), "ipv6").when(whole(r"[0-9a-f]{32,64}") & m.rlike("[a-f]"), "secret")
        .when(whole(r"[A-Z]{2}\d{2}[A-Z0-9 ]+"), F.when(_mod_97(F.replace(m, F.lit(" "))) == 1, "iban"))
        .when(m.rlike(r"^\p{L}"), "name").when(whole(r"\d{3}-\d{2}-\d{4}"), "ssn")
        .when(m.rlike(r"[+(]") | whole(r"\d{3}[.-]\d{3}[.-]\d{4}") | whole(r"0\d{2,4}[ /-]\d{3,4}[ -]?\d{2,5}"), "phone")
        .when(_luhn_sum(F.regexp_replace(m, r"\D", "")) % 10 == 0, "card")
    )


def canonical(kind: Column, m: Column) -> Column:
    """What mentions of one entity share: digits of a number, lower case of the rest, a name's last word with its script."""
    last = F.regexp_extract(m, r"([^ \x{A0}]+)$", 1)
    name = F.concat(F.lit("n|"), script(last), F.lit("|"), F.lower(last))
    return F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(m, r"\D", "")).when(kind == "name", name).when(kind == "iban", F.replace(m, F.lit(" "))).otherwise(F.lower(m))


def _untitled(m: Column) -> Column:
    return F.regexp_replace(m, rf"^(?:{TITLE})\.?[ \x{{A0}}]", "")


def given_of(m: Column) -> Column:
    """The given name of a name of two words, else null."""
    return F.nullif(F.regexp_extract(_untitled(m), r"^([^ \x{A0}]+)[ \x{A0}]", 1), F.lit(""))


def gender(m: Column) -> Column:
    return F.when(m.rlike(rf"^(?:{FEMALE})(?!\p{{L}})"), "f").when(m.rlike(rf"^(?:{MALE})(?!\p{{L}})"), "m").otherwise("n")


def script(m: Column) -> Column:
    return F.when(m.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _hex(digest: Column, i: Column) -> Column:
    """The i-th hexadecimal digit of a 64-digit digest, i from 0, going round."""
    return F.substring(digest, (i % 64) + 1, F.lit(1))


def _pick(values: list[str], digest: Column, i: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.conv(F.substring(digest, i, 1), 16, 10).cast("int") % len(values)) + 1)


#: Letters by script; letters of any other script become Latin ones.
ALPHABETS = {
    r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
    r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"\p{IsLatin}": "àáâäçèéêëíîïñóôöúùûü",
    r"\p{IsHan}": "安白成大方高和江金李林明平青山石天文王小新玉元云张正中周子",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにぬねの",
    r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテトナニヌネノ",
    r"\p{IsHangul}": "가나다라마바사아자차카타파하고노도로모보소오조초코",
    r"\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת",
}


def _mapped(s: Column, digest: Column) -> Column:
    """s with every digit and letter replaced by a keyed one of its class; case and all other characters stay."""
    def char(c: Column, i: Column) -> Column:
        h = F.conv(F.concat(_hex(digest, i * 2), _hex(digest, i * 2 + 1)), 16, 10).cast("int")
        of = lambda alphabet: F.substring(F.lit(alphabet), h % len(alphabet) + 1, F.lit(1))
        out = F.when(c.rlike("[0-9]"), of("0123456789")).when(c.rlike("[a-z]"), of("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        for script_, alphabet in ALPHABETS.items():
            out = out.when(c.rlike(rf"{script_}") & c.rlike(r"\p{L}"), of(alphabet))
        return out.when(c.rlike(r"\p{L}"), of("abcdefghijklmnopqrstuvwxyz")).when(c.rlike(r"\p{N}"), of("0123456789")).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), char), "")


def _luhn_sum(digits: Column) -> Column:
    d = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    def add(acc: Column, x: Column) -> Column:
        v = x.cast("int") * F.when(acc["i"] % 2 == 1, 2).otherwise(1)
        return F.struct((acc["i"] + 1).alias("i"), (acc["s"] + F.when(v > 9, v - 9).otherwise(v)).alias("s"))
    return F.aggregate(d, F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")), add)["s"]


def _mod_97(iban: Column) -> Column:
    """What the number of an IBAN without blanks leaves when divided by 97: country and check digits last, letters as 10 to 35."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.when(letter, (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda acc, c: add(acc, c).cast("int"))


def surrogate(kind: Column, canon: Column, key: str, attempt: int) -> Column:
    """A candidate for the canonical form of an entity, drawn with the key. Later attempts draw from more: names have a
    syllable more each time, given names from the third on; from the fourth attempt on e-mail addresses, and from the
    twelfth numbers, get longer."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, F.lit(str(attempt)), canon), 256)
    at = F.locate("@", canon)
    domain = F.substring(canon, at + 1, F.length(canon))
    tld = F.regexp_extract(domain, r"(\.[^.]+)$", 1)
    longer = lambda n: F.conv(F.substring(F.sha2(digest, 256), 1, n), 16, 10) if n > 0 else F.lit("")
    email = F.concat(_mapped(F.substring(canon, F.lit(1), at - 1), digest), longer(min(attempt - 3, 15)), F.lit("@"), _mapped(F.substring(domain, F.lit(1), F.length(domain) - F.length(tld)), F.sha2(F.concat(F.lit(key), domain), 256)), tld)
    octet = lambda i: (F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")).cast("string")
    trunk = F.regexp_extract(canon, "^(0?)", 1)  # a leading zero stays one
    number = F.concat(trunk, F.substring(_mapped(canon, digest), F.length(trunk) + 1, F.length(canon)), longer(min(attempt - 11, 15)))
    first = F.substring(canon, 1, 1)
    card = F.concat(first, F.substring(number, F.lit(2), F.length(number) - 2))
    card = F.concat(card, ((10 - _luhn_sum(F.concat(card, F.lit("0"))) % 10) % 10).cast("string"))
    secret = F.substring(F.concat(digest, F.sha2(digest, 256)), F.lit(1), F.length(canon))
    part = F.split(canon, r"\|")
    name, first_name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (g, s), given in GIVEN.items():
        of = (part[0] == g) & (part[1] == s)
        surname = F.concat(*[_pick(SYLLABLES[s], digest, i) for i in range(5, 9 + attempt)])
        name = F.when(of, F.concat(F.lit(f"{g}|{s}|"), surname)).otherwise(name)
        double = [F.lit("-"), *[_pick(SYLLABLES[s], digest, i) for i in range(5, 5 + attempt)]] if attempt > 1 else []
        first_name = F.when(of, F.concat(F.lit(f"{g}|{s}|"), F.lower(_pick(given, digest, 1)), *double)).otherwise(first_name)
    mapped = _mapped(canon, digest)
    bban = F.substring(mapped, F.lit(5), F.length(canon))
    country = F.substring(canon, 1, 2)
    iban = F.concat(country, F.lpad((98 - _mod_97(F.concat(country, F.lit("00"), bban))).cast("string"), 2, "0"), bban)
    hexed = F.array_join(F.transform(F.filter(F.split(canon, ""), lambda c: c != ""), lambda c, i: F.when(c == ":", c).otherwise(_hex(digest, i))), "")
    exact = F.when(kind == "ipv6", hexed).when(kind == "iban", iban).when(kind == "given", first_name).when(kind == "ssn", mapped)
    return exact.when(kind == "email", email).when(kind == "ip", F.concat_ws(".", *map(octet, range(4)))).when(kind == "secret", secret).when(kind == "name", name).when(kind == "phone", number).otherwise(card)


def rendered(kind: Column, mention: Column, s: Column) -> Column:
    """The surrogate s in the format of the mention: separators, upper case, honorific."""
    chars = F.filter(F.split(mention, ""), lambda c: c != "")
    digits = F.array_join(F.transform(F.aggregate(chars, F.struct(F.lit(1).alias("i"), F.array().cast("array<string>").alias("out")), lambda acc, c: F.struct(
        (acc["i"] + F.when(c.rlike("[0-9]"), 1).otherwise(0)).alias("i"),
        F.concat(acc["out"], F.array(F.when(c.rlike("[0-9]"), F.substring(s, acc["i"], F.lit(1))).otherwise(c))).alias("out")))["out"], lambda c: c), "")
    digits = F.concat(digits, F.substring(s, F.length(F.regexp_replace(mention, r"\D", "")) + 1, F.length(s)))  # of a longer surrogate
    is_upper = lambda x: (x == F.upper(x)) & (x != F.lower(x))
    upper = is_upper(mention)
    before_at = lambda x: F.substring_index(x, "@", 1)
    after_at = lambda x: F.substring_index(x, "@", -1)
    email = F.concat(F.when(is_upper(before_at(mention)), F.upper(before_at(s))).otherwise(before_at(s)), F.lit("@"), F.when(is_upper(after_at(mention)), F.upper(after_at(s))).otherwise(after_at(s)))
    blocks = F.regexp_replace(s, "(.{4})(?=.)", "$1 ")
    iban = F.when(F.contains(mention, F.lit(" ")), blocks).otherwise(s)
    return F.when(kind.isin("card", "phone", "ssn"), digits).when(kind == "iban", iban).when(kind == "email", email).when(upper, F.upper(s)).otherwise(s)


def rendered_name(mention: Column, given: Column, surname: Column) -> Column:
    """A name's mention with its title and blanks, in the surrogates' given name (null: it has none) and surname."""
    shown = lambda s, was: F.when((was == F.upper(was)) & (F.length(was) > 1), F.upper(F.element_at(F.split(s, r"\|"), -1))).otherwise(F.initcap(F.regexp_replace(F.element_at(F.split(s, r"\|"), -1), "-", " ")))
    hyphened = lambda s, was: F.replace(shown(s, was), F.lit(" "), F.lit("-"))
    title = F.regexp_extract(mention, rf"^((?:{TITLE})\.?[ \x{{A0}}])", 1)
    blank = F.regexp_extract(mention, r"([ \x{A0}])[^ \x{A0}]+$", 1)
    last = F.regexp_extract(mention, r"([^ \x{A0}]+)$", 1)
    return F.concat(title, F.coalesce(F.concat(hyphened(given, given_of(mention)), blank), F.lit("")), hyphened(surname, last))


def dictionary(entities: DataFrame, key: str, max_attempts: int = 40) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon): surrogates of a kind are distinct and none is itself an entity.

    In each round the open entities draw anew; of those that draw the same, the first one keeps it unless it is taken.
    Names, addresses and numbers get longer with the attempts, so they never run out. IP addresses and secrets have the
    length they have: it is an error if a corpus holds so many of them (most of 2^32, or of 16^32) that 40 draws fail."""
    entities = written(entities.select("kind", "canon").distinct(), "entities")
    taken = entities.select("kind", F.col("canon").alias("surrogate"))
    open_, done = entities, None
    for attempt in range(max_attempts):
        drawn = open_.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), key, attempt))
        won = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).join(taken, ["kind", "surrogate"], "left_anti").select("kind", "canon", "surrogate")
        won = written(won, "surrogates")
        done = won if done is None else done.unionByName(won)
        open_ = written(open_.join(won, ["kind", "canon"], "left_anti"), "open")
        if open_.isEmpty():
            return done
        taken = taken.unionByName(won.select("kind", "surrogate"))
    raise RuntimeError("some entities got no surrogate of their own; their format has too few values")


def pseudonymise(docs: DataFrame, key: str = "change-me", text: str = "text") -> DataFrame:
    """docs with their entities replaced in text; adds n_entities (null for a null text) and text_before_sha256.

    Mentions of one entity (same digits, same word of a name, any case) get one surrogate everywhere, different entities
    different ones, and no surrogate is an entity of docs. A name is found by its title; its given name and surname have
    surrogates of their own, so that `Frau Anna Schmidt`, `Dr Anna Schmidt` and `Frau Schmidt` stay one person. Where a
    text names someone with a title, the same words without one are that person too and are replaced (a surname alone, if
    a title stands before it alone). A given name's gender is that of the title; without one, or with a neutral title,
    that of the same name, or else of all titles of that surname, in the text. Numbers of a card's or an IBAN's form
    without valid check digits stay. Copies of a text are resolved once: mentions go by the hash of the text, so that a
    large group of copies or rows without ids cost no more than one. Texts without an entity take no part in any shuffle.
    Null and empty texts stay as they are, long ones are searched whole, repeated rows get one result. Empty docs give no
    rows; columns named like an added one are replaced, all others stay whatever their names.
    """
    docs = docs.drop("n_entities", "text_before_sha256")
    own, columns = numbered(docs)
    body = F.col(columns[text])
    none = F.array().cast("array<string>")
    # What stands behind titles in a text, longer ones first, is looked for without them as well.
    bare = F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(NAME), F.lit(0)), _untitled))
    bare = F.transform(F.array_sort(F.transform(bare, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n")))), lambda x: F.concat(F.lit(r"\Q"), x["n"], F.lit(r"\E")))
    pattern = F.when(F.size("bare") > 0, F.concat(F.lit(ENTITY + r"|(?<!\p{L})(?:"), F.array_join("bare", "|"), F.lit(r")(?![\p{L}\p{M}])"))).otherwise(F.lit(ENTITY))
    rows = own.withColumn("bare", F.when(_has_title(body), bare)).withColumn("pattern", pattern)
    rows = rows.withColumn("mentions", F.when(may_have_entity(body), F.regexp_extract_all(body, F.col("pattern"), F.lit(0))).when(body.isNotNull(), none))
    hash_ = F.sha2(body, 256)
    hit = rows.where(F.size("mentions") > 0).withColumn("hash", hash_)
    texts = hit.groupBy("hash").agg(F.first("mentions").alias("mentions"))
    mention = texts.select("hash", F.posexplode("mentions").alias("pos", "mention")).withColumn("kind", kind_of(F.col("mention")))
    mention = mention.withColumn("canon", canonical(F.col("kind"), F.col("mention")))
    is_name = F.col("kind") == "name"
    mention = mention.withColumns({"given": F.when(is_name, F.lower(given_of(F.col("mention")))), "g": F.when(is_name, F.nullif(gender(F.col("mention")), F.lit("n")))})
    of_name, of_surname = Window.partitionBy("hash", "canon", "given"), Window.partitionBy("hash", "canon")  # within one text
    alike = F.when(F.min("g").over(of_surname) == F.max("g").over(of_surname), F.min("g").over(of_surname))
    mention = mention.withColumn("g", F.coalesce("g", F.min("g").over(of_name), alike, F.lit("n")))
    given = F.when(F.col("given").isNotNull(), F.concat_ws("|", "g", script(F.col("given")), "given"))
    mention = written(mention.select("hash", "pos", "mention", "kind", "canon", given.alias("given")), "mentions")
    entities = mention.where("kind is not null").select("kind", "canon").unionByName(mention.where("given is not null").select(F.lit("given").alias("kind"), F.col("given").alias("canon")))
    names = written(dictionary(entities, key), "dictionary")
    given_names = names.where("kind = 'given'").select(F.col("canon").alias("given"), F.col("surrogate").alias("given_surrogate"))
    shown = F.when(F.col("kind") == "name", rendered_name(F.col("mention"), F.col("given_surrogate"), F.col("surrogate"))).otherwise(rendered(F.col("kind"), F.col("mention"), F.col("surrogate")))
    shown = F.coalesce(shown, F.col("mention"))
    drawn = (
        mention.join(names, ["kind", "canon"], "left").join(given_names, "given", "left")
        .select("hash", F.struct("pos", shown.alias("out"), F.col("kind").isNotNull().cast("long").alias("is_entity")).alias("m"))
        .groupBy("hash").agg(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["out"]).alias("new"), F.sum("m.is_entity").alias("n_entities"))
    )
    gaps = F.split(body, F.col("pattern"), -1)
    new = F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), F.col("new").alias("new")), lambda x: F.concat(x["gap"], F.coalesce(x["new"], F.lit("")))), "")

    def result(d: DataFrame, new_text: Column, n: Column) -> DataFrame:
        shown = [(new_text if c == text else F.col(i)).alias(c) for c, i in columns.items()]
        return d.select(*shown, n.cast("long").alias("n_entities"), hash_.alias("text_before_sha256"))

    rest = rows.where((F.size("mentions") == 0) | body.isNull())
    return result(hit.join(drawn, "hash"), new, F.col("n_entities")).unionByName(result(rest, body, F.when(body.isNotNull(), 0)))


def op2(spark, sf_dir: str) -> DataFrame:
    """All documents with surrogates for their entities: doc_id, text, n_entities, text_before_sha256."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="production-key")
