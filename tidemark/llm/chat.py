"""Chat formatting: event-sourced reconstruction of conversations, then a reversible template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: The control strings of the template and of templates in common use.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
START, END = "<|im_start|>", "<|im_end|>\n"
_TAILS = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>"


def escape(text: Column) -> Column:
    """A backslash more after the first character of every control string, also of those that have some already."""
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_TAILS})", r"$1$2\\")


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(text, rf"([<\[])(\\*)\\(?={_TAILS})", "$1$2")


def _role_out(role: Column) -> Column:
    r"""A backslash becomes \s and a newline \n, so that neither can be taken for the other."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def reconstruct(log: DataFrame, block: int = 64) -> DataFrame:
    """The events that count in the end (conv_id, turn, seq, role, text, begins) of an event log (conv_id, seq, kind, turn,
    role, text).

    kind `message` begins a message of its own; `delta` adds its text to the last message of the turn; `edit` and
    `regenerate` drop what the turn and all later turns had so far and begin the turn anew with their text; other kinds
    are taken for `delta`. Events are folded by (conv_id, seq). Repeated seq and repeated rows keep every row, in the order
    of turn, role, text. Null texts and roles are empty, a null turn counts as 0, a null conv_id is a conversation of its
    own. An empty log gives no rows; other columns don't matter.

    A conversation may hold much of the log: its events are dealt by (conv_id, block of seq), and what the blocks know
    of each other is one row per block.
    """
    log = log.select(
        "conv_id",
        F.coalesce("seq", F.lit(0)).cast("long").alias("seq"),
        F.coalesce("kind", F.lit("delta")).alias("kind"),
        F.coalesce("turn", F.lit(0)).cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("block", F.floor(F.col("seq") / block))
    reset = F.when(F.col("kind").isin("edit", "regenerate"), F.col("turn"))
    # The least turn that a later block begins anew.
    of_block = log.groupBy("conv_id", "block").agg(F.min(reset).alias("least"))
    after = Window.partitionBy("conv_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    later = of_block.select("conv_id", "block", F.min("least").over(after).alias("later")).where("later is not null")
    inside = Window.partitionBy("conv_id", "block").orderBy("seq", "turn", "role", "text").rowsBetween(1, Window.unboundedFollowing)
    live = (
        log.join(later.withColumnRenamed("conv_id", "c").withColumnRenamed("block", "b"), F.expr("conv_id <=> c and block = b"), "left")
        .withColumn("next", F.least("later", F.min(reset).over(inside)))
        .where("next is null or next > turn")
    )
    return live.select("conv_id", "turn", "seq", "role", "text", F.col("kind").isin("message", "edit", "regenerate").alias("begins"))


def render(events: DataFrame, block: int = 64) -> DataFrame:
    """One row (conv_id, formatted) per conversation of live events: each message is START role newline text END.

    A message is an event that begins one, or the first of its turn, with the events up to the next such, joined in order;
    it has the role of its first event. Messages are put together within blocks of turns first, so that the last step has
    one row per block. One conversation is one string: Spark's limit of 2 GB for a value holds."""
    turns = events.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("seq", "role", "text", "begins"))).alias("parts"))
    first = F.filter(F.transform("parts", lambda p, i: F.when(p["begins"] | (i == 0), i)), lambda i: i.isNotNull())
    turns = turns.withColumn("first", first)
    upto = lambda k: F.coalesce(F.get("first", k + 1), F.size("parts"))
    text = lambda i, k: F.array_join(F.transform(F.slice("parts", i + 1, upto(k) - i), lambda p: p["text"]), "")
    message = lambda i, k: F.concat(F.lit(START), _role_out(F.get("parts", i)["role"]), F.lit("\n"), escape(text(i, k)), F.lit(END))
    shown = F.array_join(F.transform("first", message), "")
    joined = lambda key: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, "shown"))), lambda x: x["shown"]), "")
    blocks = turns.select("conv_id", "turn", F.floor(F.col("turn") / block).alias("block"), shown.alias("shown")).groupBy("conv_id", "block").agg(joined("turn").alias("shown"))
    return blocks.groupBy("conv_id").agg(joined("block").alias("formatted"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation."""
    turns = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(x: Column) -> Column:
        end = F.locate("\n", x)
        return F.struct(
            _role_in(F.substring(x, F.lit(1), end - 1)).alias("role"),
            unescape(F.substring(x, end + 1, F.length(x) - end - len(END))).alias("text"),
        )

    return F.transform(turns, turn)


def with_loss_mask(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """Adds turns (as parsed back from formatted) and loss_spans, array<struct<start, length>>: the code points of
    formatted that hold a text of the trained role."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)

    def measured(x: Column) -> Column:
        end = F.locate("\n", x)
        return F.struct(
            (F.length(x) + len(START)).cast("long").alias("length"),
            (end + len(START)).cast("long").alias("skip"),
            (F.length(x) - end - len(END)).cast("long").alias("text"),
            (_role_in(F.substring(x, F.lit(1), end - 1)) == trained).alias("trained"),
        )

    empty = F.expr("cast(array() as array<bigint>)")

    def starts(lengths: Column, at: Column) -> Column:
        """What comes before each length, from `at` on; the list grows by copying, so it has to be short."""
        zero = F.struct(at.cast("long").alias("at"), empty.alias("all"))
        return F.aggregate(lengths, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]

    def let(value: Column, of) -> Column:
        """of(value), with the value computed once."""
        return F.get(F.transform(F.array(value), of), 0)

    def spans(turns: Column) -> Column:
        # Turns are added up in runs, then the runs: the lists that grow have the square root of all turns' number.
        run = F.greatest(F.ceil(F.sqrt(F.size(turns))), F.lit(1)).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / run).cast("int")), lambda k: F.slice(turns, k * run + 1, run))

        def within(runs: Column) -> Column:
            total = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda acc, t: acc + t["length"]))
            at = lambda before: F.flatten(F.transform(runs, lambda r, k: starts(F.transform(r, lambda t: t["length"]), F.get(before, k))))
            return let(starts(total, F.lit(0)), lambda before: F.arrays_zip(at(before).alias("at"), F.flatten(runs).alias("t")))

        return let(runs, within)

    masked = lambda z: F.struct((z["at"] + z["t"]["skip"]).alias("start"), z["t"]["text"].alias("length"))
    every = let(F.transform(pieces, measured), lambda turns: F.when(F.size(turns) > 0, spans(turns)))
    none = F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)")
    spans_of = F.when(F.col("formatted").isNotNull(), F.coalesce(F.transform(F.filter(every, lambda z: z["t"]["trained"]), masked), none))
    return conversations.withColumn("turns", parse(F.col("formatted"))).withColumn("loss_spans", spans_of)


def format_chats(log: DataFrame) -> DataFrame:
    """conv_id, formatted, turns, loss_spans of every conversation of an event log; an empty log gives no rows."""
    return with_loss_mask(render(reconstruct(log)))


def op1(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts are control strings; digests of what is read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        "select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') t(conv_id, turn, role, text)"
    )
    log = rows.unionByName(extra).select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return (
        format_chats(log)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            loss.alias("loss"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
        .select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
    )


OP1_SQL = """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, regexp_replace(text, '([<\\[])(\\\\*)(\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|/?s>|/?INST\\]|<SYS>>|</SYS>>)', '\\1\\2\\\\\\3', 'g') as shown from c
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(12 + length(role) + 1 + length(shown) + 11)::bigint as formatted_chars
from e group by conv_id
"""
