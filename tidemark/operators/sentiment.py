"""Sentiment by a lexicon: valences of words in their places, with negations, boosters, contrast, capitals and marks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_arrow

MAX_CHARS, MOST_WORDS = 3_000, 1_000_000
#: What a booster adds, how it fades with distance, what capitals add, what a negation leaves, how `but`
#: weighs what comes before and after it, what marks add, and the constant of the final squashing.
BOOST, FADES, CAPITALS, NEGATED, BEFORE_BUT, AFTER_BUT = 0.293, (1.0, 0.95, 0.9), 0.733, -0.74, 0.5, 1.5
MARK, MOST_MARKS, QUESTION, MANY_QUESTIONS, SQUASH = 0.292, 4, 0.18, 0.96, 15
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Lexicon:
    """Words by what they do: a valence, a negation, a booster up (1) or down (-1), or a contrast."""

    def __init__(self, rows: list[tuple[str, str, float | None]]) -> None:
        of = lambda kind: {w: v for w, k, v in rows if k == kind}
        self.valence, self.booster = of("valence"), of("booster")
        self.negations, self.contrasts = set(of("negation")), set(of("contrast"))

    def _boost(self, word: str, valence: float, mixed: bool) -> float:
        sign = self.booster.get(word.lower())
        if not sign:
            return 0.0
        by = math.copysign(BOOST, sign) * (1 if valence >= 0 else -1)
        if mixed and word.isupper():
            by += math.copysign(CAPITALS, valence)
        return by

    def _valence(self, words: list[str], i: int, mixed: bool) -> float:
        word = words[i]
        valence = self.valence.get(word.lower(), 0.0) or 0.0
        if not valence or word.lower() in self.booster:
            return 0.0
        if mixed and word.isupper():
            valence += math.copysign(CAPITALS, valence)
        for back, fade in enumerate(FADES, 1):
            if back > i:
                break
            before = words[i - back]
            if before.lower() not in self.valence:
                valence += fade * self._boost(before, valence, mixed)
                if before.lower() in self.negations:
                    valence *= NEGATED
        return valence

    def score(self, text: str | None) -> float:
        """In [-1, 1], four places; 0 of a null or empty text and of one without a word of the lexicon."""
        text = (text or "")[:MAX_CHARS]
        words = [w if len(w.strip(_EDGE)) <= 2 else w.strip(_EDGE) for w in text.split()]
        capitals = sum(w.isupper() for w in words)
        mixed = 0 < capitals < len(words)
        valences = [self._valence(words, i, mixed) for i in range(len(words))]
        turn = next((i for i, w in enumerate(words) if w.lower() in self.contrasts), None)
        if turn is not None:
            valences = [v * (BEFORE_BUT if i < turn else AFTER_BUT if i > turn else 1) for i, v in enumerate(valences)]
        total = sum(valences)
        questions = text.count("?")
        marks = MARK * min(text.count("!"), MOST_MARKS) + (0 if questions < 2 else QUESTION * questions if questions <= 3 else MANY_QUESTIONS)
        if total:
            total += math.copysign(marks, total)
        return round(total / math.sqrt(total * total + SQUASH), 4) + 0.0


def lexicon_sentiment(texts: DataFrame, text: str, lexicon: DataFrame, name: str = "sentiment") -> DataFrame:
    """texts with `name`, the score of the first 3,000 characters of each text by a lexicon (word in lower case, kind, value):
    kinds are valence (the value), booster (value 1 or -1), negation and contrast. A word may have several kinds; of equal
    (word, kind) the greatest value counts. Null texts score 0.

    A word's valence is raised or lowered by boosters among the three words before it, the farther the less, turned by each
    negation among them, and raised by capitals where a text has words of both kinds; what a contrast follows counts half,
    what follows it half as much again; marks add to the sum, which is squashed into [-1, 1]. The lexicon goes to all tasks:
    more than a million words are an error."""
    rows = lexicon.where("word is not null").groupBy("word", "kind").agg(F.max(F.col("value").cast("double")).alias("value")).limit(MOST_WORDS + 1).toArrow()
    if rows.num_rows > MOST_WORDS:
        raise ValueError(f"a lexicon of more than {MOST_WORDS} words")
    shared = texts.sparkSession.sparkContext.broadcast(list(zip(*[rows.column(c).to_pylist() for c in ("word", "kind", "value")])))
    kept = [c for c in texts.columns if c != name]
    of = texts.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own"), F.col(f"`{text}`").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array([words.score(t) for t in batch.column("text").to_pylist()], pa.float64())], ["own", "score"])

    read = map_arrow(of, work, f"own {of.schema['own'].dataType.simpleString()}, score double")
    return read.select(*[F.col(f"own.`{c}`") for c in kept], F.col("score").alias(name))


def fitted_lexicon(texts: DataFrame, good: str, text: str = "text", least: int = 5) -> DataFrame:
    """(word, kind, value) from texts with a column `good` (1 or 0, null for neither): a word in at least `least` of them has
    as valence four times the difference of the shares of good and of bad texts that hold it over their sum."""
    words = texts.where(F.col(good).isNotNull()).select(F.col(good).alias("y"), F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))).alias("word")).where("length(word) > 2")
    totals = F.broadcast(texts.agg(F.sum(good).alias("goods"), F.sum(1 - F.col(good)).alias("bads")))  # one row
    held = words.groupBy("word").agg(F.sum("y").alias("g"), F.sum(1 - F.col("y")).alias("b")).where(F.col("g") + F.col("b") >= least).crossJoin(totals)
    g, b = F.col("g") / F.greatest("goods", F.lit(1)), F.col("b") / F.greatest("bads", F.lit(1))
    return held.select("word", F.lit("valence").alias("kind"), F.round(4 * (g - b) / (g + b), 1).alias("value")).where("value <> 0")
