"""Keyed state with a time limit: remembered titles, streaks and blocks; as a stream and over a whole table."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..operators.tables import ship_package

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long a source that timed out rests, after how many empty days in a row one is blocked, and how long.
TIMEOUT_SECONDS, EMPTY_DAYS, EMPTY_SECONDS = 1_800, 8, 21_600


class TitleMemory:
    """The token sets of the last `most` titles kept, found by their tokens; all are forgotten `ttl` seconds after the last
    was kept."""

    def __init__(self, threshold: float = 0.75, most: int = 2_000, ttl: int = 86_400) -> None:
        self.threshold, self.most, self.ttl = threshold, most, ttl
        self._forget()

    def _forget(self) -> None:
        self.last: int | None = None
        self.kept: dict[int, frozenset[str]] = {}
        self.holders: dict[str, set[int]] = {}
        self.n = 0

    def _remember(self, tokens: frozenset[str]) -> None:
        self.kept[self.n] = tokens
        for w in tokens:
            self.holders.setdefault(w, set()).add(self.n)
        self.n += 1
        if len(self.kept) > self.most:
            i = next(iter(self.kept))
            for w in self.kept.pop(i):
                self.holders[w].discard(i)

    def step(self, at: int, tokens) -> tuple[bool]:
        """Whether a title is kept: it has no tokens, or none that is remembered is so similar."""
        if self.last is not None and at - self.last > self.ttl:
            self._forget()
        s = frozenset(tokens)
        if not s:
            return (True,)
        common = Counter(i for w in s for i in self.holders.get(w, ()))
        if any(c >= self.threshold * (len(s) + len(self.kept[i]) - c) for i, c in common.items()):
            return (False,)
        self._remember(s)
        self.last = at
        return (True,)

    # What a state store keeps: (last, one list of tokens per title, the oldest first).
    SCHEMA = "last long, titles array<array<string>>"

    def dump(self) -> tuple | None:
        return None if self.last is None else (self.last, [sorted(s) for s in self.kept.values()])

    def load(self, row: tuple) -> None:
        self.last = row[0]
        for tokens in row[1]:
            self._remember(frozenset(tokens))

    def expires(self) -> int | None:
        return None if self.last is None else self.last + self.ttl


class SourceGate:
    """A block with a time limit, set by a time-out or by a row of empty days, whose counter has a time limit too."""

    def __init__(self, timeout: int = TIMEOUT_SECONDS, days: int = EMPTY_DAYS, ttl: int = EMPTY_SECONDS) -> None:
        self.timeout, self.days, self.ttl = timeout, days, ttl
        self.streak, self.last, self.until = 0, 0, 0

    def step(self, at: int, outcome: str | None) -> tuple[bool, int]:
        """(whether the source is blocked, so that nothing was tried, empty days in a row)."""
        if self.streak and at - self.last >= self.ttl:
            self.streak = 0
        if at < self.until:
            return True, self.streak
        if outcome == "timeout":
            self.until = at + self.timeout
        elif outcome == "ok":
            self.streak = 0
        elif outcome == "empty":
            self.streak, self.last = self.streak + 1, at
            if self.streak >= self.days:
                self.until = at + self.ttl
        return False, self.streak

    SCHEMA = "streak long, last long, until long"

    def dump(self) -> tuple | None:
        return (self.streak, self.last, self.until) if self.streak or self.until else None

    def load(self, row: tuple) -> None:
        self.streak, self.last, self.until = row

    def expires(self) -> int | None:
        return max(self.last + self.ttl if self.streak else 0, self.until) or None


def _told(schema, columns: dict[str, str]) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [f"`{c}` {k}" for c, k in columns.items()])


def over_table(rows: DataFrame, by: list[str], at: str, order: str, value: str, new: Callable, adds: dict[str, str]) -> DataFrame:
    """rows with what the state of their key says of each, in the order of `at` (seconds) and `order`. Rows of a key come
    as a sorted stream, so that the state alone is held of it; keys without rows have no state."""
    sorted_rows = rows.repartition(*by).sortWithinPartitions(*by, at, order)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None
        for f in frames:
            said = []
            for k, t, v in zip(zip(*[f[c] for c in by]), f[at], f[value]):
                if state is None or any(a != b and not (pd.isna(a) and pd.isna(b)) for a, b in zip(k, key)):
                    key, state = k, new()
                said.append(state.step(int(t), v))
            yield f.assign(**{c: [s[i] for s in said] for i, c in enumerate(adds)})

    ship_package(rows.sparkSession)
    return sorted_rows.mapInPandas(work, _told(rows.schema, adds))


class _Keyed(StatefulProcessor):
    """Runs a state class over the rows of a key; what it holds is dropped when the watermark passes its end."""

    def __init__(self, at: str, order: str, value: str, new: Callable, adds: list[str]) -> None:
        self.at, self.order, self.value, self.new, self.adds = at, order, value, new, adds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("state", self.new().SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.new()
        if self.stored.exists():
            state.load(self.stored.get())
        f = pd.concat(list(rows)).sort_values([self.at, self.order], kind="stable")
        said = [state.step(int(t), v) for t, v in zip(f[self.at], f[self.value])]
        held = state.dump()
        if held is None:
            self.stored.clear()
        else:
            self.stored.update(held)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held is not None and state.expires() is not None:
            # A second later than the end, and never before the watermark, as the row that comes then still counts.
            self.handle.registerTimer(max((state.expires() + 1) * 1_000, timerValues.getCurrentWatermarkInMs() + 1))
        yield f.assign(**{c: [s[i] for s in said] for i, c in enumerate(self.adds)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stored.clear()
        return iter(())

    def close(self) -> None: ...


def over_stream(rows: DataFrame, by: list[str], at: str, order: str, value: str, new: Callable, adds: dict[str, str], event_time: str, late: str) -> DataFrame:
    """As over_table(), of a stream: state is kept per key from batch to batch, rows of a batch are taken in order, rows
    later than the watermark are left out, and a key's state goes when the watermark has passed its time limit. A batch's
    rows of one key are held in a task."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ship_package(spark)
    marked = rows.withWatermark(event_time, late)
    return marked.groupBy(*by).transformWithStateInPandas(_Keyed(at, order, value, new, list(adds)), _told(rows.schema, adds), "append", "EventTime")


def kept_titles(rows: DataFrame, by: list[str], title: str, at: str, order: str, threshold: float = 0.75, memory: int = 2_000, ttl: int = 86_400, event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows of each key, by time (seconds) and `order`, unless their title is that similar to one of the last `memory`
    titles kept before; all are forgotten `ttl` seconds after the last one was kept. Titles without tokens are always kept.
    The live pool has one key, that of past days a key per day. Of a stream if event_time names its time column.

    A suppressed title suppresses nothing itself, so this can't be a self anti-join; a key's rows are taken one after the
    other. What is remembered of a key is bounded, however many rows it has."""
    new = lambda: TitleMemory(threshold, memory, ttl)
    # A state's rows reach Python by name, but for names that begin with an underscore.
    sets = rows.withColumn("title_tokens", T.tokens(F.col(title)))
    adds = {"title_kept": "boolean"}
    told = over_stream(sets, by, at, order, "title_tokens", new, adds, event_time, late) if event_time else over_table(sets, by, at, order, "title_tokens", new, adds)
    return told.where("title_kept").drop("title_tokens", "title_kept")


def gated_sources(rows: DataFrame, by: list[str], outcome: str, at: str, order: str, event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """rows (fetches of a source with an outcome: ok, empty, timeout) with blocked, whether the source rested at that time
    so that nothing was tried, and streak, its empty days in a row: a time-out blocks it for half an hour, eight empty days
    in a row for six hours; a success ends a row, six hours without an empty day forget it. Other outcomes change nothing."""
    adds = {"blocked": "boolean", "streak": "long"}
    return over_stream(rows, by, at, order, outcome, SourceGate, adds, event_time, late) if event_time else over_table(rows, by, at, order, outcome, SourceGate, adds)
