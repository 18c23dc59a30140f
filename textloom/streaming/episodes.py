"""Episodes as keyed state with timers: rows are held until their turn, and what goes quiet expires.

Turns may come out of order within the watermark's delay. Each is kept in a
list state and taken up, in the order of its time, once the watermark has passed
it, so that none before it can still come. A value state holds the episode. One
timer stands at the earliest turn held, and takes up all that are ripe; one
after the last turn closes an episode that went quiet and frees its
state. State is in RocksDB, so it may outgrow an executor's heap; checkpoints
are in the shared folder.

Defined cases: a turn behind the watermark is dropped; turns of one time are
taken by their number; a null text counts as empty; turns after an episode's
end are swallowed until it expires; what comes for its key later is a new one.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textloom.operators.dialogue import MAX_TURNS
from textloom.session import stored
from textloom.streaming.sessions import BUDGET, _visible_call, drain

DELAY, QUIET = "4 minutes", 10 * 60_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Rows of a key in the order of their times, whatever order they come in.

    Subclasses say what is held of a row (``columns`` and ``kinds`` beside its
    time), what an episode is (``kept``, ``fresh``), what a row does to it
    (`step`), and what is said when it expires (`quiet`).
    """

    columns: list[str]
    kinds: str
    kept: str
    fresh: tuple
    out: list[str]

    def step(self, key, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def quiet(self, key, state: tuple) -> list[tuple]:
        return []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.episode = handle.getValueState("episode", f"{self.kept}, last long")
        self.held = handle.getListState("held", f"at long, {self.kinds}")
        #: When the episode expires, and the earliest turn held, which have timers.
        self.ends = handle.getValueState("ends", "at long, next long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            frame = frame[frame["turn"].notna()]
            at = frame["ts"].astype("datetime64[ms]").astype("int64")
            new += [(int(t), *self.plain(r)) for t, r in zip(at, frame[self.columns].itertuples(index=False), strict=True)]
        if new:
            self.held.appendList(new)
            before, waits = self.ends.get() or (None, None)
            end, first = max(r[0] for r in new) + QUIET, min(r[0] for r in new)
            end, first = end if before is None else max(end, before), first if waits is None else min(first, waits)
            self._timed((before, waits), (end, first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        every = list(self.held.get())
        ripe = sorted((r for r in every if r[0] <= now), key=lambda r: r[:2])
        *state, last = self.episode.get() or (*self.fresh, None)
        state, said = tuple(state), []
        for row in ripe:
            if last is not None and row[0] >= last + QUIET:  # it expired before this row, whenever that is noticed
                said += self.quiet(key[0], state)
                state = self.fresh
            state, told = self.step(key[0], state, row[1:])
            said, last = said + told, row[0]
        if ripe:
            self.episode.update((*state, last))
            rest = [r for r in every if r[0] > now]
            self.held.put(rest) if rest else self.held.clear()
        ends = self.ends.get()
        if ends and expiredTimerInfo.getExpiryTimeInMs() >= ends[0]:
            said += self.quiet(key[0], state)
            self.episode.clear()
            self.held.clear()
            self.ends.clear()
        elif ends and ripe:
            # the timers of what was taken up are gone or fire for nothing
            self._timed((ends[0], None), (ends[0], min((r[0] for r in rest), default=None)))
        if said:
            yield pd.DataFrame(said, columns=self.out)

    def _timed(self, before: tuple, now: tuple) -> None:
        """Keep the two times, with a timer at each and none at those before."""
        self.ends.update(now)
        for t in set(before) - set(now) - {None}:
            self.handle.deleteTimer(t)
        for t in set(now) - set(before) - {None}:
            self.handle.registerTimer(t)

    def close(self) -> None:
        pass

    def plain(self, row: tuple) -> tuple:
        """A row as it is held: its number first."""
        return (int(row[0]), *row[1:])


class Lookups(Ordered):
    """Counts lookups up to a budget; an answer, or a lookup beyond it, ends the episode."""

    columns, kinds = ["turn", "role", "text", "target"], "turn long, role string, text string, target string"
    kept, fresh = "lookups long, seen boolean, over boolean, done boolean", (0, False, False, False)
    out = ["conv_id", "lookups", "target_seen", "budget_exhausted", "done", "expired"]

    def __init__(self, budget: int = BUDGET):
        self.budget = budget

    def step(self, key, state, row):
        lookups, seen, over, done = state
        if done:
            return state, []
        _, role, text, target = row
        word, done = _visible_call(role, text)
        if word is not None:
            if lookups < self.budget:
                lookups, seen = lookups + 1, bool(seen or word == target)
            else:
                over = done = True
        return (lookups, seen, over, done), [(key, lookups, seen, over, True, False)] if done else []

    def quiet(self, key, state):
        return [] if state[3] else [(key, *state[:3], False, True)]


class Attempts(Ordered):
    """Numbers the turns of a dialogue until one fulfils its task or too many were made."""

    columns, kinds = ["turn", "perfect", "feedback"], "turn long, perfect boolean, feedback string"
    kept, fresh = "attempts long, done boolean", (0, False)
    out = ["conv_id", "turn", "attempts", "perfect", "completed", "feedback"]

    def __init__(self, most: int = MAX_TURNS):
        self.most = most

    def step(self, key, state, row):
        n, done = state
        if done:
            return state, []
        turn, perfect, feedback = row
        done = bool(perfect) or n + 1 >= self.most
        return (n + 1, done), [(key, turn, n + 1, bool(perfect), done, feedback)]


def lookups(turns: DataFrame, budget: int = BUDGET, delay: str = DELAY) -> DataFrame:
    """A row for each episode of a stream (conv_id, turn, role, text, target, ts) when it ends or expires."""
    keyed = turns.withWatermark("ts", delay).groupBy("conv_id")
    return keyed.transformWithStateInPandas(Lookups(budget), "conv_id long, lookups long, target_seen boolean, budget_exhausted boolean, done boolean, expired boolean", "Append", "EventTime")


def attempts(verified: DataFrame, most: int = MAX_TURNS, delay: str = DELAY) -> DataFrame:
    """A row for each turn that counts of a stream (conv_id, turn, perfect, feedback, ts)."""
    keyed = verified.withWatermark("ts", delay).groupBy("conv_id")
    return keyed.transformWithStateInPandas(Attempts(most), "conv_id long, turn long, attempts long, perfect boolean, completed boolean, feedback string", "Append", "EventTime")


def at_turn(turn: str) -> Column:
    """A time for each turn: a minute apart."""
    return F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col(turn))


def in_batches(rows: DataFrame, path: str, parts: tuple[Column, ...]) -> DataFrame:
    """A table as a stream of one batch a part, then two that only move the watermark on."""
    rows = stored(rows)
    end = rows.agg(F.max("ts").alias("ts"))
    ahead = [end.select(*[(F.col("ts") + F.expr(f"INTERVAL {d} DAYS") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema]) for d in (1, 2)]
    for part in (*[rows.filter(p) for p in parts], *ahead):
        part.repartition(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@contextlib.contextmanager
def rocksdb(spark):
    """The state store that keyed state with timers needs, for queries that start inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a stateful stream says."""
    with rocksdb(stream.sparkSession):
        drain(stream, path, checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
