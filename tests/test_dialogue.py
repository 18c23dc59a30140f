"""Multi-turn verification against a plain version; state and session windows on odd inputs."""

from __future__ import annotations

import itertools
import re
from datetime import datetime, timedelta

import pytest
import pandas as pd
from pyspark.sql import functions as F

from textloom.operators import dialogue as D
from textloom.streaming import episodes, sessions

LETTERS = set("ćšŋḣṡáéíóúķśṅźėčžʼ")
RESPONSES = [None, "", " wax mnoku ", "WAX mnoku š", "mnokuš ŋ wa", "a-b waku. ŋš", "one two three four five", "one two three four six", "Sí .x"]
ANSWERS = [None, "", "wax MNOKU", "one two three four five five", "ŋš"]
KINDS = ["morphology", "word_translation", "reverse_translation", "other", None]
ASKS = [(None, None), ([], ["-ku"]), (["š", "ŋ", "š"], ["wa-", "-a-"]), (["q"], ["zz"]), (["í"], ["-.x", "-"])]


def plain(response, answer, kind, letters, affixes):
    r, a = response or "", answer or ""
    missing = sorted(set(letters or []) - {c for c in r if c in LETTERS})

    def bears(x):
        bare = x.strip("-")
        if x.startswith("-") and not x.endswith("-"):
            return bool(re.search(rf"\w+{re.escape(bare)}\b", r))
        if x.endswith("-") and not x.startswith("-"):
            return bool(re.search(rf"\b{re.escape(bare)}\w+", r))
        return bare in r

    fixed = kind != "morphology" or all(bears(x) for x in affixes or [])
    x, y = r.strip().lower(), a.strip().lower()
    means, credit = x == y, 1.0 if x == y else 0.0
    if not means and kind in ("word_translation", "sentence_translation") and y.split():
        credit = len(set(x.split()) & set(y.split())) / len(set(y.split()))
        means = credit > 0.8
    faults = []
    if missing:
        faults.append("Missing special characters: " + ", ".join(missing))
    if not fixed:
        faults.append("Required affixes: " + ", ".join(affixes))
    if not means:
        faults.append("Close, but not quite right. Check the exact form." if credit > 0.5 else f"Incorrect. Expected: {a}")
    perfect = {"morphology": not missing and fixed, "reverse_translation": not missing and means}.get(kind, means)
    return not missing, fixed, means, round(credit, 9), " | ".join(faults) or " Correct! Well done.", perfect


def test_turns_equal_plain(spark):
    rows = [(i, *x, *ask) for i, (*x, ask) in enumerate(itertools.product(RESPONSES, ANSWERS, KINDS, ASKS))]
    df = spark.createDataFrame(rows, "i int, response string, answer string, kind string, letters array<string>, affixes array<string>")
    c = F.col
    got = {r.i: r.v for r in df.select("i", D.verify_turn(c("response"), c("answer"), c("kind"), c("letters"), c("affixes")).alias("v")).collect()}
    for i, *row in rows:
        v = got[i]
        assert (v.special_chars_correct, v.affixes_correct, v.semantic_correct, round(v.partial_credit, 9), v.feedback, v.perfect) == plain(*row), row


def test_a_dialogue_ends_once(spark):
    rows = [(1, t, t == 1) for t in range(5)] + [(2, t, False) for t in range(9)] + [(3, 7, True)] + [(None, 0, False), (None, 1, True)]
    df = spark.createDataFrame(rows, "conv long, turn long, ok boolean").withColumn("attempts_", F.lit(1))
    nothing = F.lit("")
    verified = F.struct(F.col("ok").alias("perfect"), F.col("ok").alias("special_chars_correct"), F.col("ok").alias("affixes_correct"), F.col("ok").alias("semantic_correct"), F.lit(0.0).alias("partial_credit"), nothing.alias("feedback"))
    told = D.multi_turn(df, "conv", "turn", verified)
    assert sorted((r.conv or 0, r.turn, r.attempts, r.completed) for r in told.collect()) == [(0, 0, 1, False), (0, 1, 2, True), (1, 0, 1, False), (1, 1, 2, True), (2, 0, 1, False), (2, 1, 2, False), (2, 2, 3, True), (3, 7, 1, True)]
    assert {(r.conv, r.attempts, r.solved) for r in D.outcome(told, "conv").collect()} == {(None, 2, True), (1, 2, True), (2, 3, False), (3, 1, True)}
    assert D.multi_turn(df.limit(0), "conv", "turn", verified).count() == 0
    # the first turns are picked before rows are shuffled, so one dialogue may hold most rows
    assert "WindowGroupLimit" in told._jdf.queryExecution().executedPlan().toString()


def test_episodes_hold_expire_and_drop(spark, tmp_path):
    """One answered, one gone quiet, one whose early turn comes too late, one that comes back after it expired."""
    t0 = datetime(2024, 1, 1)

    def turn(conv, n, text, minute, role="assistant"):
        return (conv, n, role, text, "w", t0 + timedelta(minutes=minute))

    first = [turn(1, 1, "LOOKUP: w", 2), turn(2, 0, "LOOKUP: a", 1), turn(3, 1, "LOOKUP: w", 3), turn(4, 0, "LOOKUP: w", 3)]
    second = [turn(1, 0, "LOOKUP: b", 1), turn(1, 2, "ANSWER: x", 3), turn(1, 3, "LOOKUP: c", 4), turn(2, 1, None, 2, "user"), turn(9, 0, "hm", 40, "user")]
    third = [turn(4, 1, "ANSWER: again", 41)]
    fourth = [turn(3, 0, "ANSWER: late", 2)]  # what is late is told by the watermark that the batch before it had
    rows = [(*r, i) for i, part in enumerate((first, second, third, fourth)) for r in part]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, target string, ts timestamp, part int")
    source = episodes.in_batches(df, str(tmp_path / "in"), tuple(F.col("part") == i for i in range(4)))
    out = episodes.drained(episodes.lookups(source.drop("part")), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = sorted(tuple(r) for r in out.select("conv_id", "lookups", "target_seen", "budget_exhausted", "done", "expired").collect())
    assert got == [(1, 2, True, False, True, False), (2, 1, False, False, False, True), (3, 1, True, False, False, True), (4, 0, False, False, True, False), (4, 1, True, False, False, True), (9, 0, False, False, False, True)]


@pytest.mark.parametrize("n", [0, 1, 400])
def test_session_windows(spark, n):
    t0 = datetime(2024, 1, 1)
    rows = [(i % 3 if i % 7 else None, t0 + timedelta(minutes=(i * i * 37) % 5000), i) for i in range(n)] + ([(1, None, 5)] if n else [])
    df = spark.createDataFrame(rows, "k long, ts timestamp, v long")
    got = sorted((r.k if r.k is not None else -1, r.start, r.last, r.n, r.total) for r in sessions.session_windows(df, "ts", ["k"], "20 minutes", "v").collect())
    want, by = [], {}
    for k, ts, v in sorted((x for x in rows if x[1]), key=lambda x: x[1]):
        by.setdefault(-1 if k is None else k, []).append((ts, v))
    for k, xs in by.items():
        runs = []
        for ts, v in xs:
            if runs and ts <= runs[-1][-1][0] + timedelta(minutes=20):
                runs[-1].append((ts, v))
            else:
                runs.append([(ts, v)])
        want += [(k, r[0][0], r[-1][0], len(r), sum(v for _, v in r)) for r in runs]
    assert got == sorted(want)


def test_held_turns_have_one_timer():
    """However many turns a key holds, one timer stands for them and one for the episode's end; all come out in order."""

    class Store:
        def __init__(self):
            self.value = None

        def get(self):
            return self.value

        def exists(self):
            return self.value is not None

        def update(self, value):
            self.value = value

        put = update

        def appendList(self, rows):
            self.value = [*(self.value or []), *rows]

        def clear(self):
            self.value = None

    class Held(Store):
        def get(self):
            return iter(self.value or [])

    class Handle:
        def __init__(self):
            self.timers = set()
            self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

        def getValueState(self, *_):
            return Store()

        def getListState(self, *_):
            return Held()

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    state, handle = episodes.Attempts(9), Handle()
    state.init(handle)
    for turns in ([3, 1, 2], [5, 4]):
        rows = pd.DataFrame({"turn": turns, "perfect": False, "feedback": "x", "ts": pd.to_datetime([60_000 * t for t in turns], unit="ms")})
        list(state.handleInputRows((7,), iter([rows]), None))
    assert handle.timers == {60_000, 300_000 + episodes.QUIET}
    handle.timers.discard(60_000)
    first = pd.concat(state.handleExpiredTimer((7,), Now(120_000), Now(60_000)))
    assert first["turn"].tolist() == [1, 2] and handle.timers == {180_000, 300_000 + episodes.QUIET}
    handle.timers.discard(180_000)
    rest = pd.concat(state.handleExpiredTimer((7,), Now(400_000), Now(180_000)))
    assert rest["turn"].tolist() == [3, 4, 5] and rest["attempts"].tolist() == [3, 4, 5] and handle.timers == {300_000 + episodes.QUIET}
    assert not list(state.handleExpiredTimer((7,), Now(10**7), Now(300_000 + episodes.QUIET))) and state.ends.get() is None
