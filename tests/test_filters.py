from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import filters
from textloom.session import drop_stored, shared_dir, spread, stored


def test_filters(spark):
    df = spark.createDataFrame([(None, "en", " "), (0.5, "EN", "x"), (0.9, None, "[explanation]")], "c double, l string, t string")
    assert filters.by_confidence(df, "c", 0.5).count() == 2
    assert filters.by_language(df, "l", "En").count() == 2
    assert [r["t"] for r in filters.without_placeholders(filters.nonempty(df, "t"), "t").collect()] == ["x"]


def test_options(spark):
    df = spark.createDataFrame([("q", {"A": "1"}, "A"), ("q", {"A": "1"}, "B"), (" ", {"A": "1"}, "A"), ("q", {}, "A"), ("q", {"A": "1"}, None)], "q string, o map<string,string>, c string")
    assert filters.valid_options(df, "q", "o", "c").count() == 1


def test_replay(spark):
    shown = spark.createDataFrame([("kin", "entry kin"), ("apa", "entry apa")], "plain string, text string")
    say = lambda *xs: [(("assistant", "user")[i % 2], x) for i, x in enumerate(xs)]
    rows = [
        ("good", "kin", "dog", say("LOOKUP: kin", "entry kin", "ANSWER: dog")),
        ("wrong reply", "kin", "dog", say("LOOKUP: kin", "entry apa", "ANSWER: dog")),
        ("other word", "kin", "dog", say("LOOKUP: apa", "entry apa", "ANSWER: dog")),
        ("no answer", "kin", "dog", say("LOOKUP: kin", "entry kin")),
        ("unknown word", "kin", "dog", say("LOOKUP: zzz", "?", "LOOKUP: kin", "entry kin", "ANSWER: dog")),
        ("too many", "kin", "dog", say(*["LOOKUP: kin", "entry kin"] * 4, "ANSWER: dog")),
    ]
    df = spark.createDataFrame(rows, "id string, target_plain string, answer string, messages array<struct<role:string,content:string>>")
    assert [r["id"] for r in filters.replay(df, shown).filter("passed").collect()] == ["good"]


def test_candidates(spark):
    heads = spark.createDataFrame([("aba",), ("aba",), ("c",), (None,), ("",)], "h string")
    edit = lambda *xs: spark.createDataFrame(list(xs), "old string, new string")
    got = lambda *xs: {r["h"]: r["candidates"] for r in filters.candidate_counts(heads, "h", edit(*xs)).collect()}
    assert got(("a", "o")) == {"aba": 2, "c": 0, None: 0, "": 0}
    assert got(("a", "o"), ("b", "x"), ("", "b"), ("", None), (None, "x")) == {"aba": 6, "c": 2, None: 0, "": 1}
    assert got() == {"aba": 0, "c": 0, None: 0, "": 0}


def test_candidates_are_those_of_all_edits_tried(spark):
    rng = random.Random(9)
    word = lambda a, b: "".join(rng.choice("abš") for _ in range(rng.randint(a, b)))
    heads, edits = [word(0, 7) for _ in range(60)], [(word(0, 3), word(0, 2)) for _ in range(30)]
    want = {h: len({h[:i] + new + h[i + len(old) :] for old, new in edits for i in range(len(h) - len(old) + 1) if h[i:].startswith(old)}) for h in heads}
    got = filters.candidate_counts(spark.createDataFrame([(h,) for h in heads], "h string"), "h", spark.createDataFrame(edits, "old string, new string"))
    assert {r["h"]: r["candidates"] for r in got.collect()} == want


@pytest.mark.parametrize("values", [[3], [1, 2], [5, 1, 3], [4, 1, 2, 9], [1, 1, 7, 7]])
def test_upper_median(spark, values):
    got = filters.upper_median(spark.createDataFrame([(v,) for v in values], "v int"), "v").first()
    assert tuple(got) == (sorted(values)[len(values) // 2], max(values))


def test_let_and_storage(spark):
    assert spark.range(1).select(X.let(F.lit(3), lambda v: v * v).alias("v")).first()["v"] == 9
    df = spark.range(5).withColumn("r", F.rand())
    once = stored(df)
    assert once.collect() == once.collect() and shared_dir(spark).startswith("/")
    assert drop_stored(spark) >= 1 and drop_stored(spark) == 0
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 10, 1, 9)).rdd.getNumPartitions() == 9
