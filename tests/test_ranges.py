"""Series of any length: dealt by ranges, they give what one sort gives."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import filters, metrics, ranges, relops

SHAPES = {"one key": lambda i: "a", "a hot key": lambda i: "a" if i % 3 else f"k{i % 20}", "null keys": lambda i: None if i % 2 else "b"}


def table(spark, shape, n=400):
    rng = random.Random(n)
    rows = [(SHAPES[shape](i), i * 7 % 1009, None if i % 11 == 0 else float(rng.choice([1, 1, 1, 2.5, rng.randint(-50, 50)]))) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, v double").repartition(7)


def shown(df):
    cell = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(cell(v) for v in r) for r in df.collect()), key=repr)


@pytest.fixture
def hot(monkeypatch):
    def on(rows=25, block=30):
        monkeypatch.setattr(ranges, "HOT_ROWS", rows)
        monkeypatch.setattr(ranges, "BLOCK_ROWS", block)

    return on


def every(df):
    rolled = lambda w: {"mean": metrics.rolling(F.col("v"), w, 25, 5), "std": metrics.rolling(F.col("v"), w, 4, 2, "std"), "diff": metrics.diff(F.col("v"), w)}
    events = df.withColumnRenamed("t", "e")
    signups = df.filter("t % 5 = 0 AND v IS NOT NULL").select("k", "t", "v", F.col("t").alias("e"))
    yield "frames", ranges.framed(df, ["k"], ["t"], 25, rolled)
    yield "sums", metrics.running_total(df, ["k"], ["t"], "v", "total")
    yield "batches", metrics.batches(df, ["k"], "t", 8)
    yield "steps", metrics.ensure_step(df, ["t"], ["k"])
    yield "steps of all", metrics.ensure_step(df, ["t"], [])
    yield "carried", ranges.carried(df, ["k"], ["t"], "v", "last")
    yield "asof", relops.asof(events.select("k", F.col("e").alias("t"), "e"), signups, "t", ["k"], "v", "e")
    yield "describe", metrics.describe(df, ["k"], "v", "t")
    yield "describe all", metrics.describe(df, [], "v", "t")
    yield "median", filters.upper_median(df, "v")


@pytest.mark.parametrize("shape", SHAPES)
def test_ranges_give_the_same(spark, hot, shape):
    df = table(spark, shape)
    plain = {name: shown(out) for name, out in every(df)}
    hot()
    for name, out in every(df):
        assert shown(out) == plain[name], name


def test_no_task_has_more_than_a_range(spark, hot):
    """One key for all rows: the ranges are even, and so are blocks."""
    hot(100, 500)
    df = spark.range(8000).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    dealt = ranges._ranged(df, ["k"], ["t"])
    sizes = [r["count"] for r in dealt.groupBy("__p").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * 8000 / len(sizes)
    out = ranges.framed(df, ["k"], ["t"], 3, lambda w: {"s": F.sum("t").over(w.rowsBetween(-2, 0)), "b": F.count("*").over(w.rowsBetween(-10_000, 10_000))})
    got = out.collect()
    assert len(got) == 8000 and max(r.b for r in got) <= 502
    assert all(r.s == sum(range(max(0, r.t - 2), r.t + 1)) for r in got)


def test_ranks_of_equal_and_missing_values(spark, hot):
    hot(1, 1)
    df = spark.createDataFrame([("a", 5)] * 60 + [("a", None)] * 9 + [("b", None)] + [("c", v) for v in (4, 1, 3, 2)], "k string, v int")
    assert shown(ranges.medians(df, ["k"], "v")) == [("a", 5.0), ("c", 2.5)]
    assert filters.upper_median(df.filter("v IS NULL"), "v").collect() == [(None, None)]
    assert ranges.medians(df.limit(0), ["k"], "v").count() == 0
