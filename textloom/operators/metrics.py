"""Ordered analytics over metric histories, by series; aggregates of score ledgers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import ranges


def ensure_step(rows: DataFrame, order: list[str], by: list[str], step: str = "step") -> DataFrame:
    """Add a step from 0 in the given order, unless there is one; a series of any length."""
    return rows if step in rows.columns else ranges.placed(rows, by, order, step)


def rolling(value: Column, w, size: int, least: int, kind: str = "mean") -> Column:
    """Mean or sample deviation of the last ``size`` rows, null below ``least`` values."""
    frame = w.rowsBetween(-(size - 1), 0)
    agg = F.avg(value) if kind == "mean" else F.stddev_samp(value)
    return F.when(F.count(value).over(frame) >= least, agg.over(frame))


def diff(value: Column, w) -> Column:
    return value - F.lag(value).over(w)


def cumsum(value: Column, w) -> Column:
    return F.sum(F.coalesce(value, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def running_total(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add the running sum of a value; a series of any length."""
    return ranges.running(rows, by, order, **{name: F.col(value)}).withColumn(name, F.col(name) + F.coalesce(value, F.lit(0.0)))


def rolling_frac(rows: DataFrame, by: list[str], step: str, value: str, share: float = 0.02, least: int = 5) -> DataFrame:
    """Rolling mean over ``max(5, floor(share * n))`` rows of a series of n; each length has a frame of its own.

    A frame can't depend on data, so it is a difference of running sums.
    """
    w = Window.partitionBy(*by).orderBy(step)
    df = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*by))).withColumn("__i", F.row_number().over(w))
    df = df.withColumn("__w", F.greatest(F.lit(5), F.floor(F.col("__n") * share)).cast("int"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__s", F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(run)).withColumn("__c", F.count(value).over(run))
    back = df.select(*by, (F.col("__i") + F.col("__w")).alias("__i"), F.col("__s").alias("__s0"), F.col("__c").alias("__c0"))
    df = df.join(back, [*by, "__i"], "left")
    n = F.col("__c") - F.coalesce("__c0", F.lit(0))
    return df.withColumn("rolling", F.when(n >= least, (F.col("__s") - F.coalesce("__s0", F.lit(0.0))) / n)).select(*rows.columns, "rolling")


def describe(rows: DataFrame, by: list[str], value: str, step: str) -> DataFrame:
    """n, mean, median, sample deviation, min, max, first and last value that isn't null.

    Medians are exact. A series with many distinct values has them ranked by
    ranges (`ranges.medians`); the others hold theirs in one task.
    """
    v, at = F.col(value), F.when(F.col(value).isNotNull(), F.col(step))
    cols = {
        "n": F.count(v),
        "mean": F.avg(v),
        "median": F.percentile(v, 0.5),
        "std": F.stddev_samp(v),
        "min": F.min(v),
        "max": F.max(v),
        "first_value": F.min_by(v, at),
        "final_value": F.max_by(v, at),
        "nonzero": F.count_if(v != 0),
    }
    if not ranges.is_hot(rows, by):
        return rows.groupBy(*by).agg(*[c.alias(n) for n, c in cols.items()])
    out = rows.groupBy(*by).agg(*[c.alias(n) for n, c in cols.items() if n != "median"])
    middle = ranges.medians(rows, by, value)
    out = ranges.meet(out, middle, by) if by else out.crossJoin(F.broadcast(middle))  # without keys: one row
    return out.select(*by, *cols)


def milestones(rows: DataFrame, by: list[str], step: str, value: str, fractions: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """First step at which a series has made each fraction of its way from first to final value."""
    ends = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(value, step).alias("a"), F.max_by(value, step).alias("z"))
    goals = ends.select(*by, "a", "z", F.explode(F.array(*map(F.lit, fractions))).alias("fraction"))
    met = rows.join(goals, by).filter(F.col(value) >= F.col("a") + F.col("fraction") * (F.col("z") - F.col("a")))
    return met.groupBy(*by, "fraction").agg(F.min(step).alias("step"))


def half_trend(rows: DataFrame, by: list[str], step: str, value: str, more_than: int = 10) -> DataFrame:
    """Means of both halves of a series of more than ``more_than`` rows, and the label of its ends."""
    w = Window.partitionBy(*by)
    df = rows.filter(F.col(value).isNotNull()).withColumn("__i", F.row_number().over(w.orderBy(step)) - 1).withColumn("__n", F.count("*").over(w)).filter(F.col("__n") > more_than)
    early = F.col("__i") < F.floor(F.col("__n") / 2)
    out = df.groupBy(*by).agg(F.avg(F.when(early, F.col(value))).alias("first_half"), F.avg(F.when(~early, F.col(value))).alias("second_half"), F.min_by(value, "__i").alias("__a"), F.max_by(value, "__i").alias("__z"))
    label = F.when(F.col("__z") > F.col("__a"), "up").when(F.col("__z") < F.col("__a"), "down").otherwise("flat")
    return out.withColumn("trend", label).drop("__a", "__z")


def best_step(rows: DataFrame, by: list[str], step: str, value: str) -> DataFrame:
    """The first step at which the value is highest."""
    return rows.groupBy(*by).agg(F.min_by(F.col(step), F.struct(-F.col(value), F.col(step))).alias("best_step"), F.max(value).alias("best"))


def slopes(rows: DataFrame, by: list[str], step: str, value: str) -> DataFrame:
    """Least-squares slope of the first max(5, n // 10) rows (n >= 10), and the steps in which the excess doubles."""
    w = Window.partitionBy(*by)
    df = rows.filter(F.col(value).isNotNull()).withColumn("__i", F.row_number().over(w.orderBy(step)) - 1).withColumn("__n", F.count("*").over(w)).withColumn("__low", F.min(value).over(w))
    early = F.col("__i") < F.greatest(F.lit(5), F.floor(F.col("__n") / 10))
    over = F.ln(F.col(value) - F.col("__low") + F.lit(1e-6))
    out = df.filter(F.col("__n") >= 10).groupBy(*by).agg(F.regr_slope(F.when(early, F.col(value)), F.when(early, F.col(step).cast("double"))).alias("early_slope"), F.regr_slope(over, F.col("__i").cast("double")).alias("__g"))
    return out.withColumn("doubling_steps", F.when(F.col("__g") != 0, F.lit(math.log(2)) / F.col("__g"))).drop("__g")


def sample_efficiency(rows: DataFrame, by: list[str], step: str, value: str) -> DataFrame:
    ends = describe(rows, by, value, step).select(*by, F.col("first_value").alias("initial"), F.col("final_value").alias("final"), F.col("max").alias("highest"))
    span = rows.groupBy(*by).agg((F.max(step) - F.min(step)).alias("steps"))
    out = ends.join(span, by).withColumn("improvement", F.col("final") - F.col("initial"))
    return out.withColumn("rate", F.try_divide("improvement", "steps"))


def group_advantage(reward: Column, by: list[str], floor: float | None = None) -> Column:
    """Reward less its group's mean; with a floor, over the population deviation or the floor."""
    w = Window.partitionBy(*by)
    centred = reward - F.avg(reward).over(w)
    return centred if floor is None else centred / F.greatest(F.stddev_pop(reward).over(w), F.lit(floor))


def gaps_islands(rows: DataFrame, by: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers: start, end and length."""
    w = Window.partitionBy(*by).orderBy(number)
    df = rows.select(*by, number).distinct().withColumn("__g", F.col(number) - F.row_number().over(w))
    return df.groupBy(*by, "__g").agg(F.min(number).alias("start"), F.max(number).alias("end"), F.count("*").alias("length")).drop("__g")


def sliding_buffer(rows: DataFrame, by: list[str], order: str, size: int = 5, step: int = 3) -> DataFrame:
    """Each row once for every window of ``size`` rows, ``step`` apart, that holds it."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    df = rows.withColumn("__i", i)
    first = F.greatest(F.lit(0), F.ceil((F.col("__i") - (size - 1)) / step)).cast("int")
    last = F.floor(F.col("__i") / step).cast("int")
    return df.withColumn("window_id", F.explode(F.sequence(first, last))).withColumn("pos", (F.col("__i") - F.col("window_id") * step).cast("int")).drop("__i")


def batches(rows: DataFrame, by: list[str], order: str, size: int) -> DataFrame:
    """Add ``batch`` and ``pos``, a row's place in it; a series of any length."""
    df = ranges.placed(rows, by, [order], "__i")
    return df.withColumn("batch", F.floor(F.col("__i") / size)).withColumn("pos", (F.col("__i") % size).cast("int")).drop("__i")


def interpolate(rows: DataFrame, by: list[str], step: str, value: str, points: int = 500) -> DataFrame:
    """Linear resampling of a series to ``points`` even steps from its first to its last."""
    nxt = Window.partitionBy(*by).orderBy(step)
    df = rows.filter(F.col(value).isNotNull()).select(*by, F.col(step).cast("double").alias("x0"), F.col(value).cast("double").alias("y0"), F.lead(F.col(step).cast("double")).over(nxt).alias("x1"), F.lead(F.col(value).cast("double")).over(nxt).alias("y1"))
    ends = df.groupBy(*by).agg(F.min("x0").alias("a"), F.max("x0").alias("z"))
    df = df.join(ends, by)
    width = (F.col("z") - F.col("a")) / (points - 1)
    # the grid points that lie in [x0, x1): counted, then made, so a point belongs to one interval
    lo = F.when(width > 0, F.ceil((F.col("x0") - F.col("a")) / width - 1e-9)).otherwise(0)
    hi = F.when(F.col("x1").isNull(), points - 1).when(width > 0, F.ceil((F.col("x1") - F.col("a")) / width - 1e-9) - 1).otherwise(-1)
    df = df.withColumn("point", F.explode(F.when(hi >= lo, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))))
    x = F.col("a") + F.col("point") * width
    y = F.when(F.col("x1").isNull() | (F.col("x1") == F.col("x0")), F.col("y0")).otherwise(F.col("y0") + (x - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    return df.select(*by, "point", x.alias(step), y.alias(value))


def quarters(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The rows at the start, the quarters and the end."""
    w = Window.partitionBy(*by)
    df = rows.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count("*").over(w))
    at = [F.floor((F.col("__n") - 1) * q / 4) for q in range(5)]
    return df.filter(F.col("__i").isin(*at)).drop("__i", "__n")


def epoch_checkpoints(rows: DataFrame, step: str, per_epoch: int, order: str) -> DataFrame:
    """The first row of each epoch whose step ends it."""
    df = rows.filter((F.col(step) > 0) & (F.col(step) % per_epoch == 0)).withColumn("epoch", F.floor(F.col(step) / per_epoch))
    return df.withColumn("__n", F.row_number().over(Window.partitionBy("epoch").orderBy(order))).filter("__n = 1").drop("__n")


def select_checkpoint(rows: DataFrame, order: str, name_col: str | None = None, name: str | None = None) -> DataFrame:
    """The last row, or the last of a name; raises if there is none."""
    found = (rows if name is None else rows.filter(F.col(name_col) == name)).orderBy(F.desc(order)).limit(1)
    if found.isEmpty():
        raise ValueError("no checkpoint" + (f" named {name}" if name else ""))
    return found


def outcome_shares(rows: DataFrame, group: str, right: Column) -> DataFrame:
    """Shares of groups that are all wrong, mixed and all right."""
    each = rows.groupBy(group).agg(F.min(right.cast("int")).alias("lo"), F.max(right.cast("int")).alias("hi"))
    kind = F.when(F.col("hi") == 0, "all_wrong").when(F.col("lo") == 1, "all_right").otherwise("mixed")
    counts = each.groupBy(kind.alias("outcome")).agg(F.count("*").alias("groups"))
    total = counts.agg(F.sum("groups").alias("__t"))
    return counts.crossJoin(total).withColumn("share", F.col("groups") / F.col("__t")).drop("__t")  # one row on the right


def score_summary(rows: DataFrame, group_sets: list[list[str]], channels: list[str]) -> DataFrame:
    """Means of channels over several groupings at once; -1 counts as not applicable."""
    keys = list(dict.fromkeys(k for s in group_sets for k in s))
    means = [F.avg(F.when(F.col(c) >= 0, F.col(c))).alias(c) for c in channels]
    return rows.groupingSets([[F.col(k) for k in s] for s in group_sets], *[F.col(k) for k in keys]).agg(F.count("*").alias("n"), *means)


def channel_stats(rows: DataFrame, by: list[str], channel: str, value: str, step: str) -> DataFrame:
    """n, nonzero, min, max and last value of each channel of a long table."""
    return describe(rows, [*by, channel], value, step).select(*by, channel, "n", "nonzero", "min", "max", "final_value")


def flatten_summary(rows: DataFrame, ids: list[str], metrics: list[str], skip: tuple[str, ...] = ("n",)) -> DataFrame:
    """Wide metrics as rows (metric, value)."""
    kept = [m for m in metrics if m not in skip]
    return rows.select(*ids, *[F.col(m).cast("double") for m in kept]).unpivot(ids, kept, "metric", "value")


def ledger_suffix(metrics: Column, prefix: str) -> Column:
    """Of a map of metrics, the entries below a prefix, without it."""
    kept = F.map_filter(metrics, lambda k, v: F.contains(k, F.lit(prefix)))
    return F.transform_keys(kept, lambda k, v: F.substring_index(k, prefix, -1))


def column_pick(rows: DataFrame, names: list[str]) -> str | None:
    """The first of some column names that exists and has a value."""
    there = [n for n in names if n in rows.columns]
    if not there:
        return None
    counts = rows.agg(*[F.count(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(there)]).first()
    return next((n for i, n in enumerate(there) if counts[i]), None)


def pair_metrics(rows: DataFrame, by: list[str], said: tuple[str, ...], truth: tuple[str, ...]) -> DataFrame:
    """n, the rate of rows right in every column, and the means over rows and columns of the edit distance (over the longer text) and of the marks that are kept."""
    from textloom.functions import text as X
    from textloom.functions import udfs

    pairs = [(X.strip_ws(udfs.nfkc(a)), X.strip_ws(udfs.nfkc(b))) for a, b in zip(said, truth, strict=True)]
    right = F.lit(True)
    for a, b in pairs:
        right = right & (a == b)
    mean = lambda each: F.avg(sum(each[1:], each[0]) / len(each))
    distance = mean([X.levenshtein_norm(a, b) for a, b in pairs])
    marks = mean([udfs.diacritic_preservation(a, b) for a, b in pairs])
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(right.cast("int")).alias("exact_rate"), distance.alias("char_dist"), marks.alias("diacritics"))


def audit(rows: DataFrame, required: list[str]) -> list[str]:
    """Required channels that are missing, or zero throughout."""
    there = [c for c in required if c in rows.columns]
    sums = rows.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in there]).first() if there else {}
    return [f"missing: {c}" for c in required if c not in there] + [f"zero: {c}" for c in there if not sums[c]]


def training_time(tasks: Column, rollouts: Column, seconds: Column, parallel: Column) -> Column:
    """Hours of a run, by its size."""
    return tasks * rollouts * seconds / parallel / 3600.0
