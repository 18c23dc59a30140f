"""Ordered analytics on series of any length: ranges, what is carried over, and halos.

A window function sorts a series in one task. That is right while every series
is short. Where one holds more than ``HOT_ROWS`` rows, rows are dealt by ranges of
(series, order) instead and stored; within a range a window does the work, and
one summary row a range and series carries over what the ranges before it
contribute: sums, or the last value. Frames of the last w rows are taken in
blocks of known places, each with a halo of the w - 1 rows before it.

Both ways give the same rows (sums of doubles but for their last bits). Null
keys are a series like any other. The order must be total within a series for a
result that is the same every time; rows that are equal in it come in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from textloom.session import stored

#: Rows of a series up to which one task may sort it.
HOT_ROWS = 2_000_000
#: Rows of a block in which frames are taken, at least.
BLOCK_ROWS = 500_000


def is_hot(rows: DataFrame, by: list[str]) -> bool:
    """Whether a series holds more rows than one task should sort."""
    most = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) > HOT_ROWS


def _series(by: list[str], *more: str) -> WindowSpec:
    return Window.partitionBy(*by, *more) if by or more else Window.partitionBy(F.lit(0))


def _ranged(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows, stored, with the number ``__p`` of their range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *by, *order).withColumn("__p", F.spark_partition_id()))


def meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join in which null keys are equal; keys of the right go."""
    named = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return left.join(named, same, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def running(rows: DataFrame, by: list[str], order: list[str], highest: dict[str, Column] | None = None, **sums: Column) -> DataFrame:
    """Add, for each name, the sum over the rows before in the series; nulls add nothing.

    For the names of ``highest`` it is the highest value of the rows before, null if there is none.
    """
    zero, tops = F.lit(0), highest or {}
    add = lambda c, w: F.coalesce(F.sum(c).over(w), zero)
    if not is_hot(rows, by):
        before = _series(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select("*", *[add(c, before).alias(n) for n, c in sums.items()], *[F.max(c).over(before).alias(n) for n, c in tops.items()])
    df = _ranged(rows, by, order)
    before = _series(by, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.select("*", *[add(c, before).alias(f"__own_{n}") for n, c in sums.items()], *[F.max(c).over(before).alias(f"__own_{n}") for n, c in tops.items()])
    # one row a range and series
    totals = df.groupBy("__p", *by).agg(*[F.coalesce(F.sum(c), zero).alias(f"__all_{n}") for n, c in sums.items()], *[F.max(c).alias(f"__all_{n}") for n, c in tops.items()])
    gone = _series(by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__p", *by, *[add(f"__all_{n}", gone).alias(f"__all_{n}") for n in sums], *[F.max(f"__all_{n}").over(gone).alias(f"__all_{n}") for n in tops])
    out = meet(own, totals, ["__p", *by])
    both = [(F.col(f"__own_{n}") + F.col(f"__all_{n}")).alias(n) for n in sums] + [F.greatest(f"__own_{n}", f"__all_{n}").alias(n) for n in tops]
    return out.select(*rows.columns, *both)


def placed(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Add a row's place in its series, from 0."""
    return running(rows, by, order, **{name: F.lit(1)}).withColumn(name, F.col(name).cast("long"))


def carried(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add the last value that isn't null, at or before each row of the series."""
    now = (Window.unboundedPreceding, 0)
    if not is_hot(rows, by):
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(_series(by).orderBy(*order).rowsBetween(*now)))
    df = _ranged(rows, by, order)
    own = df.withColumn("__own", F.last(value, ignorenulls=True).over(_series(by, "__p").orderBy(*order).rowsBetween(*now)))
    lasts = df.filter(F.col(value).isNotNull()).groupBy("__p", *by).agg(F.max_by(value, F.struct(*order)).alias("__v"))
    # ranges without a value of the series have their row too
    lasts = meet(df.select("__p", *by).distinct(), lasts, ["__p", *by])
    gone = _series(by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select("__p", *by, F.last("__v", ignorenulls=True).over(gone).alias("__gone"))
    return meet(own, lasts, ["__p", *by]).select(*rows.columns, F.coalesce("__own", "__gone").alias(name))


def framed(rows: DataFrame, by: list[str], order: list[str], size: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Add window columns that look at no more than the last ``size`` rows of the series, the row itself included.

    ``columns`` gets an ordered window and returns them by name.
    """
    if not is_hot(rows, by):
        return rows.select("*", *[c.alias(n) for n, c in columns(_series(by).orderBy(*order)).items()])
    block = max(BLOCK_ROWS, size)
    df = placed(rows, by, order, "__i").withColumn("__own", F.floor(F.col("__i") / block))
    halo = F.col("__i") % block >= block - (size - 1)
    df = df.withColumn("__b", F.explode(F.when(halo, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    out = df.select("*", *[c.alias(n) for n, c in columns(_series(by, "__b").orderBy("__i")).items()])
    return out.filter("__b = __own").drop("__i", "__own", "__b")


def ranks(rows: DataFrame, by: list[str], value: str, shares: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per series, for each name, the value at a rank from 0; a function gives the rank by the count of values.

    Equal values meet as one row with a count before anything is sorted, so
    neither a frequent value nor a long series gathers in one task. Nulls don't count.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    if is_hot(counts, by):
        counts = stored(counts)
    total = counts.groupBy(*by).agg(F.sum("__n").alias("__all"))
    cum = running(counts, by, [value], __before=F.col("__n"))
    cum = meet(cum, total, by) if by else cum.crossJoin(F.broadcast(total))  # without keys: one row
    holds = lambda rank: F.when((F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n")), F.col(value))
    return cum.groupBy(*by).agg(*[F.max(holds(f(F.col("__all")))).alias(n) for n, f in shares.items()])


def medians(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """Per series, the exact median; the mean of the middle two for an even count."""
    half = lambda n: (n - 1) / 2
    found = ranks(rows, by, value, {"__lo": lambda n: F.floor(half(n)), "__hi": lambda n: F.ceil(half(n))})
    return found.select(*by, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) / 2).alias(name))
