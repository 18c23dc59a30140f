"""Splits and samples. A choice at random is a rank by hash: repeatable under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int | str, *keys: str) -> list[Column]:
    """Order by sha256 of the seed and the keys, then by the keys."""
    return [F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256), *[F.col(k) for k in keys]]


def ranked(rows: DataFrame, strata: list[str], key: str, seed: int = 42) -> DataFrame:
    """Add ``__nth``, the place in its stratum's hash order (from 1), and ``__total``, the stratum's size.

    Places are counted within 4096 hash ranges and shifted by the sizes of the
    ranges before, so a stratum that holds most rows is dealt over many tasks.
    """
    h, *_ = hash_order(seed, key)
    df = rows.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, 3))
    sizes = df.groupBy(*strata, "__b").agg(F.count("*").alias("__n"))
    every = Window.partitionBy(*strata)
    before = every.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(strata)], F.col("__b").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(every).alias("__total"))
    same = [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(strata)]
    inside = Window.partitionBy(*strata, "__b").orderBy("__h", key)
    df = df.withColumn("__i", F.row_number().over(inside)).join(sizes, [F.col("__b") == F.col("__r"), *same])
    return df.withColumn("__nth", F.col("__before") + F.col("__i")).drop("__h", "__b", "__r", "__i", "__before", *[f"__s{i}" for i in range(len(strata))])


def stratified_split(rows: DataFrame, strata: list[str], key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``split``: of each stratum the half-even share is heldout. A null is a stratum like any other."""
    heldout = F.col("__nth") <= F.bround(F.col("__total") * F.lit(share))
    return ranked(rows, strata, key, seed).withColumn("split", F.when(heldout, "heldout").otherwise("train")).drop("__nth", "__total")


def cut_by_hash(rows: DataFrame, key: str, share: float, seed: int = 42, names: tuple[str, str] = ("train", "valid")) -> DataFrame:
    """Add ``split``: the first ``floor(n * share)`` rows of the hash order, exactly.

    The cut is found from counts of 4096 hash ranges; only the range that holds
    it is ranked, so nothing is sorted as a whole.
    """
    h, *_ = hash_order(seed, key)
    df = rows.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, 3))
    sizes = sorted((r[0], r[1]) for r in df.groupBy("__b").agg(F.count("*")).collect())
    want = int(sum(n for _, n in sizes) * share + 1e-9)
    before, at = 0, None
    for b, n in sizes:
        if before + n > want:
            at = b
            break
        before += n
    if at is None:
        return df.withColumn("split", F.lit(names[0])).drop("__h", "__b")
    inside = df.filter(F.col("__b") == at).withColumn("__n", F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)))
    inside = inside.withColumn("split", F.when(F.col("__n") <= want - before, names[0]).otherwise(names[1])).drop("__n")
    rest = df.filter(F.col("__b") != at).withColumn("split", F.when(F.col("__b") < at, names[0]).otherwise(names[1]))
    return rest.unionByName(inside).drop("__h", "__b")


def spot_check(rows: DataFrame, key: str, share: float = 0.01, seed: int = 42) -> DataFrame:
    """The half-even share of all rows, one at least, first in the hash order."""
    chosen = F.col("__nth") <= F.greatest(F.lit(1), F.bround(F.col("__total") * F.lit(share)))
    return ranked(rows, [], key, seed).filter(chosen).drop("__nth", "__total")


def limit_per_group(rows: DataFrame, group: list[str], key: str, k: int, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*hash_order(seed, key))
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def tiered_sample(rows: DataFrame, tier: str, key: str, budget: int, seed: int = 42) -> DataFrame:
    """``budget`` rows: all of the lowest tiers that fit, and of the next one the first in hash order."""
    return rows.orderBy(F.col(tier), *hash_order(seed, key)).limit(budget)


def balanced_examples(rows: DataFrame, group: list[str], label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """Up to ``k`` rows of each label in each group."""
    return limit_per_group(rows, [*group, label], key, k, seed)


def upsample(rows: DataFrame, chosen: Column, times: int = 1) -> DataFrame:
    """Append the chosen rows ``times`` more."""
    out = rows
    for _ in range(times):
        out = out.unionAll(rows.filter(chosen))
    return out


def random_choice(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return rows.orderBy(*hash_order(seed, key)).limit(1)


def head_tail(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first and the last ``n`` rows; each row once."""
    return rows.orderBy(order).limit(n).union(rows.orderBy(F.desc(order)).limit(n)).distinct()
