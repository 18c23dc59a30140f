"""Joins, set operations and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators import ranges
from textloom.session import stored


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def resolve_refs(src: DataFrame, ref_col: str, keyed: DataFrame, key_col: str, id_col: str) -> DataFrame:
    """Each reference with the sorted ids that its key has (an empty list if none) and ``resolved``."""
    ids = keyed.filter(F.col(key_col).isNotNull()).groupBy(F.col(key_col).alias("__key")).agg(F.array_sort(F.collect_list(id_col)).alias("dst_ids"))
    out = src.join(ids, src[ref_col] == F.col("__key"), "left").drop("__key")
    out = out.withColumn("resolved", F.col("dst_ids").isNotNull())
    return out.withColumn("dst_ids", F.coalesce("dst_ids", F.array().cast(ids.schema["dst_ids"].dataType)))


def witnesses(forms: DataFrame, form: str, loose: str, keys: DataFrame, key: str, loose_key: str) -> DataFrame:
    """Add ``witness``: exact if a form is a key, loose if only its loose form is one's, else null."""
    exact = keys.select(F.col(key).alias("__k")).distinct().withColumn("__exact", F.lit(True))
    near = keys.select(F.col(loose_key).alias("__l")).distinct().withColumn("__near", F.lit(True))
    out = forms.join(exact, forms[form] == F.col("__k"), "left").join(near, forms[loose] == F.col("__l"), "left")
    return out.withColumn("witness", F.when(F.col("__exact"), "exact").when(F.col("__near"), "loose")).drop("__k", "__l", "__exact", "__near")


def attest_count(keys: DataFrame, key: str, seen: DataFrame, seen_key: str) -> DataFrame:
    """Add ``attested``: how often ``seen`` has the key."""
    counts = seen.groupBy(F.col(seen_key).alias("__k")).agg(F.count("*").alias("attested"))
    return keys.join(counts, keys[key] == F.col("__k"), "left").drop("__k").withColumn("attested", F.coalesce("attested", F.lit(0)))


def homographs(rows: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Per key, how many rows share it and how many distinct values they have."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(f"n_{c}") for c in cols])


def anti_overlap(train: DataFrame, held: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Training rows that equal no held-out row in any of the key sets; one anti-join for each."""
    for key in keys:
        side = held.select(*[F.trim(F.col(k).cast("string")).alias(f"__{k}") for k in key]).distinct()
        cond = [F.trim(train[k].cast("string")) == side[f"__{k}"] for k in key]
        train = train.join(side, cond, "left_anti")
    return train


def lookup(asked: DataFrame, word: str, loose: str, keyed: DataFrame, key: str, loose_key: str, shown: str, most: int = 3) -> DataFrame:
    """What a dictionary says: all texts of the exact key, else up to ``most`` near keys, else nothing."""
    exact = keyed.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_list(shown)).alias("__texts"))
    near = keyed.groupBy(F.col(loose_key).alias("__l")).agg(F.slice(F.array_sort(F.collect_set(key)), 1, most).alias("__near"))
    out = asked.join(exact, asked[word] == F.col("__k"), "left").join(near, asked[loose] == F.col("__l"), "left")
    found = F.when(F.col("__texts").isNotNull(), F.array_join("__texts", " | "))
    hint = F.when(F.col("__near").isNotNull(), F.concat(F.lit("near: "), F.array_join("__near", ", ")))
    out = out.withColumn("found", F.coalesce(found, hint, F.lit("no entry"))).withColumn("hit", F.col("__texts").isNotNull())
    return out.drop("__k", "__l", "__texts", "__near")


def unique_match(asked: DataFrame, ask: str, keyed: DataFrame, key: str, value: str) -> DataFrame:
    """Add ``value`` where the key has exactly one distinct value; null elsewhere."""
    one = keyed.groupBy(F.col(key).alias("__k")).agg(F.min(value).alias(value), F.countDistinct(value).alias("__n")).filter("__n = 1")
    return asked.join(one.drop("__n"), asked[ask] == F.col("__k"), "left").drop("__k")


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], value: str, tie: str) -> DataFrame:
    """Backward as-of: the last right row at or before each left row, as one merge sort by key.

    ``tie`` orders right rows of one time. Left rows without a match have nulls.
    A key with very many rows is dealt by ranges of its times, and the last right
    row of a range is carried over to the next.
    """
    names = [c for c in left.columns if c not in (*by, on)]
    r = right.select(*by, F.col(on), F.lit(0).alias("__side"), F.struct(F.col(on).alias("at"), F.col(value).alias("v")).alias("__r"), F.col(tie).cast("string").alias("__tie"), F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("__l"))
    lf = left.select(*by, F.col(on), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.lit("").alias("__tie"), F.struct(*names).alias("__l"))
    both = ranges.carried(r.unionByName(lf), by, [on, "__side", "__tie"], "__r", "__m").filter("__side = 1")
    return both.select(*by, on, "__l.*", F.col("__m.at").alias(f"{on}_right"), F.col("__m.v").alias(value))


def nearest(rows: DataFrame, points: DataFrame, by: list[str], step: str, at: str, value: str) -> DataFrame:
    """For each point, the value of the row whose step is nearest; the smaller step on ties.

    Points are few per group; only those of a group meet its rows.
    """
    gap = F.abs(F.col(step) - F.col(at))
    return points.join(rows, by).groupBy(*by, at).agg(F.min_by(F.struct(F.col(step), F.col(value)), F.struct(gap, F.col(step))).alias("__b")).select(*by, at, F.col(f"__b.{step}").alias("nearest_step"), F.col(f"__b.{value}").alias(value))


def dedup_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def append_if_new(base: DataFrame, extra: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``base`` and the rows of ``extra`` with keys that neither it nor an earlier extra row has."""
    new = dedup_first(extra, keys, order)
    return base.unionByName(new.join(base.select(*keys).distinct(), keys, "left_anti").select(*base.columns))


def dedup_merge(rows: DataFrame, key: str, order: str, confidence: str, fields: list[str], id_col: str, aliases: str, examples: str) -> DataFrame:
    """Merge the rows of a key as a fold in source order would.

    A row is a record if it is the first or more confident than all before it.
    A field is the last record's that has it; the confidence is the highest, or
    the first row's own if none is higher; aliases are all distinct values in
    order; examples are those from the last record that has some; the ids of
    all rows but the first are listed as absorbed. A null key is a key like any
    other; null lists count as empty; the order must be total within a key.

    A key may hold any number of rows: `merge_parts` does the work, and an array
    is made only of what the result itself lists.
    """
    heads, values, absorbed = merge_parts(rows, key, order, confidence, fields, id_col, aliases, examples)
    listed = values.groupBy(key).agg(*[_in_order(F.when(F.col("kind") == kind, F.struct("n", "place", "value"))).alias(kind) for kind in ("aliases", "examples")])
    out = ranges.meet(heads, listed, [key])
    out = ranges.meet(out, absorbed.groupBy(key).agg(_in_order(F.struct("n", F.col("id").alias("value"))).alias("absorbed")), [key])
    empty = lambda c, like: F.coalesce(F.col(c), F.array().cast(like)).alias(c)
    lists = [F.coalesce(kind, F.array().cast(rows.schema[c].dataType)).alias(c) for kind, c in (("aliases", aliases), ("examples", examples))]
    return out.select(key, id_col, *fields, confidence, *lists, empty("absorbed", T.ArrayType(rows.schema[id_col].dataType)))


def _in_order(item: Column) -> Column:
    """The values of structs that sort by what comes before ``value``; nulls are left out."""
    return F.transform(F.array_sort(F.collect_list(item)), lambda x: x["value"])


def merge_parts(rows: DataFrame, key: str, order: str, confidence: str, fields: list[str], id_col: str, aliases: str, examples: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `dedup_merge` finds, in three tables in which no row grows with a key's rows.

    The first has a row a key: id, fields and confidence. The second has the
    distinct values (key, kind, value) of ``kind`` aliases or examples and where
    each comes first (n, place). The third has the absorbed rows (key, n, id).

    A row needs of the rows before it only their number and highest confidence,
    which `ranges.running` carries over ranges; all else is a maximum or minimum
    that is merged in any order, so parts of a key meet as one row each.
    """
    df = rows.withColumn("__c", F.coalesce(F.col(confidence), F.lit(0.0)))
    df = ranges.running(df, [key], [order], highest={"__top": F.col("__c")}, __n=F.lit(1))
    df = stored(df.withColumn("__rec", F.col("__top").isNull() | (F.col("__c") > F.col("__top"))))
    has = lambda f: F.when(F.col("__rec") & _truthy(F.col(f)), F.col("__n"))
    shown = F.col("__rec") & (F.coalesce(F.size(examples), F.lit(0)) > 0)
    heads = df.groupBy(key).agg(
        F.min_by(id_col, "__n").alias(id_col),
        *[F.max_by(f, has(f)).alias(f) for f in fields],
        F.when(F.max("__c") > F.min_by("__c", "__n"), F.max("__c")).otherwise(F.min_by(F.col(confidence), "__n")).alias(confidence),
        F.coalesce(F.max(F.when(shown, F.col("__n"))), F.lit(0)).alias("__last"),
    )
    said = df.select(key, "__n", F.lit("aliases").alias("kind"), F.posexplode(aliases).alias("place", "value"))
    late = ranges.meet(df.select(key, "__n", examples), heads.select(key, "__last"), [key]).filter("__n >= __last")
    said = said.unionByName(late.select(key, "__n", F.lit("examples").alias("kind"), F.posexplode(examples).alias("place", "value")))
    values = said.groupBy(key, "kind", "value").agg(F.min(F.struct(F.col("__n").alias("n"), "place")).alias("f")).select(key, "kind", "value", "f.n", "f.place")
    return heads.drop("__last"), values, df.filter("__n > 0").select(key, F.col("__n").alias("n"), F.col(id_col).alias("id"))


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """The rows as structs ``name`` with their place ``pos`` (from 1) in an order.

    Rows are dealt by ranges of the order and stored; a place is a row's number in
    its part, shifted by the sizes of the parts before, so no task sees all rows.
    """
    dealt = rows.select(F.struct(*rows.columns).alias(name), F.col(order).alias("__o")).repartitionByRange("__o").sortWithinPartitions("__o")
    dealt = stored(dealt.select(name, F.monotonically_increasing_id().alias("__i")))
    part, place = F.shiftright("__i", 33), F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    # one row a part: as many as there are shuffle partitions
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.withColumn("__p", part).join(F.broadcast(sizes), "__p").select(name, (place + F.col("__before") + 1).alias("pos"))


def pair_zip(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows of two tables by position, as structs a and b; raises if their lengths differ."""
    if a.count() != b.count():
        raise ValueError("both sides need the same number of rows")
    return numbered(a, order_a, "a").join(numbered(b, order_b, "b"), "pos")


def last_assistant(messages: Column) -> Column:
    """The last assistant's content of an array of (role, content), else the last content."""
    own = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.coalesce(F.try_element_at(own, F.lit(-1))["content"], F.try_element_at(messages, F.lit(-1))["content"], F.lit(""))


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left: keys that no non-empty output has."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
