"""Chat formatting: cumulative snapshots collapse to maximal conversations.

Logs hold one conversation many times, as it grew. A rolling hash of the turns
identifies every prefix: 128 bits, the running exclusive or of the hashes of
(position, role, text). A conversation that equals a proper prefix of another
goes by an anti-join against the distinct proper prefixes; of equal ones the
smallest id stays. What stays is rendered.

Exclusive or is associative, so hashes and positions run within blocks of turn
numbers and are shifted by the blocks before: a conversation that holds a third
of all rows is dealt over its blocks, and is rendered in as many segments.

Defined cases: rows without a conversation id belong to no conversation and are
left out; null roles and texts count as empty; turns come by number, nulls
first, then by role and text, so repeated rows are turns of their own; empty
tables give no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import stored

#: Turn numbers of a block.
BLOCK = 1024


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A stored table of turns: conv, block, pos (from 1), role, text, and the prefix hash up to the turn."""
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
    sizes = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("__rank", F.row_number().over(order)).join(sizes, ["conv", "block"])
    rows = rows.withColumn("pos", F.col("__before") + F.col("__rank")).drop("__before", "__rank", "turn")
    rows = rows.withColumn("h1", F.xxhash64("pos", "role", "text")).withColumn("h2", F.xxhash64("text", F.lit("second"), "role", "pos"))
    running = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return stored(rows.withColumn("h1", F.bit_xor("h1").over(running)).withColumn("h2", F.bit_xor("h2").over(running)))


def maximal(stored_turns: DataFrame) -> DataFrame:
    """Conversations that prefix no longer one: conv and its number of turns, ``n``."""
    last = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored_turns.groupBy("conv", "block").agg(F.max("pos").alias("end"), F.max_by("h1", "pos").alias("b1"), F.max_by("h2", "pos").alias("b2"))
    blocks = blocks.select("conv", "block", "end", "b1", "b2", *[F.coalesce(F.bit_xor(f"b{i}").over(last), F.lit(0)).alias(f"o{i}") for i in (1, 2)])
    whole = blocks.groupBy("conv").agg(F.max("end").alias("n"), F.bit_xor("b1").alias("h1"), F.bit_xor("b2").alias("h2"))
    totals = blocks.select("conv", "block", "o1", "o2").join(whole.select("conv", "n"), "conv")
    prefixes = stored_turns.select("conv", "block", "pos", "h1", "h2").join(totals, ["conv", "block"]).filter("pos < n")
    prefixes = prefixes.select(F.col("pos").alias("n"), F.expr("h1 ^ o1").alias("h1"), F.expr("h2 ^ o2").alias("h2")).distinct()
    # equal conversations meet before the join, pre-aggregated, so a hot one is a few rows
    first = whole.groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv"))
    return first.join(prefixes, ["n", "h1", "h2"], "left_anti").select("conv", "n")


def render(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Maximal conversations as text: ``id_col``, n_turns, segment (from 0) and text.

    A turn is ``<|role|>``, a line feed, its text, ``<|end|>`` and a line feed.
    """
    each = turns(conversations, id_col, turn_col, role_col, text_col)
    kept = maximal(each)
    segments = each.select("conv", "block", "pos", "role", "text").join(kept, "conv")
    shown = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    segments = segments.groupBy("conv", "n", "block").agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("s")))).alias("parts"))
    order = Window.partitionBy("conv").orderBy("block")
    return segments.select(
        F.col("conv").alias(id_col),
        F.col("n").alias("n_turns"),
        (F.row_number().over(order) - 1).cast("long").alias("segment"),
        F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("text"),
    )
