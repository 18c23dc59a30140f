"""Queries of multi-turn verification, as a batch and as a stream with state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import dialogue
from textloom.plans.registry import query
from textloom.session import keep, shared_dir, table
from textloom.streaming import episodes

# Turns of a student: the turn before is what was asked for, said as it is, in part, or not at all.
_TURNS_SQL = """
p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations),
t AS (SELECT conv_id, turn, answer, CASE (conv_id + turn) % 4 WHEN 0 THEN '  ' || replace(answer, 'a', 'A') || ' ' WHEN 1 THEN text || ' waxin mnoku š' WHEN 2 THEN regexp_replace(answer, '\\s+\\S+\\s*$', '') || ' ŋš' ELSE answer || ' wax-a-yku, noku' END AS response,
  CASE conv_id % 6 WHEN 0 THEN 'morphology' WHEN 1 THEN 'word_translation' WHEN 2 THEN 'sentence_translation' WHEN 3 THEN 'reverse_translation' WHEN 4 THEN 'syntax' END AS kind,
  CASE (conv_id // 6) % 3 WHEN 0 THEN [] WHEN 1 THEN ['š'] ELSE ['š', 'ŋ', 'ŋ'] END AS letters, CASE (conv_id // 6) % 4 WHEN 0 THEN [] WHEN 1 THEN ['-ku', 'wa-'] WHEN 2 THEN ['-a-'] ELSE ['zz', '-ku'] END AS affixes FROM p WHERE answer IS NOT NULL)"""
_STATE_SQL = f"""
WITH {_TURNS_SQL},
m AS (SELECT *, list_sort(list_filter(list_distinct(letters), lambda x: NOT contains(response, x))) AS missing, string_split(trim(regexp_replace(lower(answer), '\\s+', ' ', 'g')), ' ') AS want, string_split(trim(regexp_replace(lower(response), '\\s+', ' ', 'g')), ' ') AS said,
  lower(regexp_replace(response, '^\\s+|\\s+$', '', 'g')) = lower(regexp_replace(answer, '^\\s+|\\s+$', '', 'g')) AS same, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS attempts FROM t),
f AS (SELECT *, len(missing) = 0 AS chars, coalesce(kind, '') <> 'morphology' OR len(list_filter(affixes, lambda a: CASE a WHEN '-ku' THEN NOT regexp_matches(response, '[\\p{{L}}\\p{{N}}_]+ku([^\\p{{L}}\\p{{N}}_]|$)') WHEN 'wa-' THEN NOT regexp_matches(response, '(^|[^\\p{{L}}\\p{{N}}_])wa[\\p{{L}}\\p{{N}}_]+') WHEN '-a-' THEN NOT contains(response, 'a') ELSE NOT contains(response, 'zz') END)) = 0 AS affixed,
  CASE WHEN same THEN 1.0 WHEN kind IN ('word_translation', 'sentence_translation') THEN len(list_intersect(list_distinct(want), said)) / len(list_distinct(want))::DOUBLE ELSE 0.0 END AS credit FROM m WHERE attempts <= 3),
g AS (SELECT *, same OR (kind IN ('word_translation', 'sentence_translation') AND credit > 0.8) AS means FROM f),
h AS (SELECT *, CASE WHEN kind = 'morphology' THEN chars AND affixed WHEN kind = 'reverse_translation' THEN chars AND means ELSE means END AS perfect FROM g),
told AS (SELECT conv_id, turn, attempts, chars AS special_chars_correct, affixed AS affixes_correct, coalesce(means, false) AS semantic_correct, round(credit::DOUBLE, 6) AS partial_credit,
  CASE WHEN chars AND affixed AND means THEN ' Correct! Well done.' ELSE array_to_string(list_filter([CASE WHEN NOT chars THEN 'Missing special characters: ' || array_to_string(missing, ', ') END, CASE WHEN NOT affixed THEN 'Required affixes: ' || array_to_string(affixes, ', ') END,
    CASE WHEN NOT coalesce(means, false) THEN CASE WHEN credit > 0.5 THEN 'Close, but not quite right. Check the exact form.' ELSE 'Incorrect. Expected: ' || answer END END], lambda x: x IS NOT NULL), ' | ') END AS feedback,
  coalesce(perfect, false) AS perfect, coalesce(perfect, false) OR attempts >= 3 AS completed FROM h),
live AS (SELECT * FROM (SELECT *, coalesce(max(completed::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM told) WHERE over = 0)
"""


def _student(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id")
    df = table(spark, sf_dir, "conversations").withColumn("answer", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("answer IS NOT NULL")
    said = (k + F.col("turn")) % 4
    response = F.when(said == 0, F.concat(F.lit("  "), F.replace("answer", F.lit("a"), F.lit("A")), F.lit(" "))).when(said == 1, F.concat("text", F.lit(" waxin mnoku š"))).when(said == 2, F.concat(F.regexp_replace("answer", r"\s+\S+\s*$", ""), F.lit(" ŋš"))).otherwise(F.concat("answer", F.lit(" wax-a-yku, noku")))
    kinds = ["morphology", "word_translation", "sentence_translation", "reverse_translation", "syntax"]
    kind = F.get(F.array(*map(F.lit, kinds)), (k % 6).cast("int"))
    strings = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    nth = F.floor(k / 6)
    letters = F.when(nth % 3 == 0, strings()).when(nth % 3 == 1, strings("š")).otherwise(strings("š", "ŋ", "ŋ"))
    affixes = F.when(nth % 4 == 0, strings()).when(nth % 4 == 1, strings("-ku", "wa-")).when(nth % 4 == 2, strings("-a-")).otherwise(strings("zz", "-ku"))
    return df.select("conv_id", "turn", "answer", response.alias("response"), kind.alias("kind"), letters.alias("letters"), affixes.alias("affixes"))


def _verified():
    c = F.col
    return dialogue.verify_turn(c("response"), c("answer"), c("kind"), c("letters"), c("affixes"))


_TOLD = ["attempts", "special_chars_correct", "affixes_correct", "semantic_correct", "partial_credit", "feedback", "perfect", "completed"]


@query(_STATE_SQL + "SELECT conv_id, turn, CAST(attempts AS BIGINT) AS attempts, special_chars_correct, affixes_correct, semantic_correct, partial_credit, feedback, perfect, completed FROM live")
def multi_turn_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn of a dialogue gets right and is told, up to the turn that ends it."""
    out = dialogue.multi_turn(_student(spark, sf_dir), "conv_id", "turn", _verified())
    return out.select("conv_id", "turn", *[F.round(c, 6).alias(c) if c == "partial_credit" else F.col(c).cast("long").alias(c) if c == "attempts" else c for c in _TOLD])


@query(_STATE_SQL + "SELECT conv_id, CAST(max(attempts) AS BIGINT) AS attempts, bool_or(perfect) AS solved, arg_max(feedback, attempts) AS feedback, max(partial_credit) AS partial_credit FROM live GROUP BY conv_id")
def multi_turn_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each dialogue ended."""
    out = dialogue.outcome(dialogue.multi_turn(_student(spark, sf_dir), "conv_id", "turn", _verified()), "conv_id")
    return out.select("conv_id", F.col("attempts").cast("long").alias("attempts"), "solved", "feedback", F.round("partial_credit", 6).alias("partial_credit"))


@query(_STATE_SQL + "SELECT conv_id, turn, CAST(attempts AS BIGINT) AS attempts, perfect, completed, feedback FROM live")
def multi_turn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same turn by turn over a stream of three batches, one of them out of order; attempts are kept as state."""
    at = keep(f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")
    turns = _student(spark, sf_dir).withColumn("ts", episodes.at_turn("turn"))
    parts = (F.col("turn") <= 1, F.col("turn").isin(3, 4), (F.col("turn") == 2) | (F.col("turn") > 4))
    source = episodes.in_batches(turns, f"{at}/in", parts)
    verified = source.withColumn("__v", _verified()).select("conv_id", "turn", "ts", "__v.perfect", "__v.feedback")
    out = episodes.drained(episodes.attempts(verified), f"{at}/out", f"{at}/checkpoint")
    return out.select("conv_id", "turn", "attempts", "perfect", "completed", "feedback")


_LOOKUPS_SQL = """
WITH t AS (SELECT conv_id, turn, role = 'assistant' AND turn < 5 AS ask, role = 'assistant' AND turn >= 5 AS answer FROM conversations),
n AS (SELECT *, sum(ask::INT) OVER w AS asked FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, answer OR (ask AND asked > 3) AS stop FROM n),
l AS (SELECT *, coalesce(max(stop::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM s)
SELECT conv_id, count(*) FILTER (WHERE ask AND asked <= 3) AS lookups, bool_or(ask AND asked <= 3 AND turn = 3) AS target_seen, bool_or(ask AND asked > 3) AS budget_exhausted, bool_or(stop) AS done, NOT bool_or(stop) AS expired
FROM l WHERE over = 0 GROUP BY conv_id
"""


@query(_LOOKUPS_SQL)
def lookup_session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup episodes as a stream with timers: turns out of order are held, episodes without an answer expire."""
    at = keep(f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")
    said = F.when(F.col("role") != "assistant", F.col("text")).when(F.col("turn") >= 5, F.lit("ANSWER: x")).otherwise(F.concat(F.lit("LOOKUP: w"), F.col("turn")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", said.alias("text"), F.lit("w3").alias("target"), episodes.at_turn("turn").alias("ts"))
    parts = (F.col("turn").isin(0, 2), F.col("turn").isin(1, 3, 5), ~F.col("turn").isin(0, 1, 2, 3, 5))
    source = episodes.in_batches(turns, f"{at}/in", parts)
    out = episodes.drained(episodes.lookups(source), f"{at}/out", f"{at}/checkpoint")
    return out.select("conv_id", "lookups", "target_seen", "budget_exhausted", "done", "expired")
