"""Queries of Structured Streaming, drained to a table so that they can be compared with batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.registry import query
from textloom.session import keep, shared_dir, table
from textloom.streaming import sessions


_EPISODES = """
WITH t AS (SELECT conv_id, turn, role = 'assistant' AND turn < 5 AS ask, role = 'assistant' AND turn >= 5 AS answer FROM conversations), n AS (SELECT *, sum(ask::INT) OVER w AS asked FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, answer OR (ask AND asked > 3) AS stop FROM n), l AS (SELECT *, coalesce(max(stop::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM s)
SELECT conv_id, count(*) FILTER (WHERE ask AND asked <= 3) AS lookups, bool_or(ask AND asked <= 3 AND turn = 3) AS target_seen, bool_or(ask AND asked > 3) AS budget_exhausted, bool_or(stop) AS done FROM l WHERE over = 0 GROUP BY conv_id
"""


def _place(spark: SparkSession) -> str:
    return keep(f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lookup episodes: an assistant's turns look a word up, and answer from turn 5 on."""
    said = F.when(F.col("role") != "assistant", F.col("text")).when(F.col("turn") >= 5, F.lit("ANSWER: x")).otherwise(F.concat(F.lit("LOOKUP: w"), F.col("turn")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", said.alias("text"), F.lit("w3").alias("target"))


@query(_EPISODES)
def lookup_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful episodes over a stream of turns, which come in three batches by their numbers; the last state of each."""
    at, turns = _place(spark), _turns(spark, sf_dir)
    for part in (F.col("turn") < 2, F.col("turn").between(2, 3), F.col("turn") > 3):  # files are read in the order of their times
        turns.filter(part).repartition(1).write.mode("append").parquet(f"{at}/in")
    source = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    stream = sessions.lookup_episodes(source)
    out = f"{at}/out"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("conv_id").agg(F.max_by(F.struct("lookups", "target_seen", "budget_exhausted", "done"), "batch").alias("s"))
    return last.select("conv_id", "s.*")


@query(_EPISODES)
def lookup_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.lookup_episodes_batch(_turns(spark, sf_dir))


@query("SELECT event_type AS metric, CAST(user_id % 10 AS BIGINT) AS step, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY ALL")
def tail_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows written as files, tailed as a stream of several batches, and averaged by step."""
    at = _place(spark)
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("step"), F.create_map("event_type", "value").alias("metrics"))
    rows.repartition(3).write.json(f"{at}/in")
    stream = sessions.step_means(sessions.tail(spark, f"{at}/in", "step long, metrics map<string,double>", per_trigger=1))
    return sessions.drain_latest(stream, f"{at}/out", f"{at}/checkpoint").select("metric", "step", F.round("mean", 6).alias("mean"), "n")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by event time; batch form of the watermarked stream."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = sessions.windowed_counts(ev, "ts", ["event_type"], "1 day")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""
WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, event_type FROM events), x AS (SELECT max(ts) AS top, min(ts) AS low FROM e)
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM e, x WHERE ts >= date_trunc('day', low) + INTERVAL 2 DAY GROUP BY ALL
""")
def windowed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of a stream whose first two days come last: they lie behind the watermark and are dropped."""
    at = _place(spark)
    ev = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    low = ev.agg(F.date_trunc("day", F.min("ts"))).first()[0]
    late = F.col("ts") < F.lit(low) + F.expr("INTERVAL 2 DAYS")
    end = ev.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"), F.lit(None).cast("string").alias("event_type"))
    # in time order, then a row that moves the watermark on, then what is late
    for part in (ev.filter(~late), end, ev.filter(late)):
        part.repartition(1).write.mode("append").parquet(f"{at}/in")
    source = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    sessions.drain(sessions.windowed_counts(source, "ts", ["event_type"], "1 day"), f"{at}/out", f"{at}/checkpoint")
    out = spark.read.parquet(f"{at}/out").filter("event_type is not null")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


_SESSIONS = """
WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, user_id % 50 AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events), x AS (SELECT date_trunc('day', min(ts)) + INTERVAL 2 DAY AS low FROM e),
f AS (SELECT e.* FROM e, x WHERE {live}),
g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 3 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM f WINDOW w AS (PARTITION BY k ORDER BY ts)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g)
SELECT k, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM i GROUP BY k, island
"""


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 50).alias("k"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def _shown_sessions(out: DataFrame) -> DataFrame:
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.select("k", shown("start"), shown("last"), "n", "total")


@query(_SESSIONS.format(live="true"))
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events by key, three quiet hours apart."""
    return _shown_sessions(sessions.session_windows(_timed(spark, sf_dir), "ts", ["k"], "3 hours", "cents"))


@query(_SESSIONS.format(live="ts >= low"))
def session_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream whose batches overlap in time, so that sessions grow and merge; the first two days come last, behind the watermark, and are dropped."""
    at, ev = _place(spark), _timed(spark, sf_dir)
    low = ev.agg(F.date_trunc("day", F.min("ts"))).first()[0]
    late = F.col("ts") < F.lit(low) + F.expr("INTERVAL 2 DAYS")
    hour = F.hour("ts")
    ends = [ev.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr(f"INTERVAL {d} DAYS")).alias("ts"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("cents")) for d in (50, 51, 52)]
    live = ev.filter(~late)
    # even hours, then odd ones: what lies between merges windows of the first batch; a batch is late by the watermark before its last
    for part in (live.filter(hour % 2 == 0), live.filter(hour % 2 == 1), *ends[:2], ev.filter(late), ends[2]):
        part.repartition(1).write.mode("append").parquet(f"{at}/in")
    source = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    sessions.drain(sessions.session_windows(source, "ts", ["k"], "3 hours", "cents", late="40 days"), f"{at}/out", f"{at}/checkpoint")
    return _shown_sessions(spark.read.parquet(f"{at}/out").filter("k IS NOT NULL"))


@query("SELECT user_id % 20 AS run, event_type AS group_id, round(avg(value), 6) AS mean_reward, count(*) AS rollouts, max(value) AS best FROM events GROUP BY ALL")
def trace_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run"), F.lit(0).alias("pass"), F.lit(0).alias("batch"), F.col("event_type").alias("group_id"), F.col("value").alias("reward"))
    return sessions.trace_group_stats(t).select("run", "group_id", F.round("mean_reward", 6).alias("mean_reward"), "rollouts", "best")
