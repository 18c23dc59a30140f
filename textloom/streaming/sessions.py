"""Structured Streaming: metric tails, running roll-ups, and stateful lookup episodes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.functions import text as X

BUDGET = 3
#: What an assistant writes to look a word up.
LOOKUP = r"(?i)LOOKUP\s*:\s*([^\n]+)"


def tail(spark: SparkSession, path: str, schema: str, fmt: str = "json", per_trigger: int = 64) -> DataFrame:
    """An append-only folder of files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Write all that is there, then stop; a later call goes on where it left off."""
    stream.writeStream.outputMode(mode).format(fmt).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_latest(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """A running aggregate's last state: each batch writes the whole result to a folder of its own, distributed."""
    last: list[str] = []

    def put(batch: DataFrame, number: int) -> None:
        at = f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        last[:] = [at]

    query = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(last[0])


def step_means(metrics: DataFrame) -> DataFrame:
    """Mean of each metric at each step; batch or stream."""
    long = metrics.select("step", F.explode("metrics").alias("metric", "value"))
    return long.groupBy("step", "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by event-time window with a watermark; batch or stream."""
    w = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    return events.withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n"))


def session_windows(events: DataFrame, ts: str, keys: list[str], gap: str, value: str, late: str = "1 hour") -> DataFrame:
    """A key's events with no more than ``gap`` from one to the next: start, end (the last event plus the gap), count and sum; batch or stream.

    Windows of a key merge as events come between them. A stream gives a window
    out once the watermark has passed its end; events behind it are dropped.
    Partial windows are merged before they are shuffled.
    """
    w = F.session_window(F.col(ts), gap)
    merged = events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(ts).alias("last"))
    return merged.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "last", "n", "total")


def trace_group_stats(traces: DataFrame) -> DataFrame:
    """Mean reward and size of each group of rollouts; batch or stream."""
    return traces.groupBy("run", "pass", "batch", "group_id").agg(F.avg("reward").alias("mean_reward"), F.count("*").alias("rollouts"), F.max("reward").alias("best"))


_EPISODE = "conv_id long, lookups long, target_seen boolean, budget_exhausted boolean, done boolean"


def _visible_call(role, content):
    said = (content or "").split("</think>")[-1]
    if role != "assistant":
        return None, False
    if "ANSWER" in said.upper():
        return None, True
    at = said.upper().find("LOOKUP:")
    return (said[at + 7 :].split("\n")[0].strip() or None) if at >= 0 else None, at < 0


def lookup_episodes(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Stateful episodes over a stream of turns (conv_id, turn, role, text, target).

    An episode counts lookups up to its budget, whether the target was looked
    up, and whether it asked for more; an answer ends it. Turns of a batch are
    put in order; later batches hold later turns. Emits an episode's state
    after each batch that changes it.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lookups, seen, over, done = state.get if state.exists else (0, False, False, False)
        for row in pd.concat(list(frames)).sort_values("turn").itertuples():
            if done:
                break
            word, done = _visible_call(row.role, row.text)
            if word is not None:
                if lookups < budget:
                    lookups += 1
                    seen = seen or word == row.target
                else:
                    over, done = True, True
        state.update((lookups, bool(seen), bool(over), bool(done)))
        yield pd.DataFrame([(key[0], lookups, bool(seen), bool(over), bool(done))], columns=["conv_id", "lookups", "target_seen", "budget_exhausted", "done"])

    kept = "lookups long, target_seen boolean, budget_exhausted boolean, done boolean"
    return turns.groupBy("conv_id").applyInPandasWithState(run, _EPISODE, kept, "update", GroupStateTimeout.NoTimeout)


def lookup_episodes_batch(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The same over a table, by windows."""
    said = F.substring_index(X.text(F.col("text")), "</think>", -1)
    own = F.col("role") == "assistant"
    answer = F.contains(F.upper(said), F.lit("ANSWER"))
    at = F.instr(F.upper(said), "LOOKUP:")
    word = F.nullif(F.trim(F.regexp_extract(F.substring(said, at + 7, F.length(said)), r"^([^\n]*)", 1)), F.lit(""))
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = turns.withColumn("word", F.when(own & ~answer & (at > 0), word)).withColumn("ends", own & (answer | (at == 0)))
    df = df.withColumn("asked", F.count("word").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("stop", F.col("ends") | (F.col("word").isNotNull() & (F.col("asked") > budget)))
    before = F.coalesce(F.max(F.col("stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("live", before == 0).filter("live")
    real = F.col("word").isNotNull() & (F.col("asked") <= budget)
    return df.groupBy("conv_id").agg(
        F.count_if(real).alias("lookups"),
        F.coalesce(F.bool_or(real & (F.col("word") == F.col("target"))), F.lit(False)).alias("target_seen"),
        F.bool_or(F.col("word").isNotNull() & (F.col("asked") > budget)).alias("budget_exhausted"),
        F.bool_or("stop").alias("done"),
    )
