"""Queries of ordered analytics, on events and their daily totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import metrics, ranges, relops
from textloom.plans.registry import query
from textloom.session import table

_DAILY = """d AS (SELECT event_type AS series, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS step, sum(value) AS v FROM events GROUP BY 1, 2),
t AS (SELECT series, step, v, sum(v) OVER (PARTITION BY series ORDER BY step) AS total FROM d)"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of values by type and day, and their running total."""
    step = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), step.alias("step")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("series").orderBy("step")
    return d.withColumn("total", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))


@query("""
SELECT event_id, round(CASE WHEN count(value) OVER w25 >= 5 THEN avg(value) OVER w25 END, 6) AS mean25, round(CASE WHEN count(value) OVER w10 >= 5 THEN stddev_samp(value) OVER w10 END, 6) AS std10,
       round(CASE WHEN count(value) OVER w15 >= 1 THEN avg(value) OVER w15 END, 6) AS trailing15,
       round(value - lag(value) OVER w, 6) AS diff, round(sum(coalesce(value, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS cumsum
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), w25 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 24 PRECEDING), w10 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING), w15 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 14 PRECEDING)
""")
def rolling_mean_min_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    by, order, v = ["user_id"], ["ts", "event_id"], F.col("value")
    rolled = lambda w: {"mean25": metrics.rolling(v, w, 25, 5), "std10": metrics.rolling(v, w, 10, 5, "std"), "trailing15": metrics.rolling(v, w, 15, 1), "diff": metrics.diff(v, w)}
    df = ranges.framed(metrics.running_total(table(spark, sf_dir, "events").select(*by, *order, "value"), by, order, "value", "cumsum"), by, order, 25, rolled)
    return df.select("event_id", *[F.round(c, 6).alias(c) for c in ("mean25", "std10", "trailing15", "diff")], F.round("cumsum", 4).alias("cumsum"))


@query(f"""
WITH {_DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY step) AS i, greatest(5, CAST(floor(count(*) OVER (PARTITION BY series) * 0.2::DOUBLE) AS BIGINT)) AS w FROM t)
SELECT a.series, a.step, round(CASE WHEN count(b.v) >= 5 THEN avg(b.v) END, 4) AS rolling FROM n a JOIN n b ON a.series = b.series AND b.i BETWEEN a.i - a.w + 1 AND a.i GROUP BY a.series, a.step
""")
def rolling_mean_frac(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.rolling_frac(_daily(spark, sf_dir), ["series"], "step", "v", share=0.2)
    return out.select("series", "step", F.round("rolling", 4).alias("rolling"))


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
       arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS final_value, count(*) FILTER (WHERE value <> 0) AS nonzero FROM events GROUP BY event_type
""")
def channel_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.describe(table(spark, sf_dir, "events"), ["event_type"], "value", "event_id")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std")})


@query(f"""
WITH {_DAILY}, e AS (SELECT series, arg_min(total, step) AS a, arg_max(total, step) AS z FROM t GROUP BY series)
SELECT t.series, f AS fraction, min(step) AS step FROM t JOIN e USING (series), (SELECT unnest([0.25::DOUBLE, 0.5, 0.75, 0.9]) AS f) WHERE total >= a + f * (z - a) GROUP BY t.series, f
""")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.milestones(_daily(spark, sf_dir), ["series"], "step", "total")


@query(f"""
WITH {_DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY series) AS c FROM t)
SELECT series, round(avg(v) FILTER (WHERE i < c // 2), 4) AS first_half, round(avg(v) FILTER (WHERE i >= c // 2), 4) AS second_half,
       CASE WHEN arg_max(v, i) > arg_min(v, i) THEN 'up' WHEN arg_max(v, i) < arg_min(v, i) THEN 'down' ELSE 'flat' END AS trend
FROM n WHERE c > 10 GROUP BY series
""")
def half_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.half_trend(_daily(spark, sf_dir), ["series"], "step", "v")
    return out.withColumns({c: F.round(c, 4) for c in ("first_half", "second_half")})


@query(f"WITH {_DAILY} SELECT series, arg_min(step, step) FILTER (WHERE v = m) AS best_step, round(max(v), 4) AS best FROM (SELECT *, max(v) OVER (PARTITION BY series) AS m FROM t) GROUP BY series")
def best_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_step(_daily(spark, sf_dir), ["series"], "step", "v").withColumn("best", F.round("best", 4))


@query(f"""
WITH {_DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY series) AS c, min(total) OVER (PARTITION BY series) AS low FROM t)
SELECT series, round(regr_slope(total, CAST(step AS DOUBLE)) FILTER (WHERE i < greatest(5, c // 10)), 3) AS early_slope, round(ln(2) / regr_slope(ln(total - low + 1e-6), CAST(i AS DOUBLE)), 3) AS doubling_steps FROM n WHERE c >= 10 GROUP BY series
""")
def slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.slopes(_daily(spark, sf_dir), ["series"], "step", "total")
    return out.withColumns({c: F.round(c, 3) for c in ("early_slope", "doubling_steps")})


@query(f"""
WITH {_DAILY}
SELECT series, round(arg_min(total, step), 4) AS initial, round(arg_max(total, step), 4) AS final, round(max(total), 4) AS highest, max(step) - min(step) AS steps, round(arg_max(total, step) - arg_min(total, step), 4) AS improvement,
       round((arg_max(total, step) - arg_min(total, step)) / nullif(max(step) - min(step), 0), 4) AS rate FROM t GROUP BY series
""")
def sample_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.sample_efficiency(_daily(spark, sf_dir), ["series"], "step", "total")
    return out.withColumns({c: F.round(c, 4) for c in ("initial", "final", "highest", "improvement", "rate")})


@query("""
WITH s AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'signup'), e AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'signup')
SELECT e.event_id, (SELECT arg_max(value, (ts, CAST(event_id AS VARCHAR))) FROM s WHERE s.user_id = e.user_id AND s.ts <= e.ts) AS value FROM e
""")
def asof_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest signup's value at or before each other event of a user."""
    ev = table(spark, sf_dir, "events")
    left = ev.filter("event_type <> 'signup'").select("user_id", "ts", "event_id")
    right = ev.filter("event_type = 'signup'").select("user_id", "ts", "value", "event_id")
    return relops.asof(left, right, "ts", ["user_id"], "value", "event_id").select("event_id", "value")


@query(f"""
WITH {_DAILY}, p AS (SELECT series, (min(step) + max(step)) // 2 AS goal FROM t GROUP BY series), r AS (SELECT t.series, goal, step, v, row_number() OVER (PARTITION BY t.series ORDER BY abs(step - goal), step) AS n FROM t JOIN p USING (series))
SELECT series, goal, step AS nearest_step, round(v, 4) AS v FROM r WHERE n = 1
""")
def nearest_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir)
    points = d.groupBy("series").agg(F.floor((F.min("step") + F.max("step")) / 2).alias("goal"))
    return relops.nearest(d, points, ["series"], "step", "goal", "v").withColumn("v", F.round("v", 4))



@query("SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type = 'view') AS last_view, arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS last_click FROM events GROUP BY user_id")
def last_known_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last known value of two event types; null where there was none."""
    last = lambda k: F.max_by(F.when(F.col("event_type") == k, F.col("value")), F.when(F.col("event_type") == k, F.col("event_id"))).alias(f"last_{k}")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last("view"), last("click"))


@query("""
WITH d AS (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d)
SELECT user_id, min(day) AS start, max(day) AS "end", count(*) AS length FROM g GROUP BY user_id, g
""")
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return metrics.gaps_islands(table(spark, sf_dir, "events").select("user_id", day.alias("day")), ["user_id"], "day")


@query("""
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT user_id, event_id, CAST(w AS BIGINT) AS window_id, CAST(i - 3 * w AS BIGINT) AS pos FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((i - 4) / 3.0) AS BIGINT)), i // 3 + 1)) AS w FROM n)
""")
def sliding_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.sliding_buffer(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id")
    return out.select("user_id", "event_id", F.col("window_id").cast("long").alias("window_id"), F.col("pos").cast("long").alias("pos"))


@query("SELECT event_id, (n - 1) // 8 AS batch, (n - 1) % 8 AS pos FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.batches(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], "event_id", 8)
    return out.select("event_id", "batch", F.col("pos").cast("long").alias("pos"))


@query("""
WITH p AS (SELECT event_type, event_id, CAST(props->>'$.k' AS DOUBLE) AS v FROM events)
SELECT event_type, 'k' AS channel, count(v) AS n, count(*) FILTER (WHERE v <> 0) AS nonzero, min(v) AS min, max(v) AS max, arg_max(v, event_id) AS final_value FROM p GROUP BY event_type
""")
def json_channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each key of a JSON map of metrics."""
    maps = table(spark, sf_dir, "events").select("event_type", "event_id", F.from_json("props", "map<string,double>").alias("m"))
    # keys as a tracker writes them, a/b/<name>, and back
    wide = maps.withColumn("m", F.transform_keys("m", lambda k, v: F.concat(F.lit("env/all/ledger/"), k)))
    long = wide.select("event_type", "event_id", F.explode(metrics.ledger_suffix(F.col("m"), "ledger/")).alias("channel", "v"))
    return metrics.channel_stats(long, ["event_type"], "channel", "v", "event_id")


@query(f"""
WITH {_DAILY}, n AS (SELECT series, step, v, row_number() OVER (PARTITION BY series ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY series) - 1 AS m FROM t)
SELECT series, step, round(v, 4) AS v FROM n WHERE i IN (0, m * 1 // 4, m * 2 // 4, m * 3 // 4, m)
""")
def samples_at_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quarters(_daily(spark, sf_dir), ["series"], "step").select("series", "step", F.round("v", 4).alias("v"))


@query(f"WITH {_DAILY}, k AS (SELECT *, step // 7 AS epoch, row_number() OVER (PARTITION BY step // 7 ORDER BY series) AS n FROM t WHERE step % 7 = 0) SELECT series, step, epoch FROM k WHERE n = 1")
def epoch_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.epoch_checkpoints(_daily(spark, sf_dir), "step", 7, "series").select("series", "step", "epoch")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'view' ORDER BY event_id DESC LIMIT 1")
def select_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.select_checkpoint(table(spark, sf_dir, "events"), "event_id", "event_type", "view").select("event_id", "event_type")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 5")
def examples_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("event_id")
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).filter("n <= 5").select("event_id", "event_type")


@query(f"""
WITH {_DAILY}, l AS (SELECT series, CAST(step AS DOUBLE) AS x0, total AS y0, CAST(lead(step) OVER w AS DOUBLE) AS x1, lead(total) OVER w AS y1 FROM t WINDOW w AS (PARTITION BY series ORDER BY step)),
g AS (SELECT series, CAST(i AS BIGINT) AS point, min(step) + (max(step) - min(step))::DOUBLE / 99 * i AS x FROM t, (SELECT unnest(range(0, 100)) AS i) GROUP BY series, i)
SELECT g.series, point, round(x, 6) AS step, round(CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (x - x0) * (y1 - y0) / (x1 - x0) END, 3) AS total
FROM g ASOF JOIN l ON g.series = l.series AND g.x + 1e-7 >= l.x0
""")
def interp_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series resampled to 100 even points."""
    out = metrics.interpolate(_daily(spark, sf_dir), ["series"], "step", "total", 100)
    return out.select("series", F.col("point").cast("long").alias("point"), F.round("step", 6).alias("step"), F.round("total", 3).alias("total"))


@query("""
WITH s AS (SELECT conv_id, count(*) AS length, round(sum(length(text)) / 1000.0::DOUBLE, 6) AS total, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id)
SELECT conv_id, length, total, round(total / length, 6) AS mean, roles FROM s
""")
def episode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("length"), F.round(F.sum(F.length("text")) / 1000.0, 6).alias("total"), F.countDistinct("role").alias("roles"))
    return out.select("conv_id", "length", "total", F.round(F.col("total") / F.col("length"), 6).alias("mean"), "roles")


@query("SELECT event_type, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n, date_diff('second', arg_min(ts, event_id), arg_max(ts, event_id)) AS seconds FROM events GROUP BY event_type")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages by first and last row, with their duration."""
    sec = lambda c: F.unix_timestamp(F.date_trunc("second", c.cast("timestamp")))
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n"), F.min_by("ts", "event_id").alias("a"), F.max_by("ts", "event_id").alias("z"))
    return out.select("event_type", "first_id", "last_id", "n", (sec(F.col("z")) - sec(F.col("a"))).alias("seconds"))
