"""Queries of text helpers, checks and plain relational calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import metrics, relops, verdicts
from textloom.plans.registry import query
from textloom.session import stored, table

_FOLD_FROM, _FOLD_TO = "".join(X.FOLDED), "".join(X.FOLDED.values())


@query("""
SELECT c_custkey, '[{"a": ' || c_custkey || '}]' AS fenced, '[1, ' || c_custkey || ']' AS slice, CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 END::DOUBLE AS flag,
  CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 0.5 END::DOUBLE AS delay, [CAST(c_custkey AS BIGINT), 12, 0] AS version FROM customer
""")
def parse_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in replies, waiting times in error texts, and versions."""
    k, c = F.col("c_custkey"), F.col("c_custkey").cast("string")
    body = F.concat(F.lit('[{"a": '), c, F.lit("}]"))
    fenced = F.when(k % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone"))).otherwise(F.concat(F.lit("\n "), body, F.lit(" \n")))
    listed = F.concat(F.lit("here ["), F.lit("1, "), c, F.lit("] and so on"))
    flag = F.when(k % 4 == 0, 'so {"ok": true}').when(k % 4 == 1, '{"ok": "no"}').when(k % 4 == 2, '{"ok": "Correct"}').otherwise("none")
    wait = F.when(k % 2 == 0, F.concat(F.lit("Please Retry in "), c, F.lit(".5s."))).otherwise("failed")
    version = F.concat(c, F.lit(".12.0rc1"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.fenced_json(fenced).alias("fenced"), X.json_array_slice(listed).alias("slice"), X.json_flag(flag, "ok").alias("flag"), X.retry_delay(wait).alias("delay"), X.version_tuple(version).cast("array<bigint>").alias("version"))


@query(f"""
WITH d AS (SELECT doc_id, text, regexp_replace(text, '\\s+', ' ', 'g') AS line FROM documents), s AS (SELECT *, trim(trim(line), ' `"*') AS span FROM d)
SELECT doc_id, CASE WHEN length(span) > 280 THEN rtrim(left(span, 279)) || '…' ELSE span END AS shown, translate(text, '{_FOLD_FROM}', '{_FOLD_TO}') AS folded, regexp_matches(text, '[áâäéíóúǫȟŋṡšžčḣĺǧṫų]') OR doc_id % 3 = 0 AS probable FROM s
""")
def shown_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as they are shown, letters without their marks, and whether the spelling may be right; every third text gets a loose mark."""
    t = F.col("text")
    said = F.concat(F.lit("ANSWER: "), X.collapse(t))
    marked = F.concat(t, F.when(F.col("doc_id") % 3 == 0, "x̣").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_answer_display(said).alias("shown"), X.fold_glyphs(t).alias("folded"), X.orthography_probable(marked).alias("probable"))


@query("""
SELECT p_partkey, list_filter([CASE WHEN p_size % 7 = 0 THEN 'Missing rule_name' END, CASE WHEN p_size % 5 = 0 THEN 'Missing pattern specification' END, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'Testable rule must have examples' END,
  CASE WHEN p_size % 2 = 0 THEN 'Warning: No verification criteria specified' END], lambda x: x IS NOT NULL) AS issues, p_size % 7 <> 0 AND p_size % 5 <> 0 AND p_size % 2 <> 0 AS is_valid FROM part
""")
def validate_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, none = F.col("p_size"), F.array().cast("array<string>")
    rules = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("r"), "p_partkey").alias("rule_id"), F.when(n % 7 != 0, F.col("p_name")).otherwise(" ").alias("rule_name"), F.col("p_type").alias("description"), F.when(n % 5 != 0, F.lit("-ku")).alias("pattern"),
        (n % 2 == 0).alias("testable"), F.when(n % 3 != 0, F.array("p_name")).otherwise(none).alias("transformations"), F.lit(None).cast("array<string>").alias("interlinear_examples"), none.alias("verification_criteria"),
    )
    return verdicts.validate_rule(rules).select("p_partkey", "issues", "is_valid")


@query("""
WITH p AS (SELECT p_partkey, p_name AS a, CASE WHEN p_size % 4 = 0 THEN upper(p_name) || ' ' WHEN p_size % 4 = 1 THEN ' ' ELSE p_brand END AS b FROM part), c AS (SELECT count(*) AS total, count(*) FILTER (WHERE NOT contains(a, 'e')) AS improbable, count(*) FILTER (WHERE lower(trim(a)) = lower(trim(b)) AND trim(a) <> '') AS identical, count(*) FILTER (WHERE trim(a) = '' OR trim(b) = '') AS missing FROM p)
SELECT *, round(improbable / greatest(total, 1)::DOUBLE, 6) AS improbable_ratio FROM c
""")
def guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.guardrail_counts(_pairs(spark, sf_dir), "a", "b", F.contains("a", F.lit("e"))).withColumn("improbable_ratio", F.round("improbable_ratio", 6))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("a"), F.when(n % 4 == 0, F.concat(F.upper("p_name"), F.lit(" "))).when(n % 4 == 1, " ").otherwise(F.col("p_brand")).alias("b"), (n % 4).alias("k"))


@query("""
WITH p AS (SELECT p_name AS a, p_size % 4 AS k FROM part), s AS (SELECT * FROM p WHERE NOT contains(a, 'o') ORDER BY a LIMIT 5), i AS (SELECT * FROM p WHERE k = 0 ORDER BY a LIMIT 5)
SELECT 'improbable' AS build, printf('%.3f%%', 100.0 * (SELECT count(*) FROM p WHERE NOT contains(a, 'o')) / (SELECT count(*) FROM p)) || ' of entries look improbable: ' || (SELECT string_agg(a, ', ' ORDER BY a) FROM s) AS said
UNION ALL SELECT 'identical', (SELECT count(*) FROM p WHERE k = 0) || ' entries are identical in both languages: ' || (SELECT string_agg(a, ', ' ORDER BY a) FROM i)
UNION ALL SELECT 'missing', (SELECT count(*) FROM p WHERE k = 1) || ' entries lack a text' UNION ALL SELECT 'sound', (SELECT count(*) FROM p WHERE k > 1) || ' entries'
""")
def guardrail_raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the guardrail says of four builds of the pairs: with an unlikely letter, identical texts, missing texts, and none of these."""
    pairs, yes, said = _pairs(spark, sf_dir), F.lit(True), []
    builds = {"improbable": (pairs, F.contains("a", F.lit("o"))), "identical": (pairs.filter("k <> 1"), yes), "missing": (pairs.filter("k <> 0"), yes), "sound": (pairs.filter("k > 1"), yes)}
    for name, (rows, probable) in builds.items():
        try:
            got = verdicts.guardrail(rows, "a", "b", probable, 0.1, stored)
            said.append((name, f"{got['total']} entries"))
        except ValueError as e:
            said.append((name, str(e)))
    return spark.createDataFrame(said, "build string, said string")


@query("SELECT unnest(['missing: loss', 'zero: nothing']) AS finding UNION ALL SELECT 'picked: l_tax'")
def audit_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels that a run must have, and the first of some columns that has a value."""
    rows = table(spark, sf_dir, "lineitem").withColumn("nothing", F.lit(0.0)).withColumn("empty", F.lit(None).cast("double"))
    found = metrics.audit(rows, ["l_quantity", "loss", "nothing"]) + [f"picked: {metrics.column_pick(rows, ['reward', 'empty', 'l_tax'])}"]
    return spark.createDataFrame([(x,) for x in found], "finding string")


@query("SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS step, CAST(floor(user_id * 3 * value / 8 / 3600.0::DOUBLE * 1000 + 0.0001) AS BIGINT) AS hours FROM events")
def ensure_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps for rows that have none, and the thousandths of hours of a run by its size."""
    rows = metrics.ensure_step(table(spark, sf_dir, "events"), ["ts", "event_id"], ["event_type"])
    hours = metrics.training_time(F.col("user_id"), F.lit(3), F.col("value"), F.lit(8))
    return metrics.ensure_step(rows, [], []).select("event_type", "event_id", F.col("step").cast("long").alias("step"), F.floor(hours * 1000 + 0.0001).alias("hours"))


@query("""
SELECT a.c_custkey, b.c_custkey AS other FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) a JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) AS n FROM customer) b USING (n)
""")
def pair_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers beside the same customers in reverse, by position."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    both = relops.pair_zip(c, c.withColumn("back", -F.col("c_custkey")), "c_custkey", "back")
    return both.select("a.c_custkey", F.col("b.c_custkey").alias("other"))


@query("""
SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), arg_max(text, turn)) AS said FROM conversations GROUP BY conv_id
""")
def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answer of each conversation."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    convs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(m.alias("m"))
    return convs.select("conv_id", relops.last_assistant(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("said"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def count_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12")
def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(12)


@query("SELECT brand, n, CAST(row_number() OVER (ORDER BY n DESC, brand) AS BIGINT) AS place FROM (SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1)")
def sort_by_count_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by how many parts they have; the place shows the order."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))
    ranked = relops.numbered(counts.withColumn("o", F.struct((-F.col("n")).alias("n"), "brand")), "o", "row")
    return ranked.select("row.brand", "row.n", F.col("pos").alias("place"))


@query("SELECT 's' AS side, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'c', c_custkey, c_name FROM customer")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda t, p: table(spark, sf_dir, t).select(F.lit(p).alias("side"), F.col(f"{p}_{'supp' if p == 's' else 'cust'}key").alias("id"), F.col(f"{p}_name").alias("name"))
    return side("supplier", "s").unionByName(side("customer", "c"))


@query("SELECT DISTINCT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def except_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_nationkey").subtract(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation)) = 0 AS nations, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AS customers")
def subset_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all suppliers' nations are nations, and whether all customers have orders."""

    def within(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        return a.join(b, a[0] == b[0], "left_anti").agg((F.count("*") == 0).alias(name))

    pick = lambda t, c: table(spark, sf_dir, t).select(c)
    nations = within(pick("supplier", "s_nationkey"), pick("nation", "n_nationkey"), "nations")
    return nations.join(within(pick("customer", "c_custkey"), pick("orders", "o_custkey"), "customers"), F.lit(True))  # one row on each side


@query("SELECT conv_id, list(role ORDER BY t) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct roles of a conversation, in the order in which they come up."""
    firsts = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    return firsts.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "role"))), lambda x: x["role"]).alias("roles"))


@query("SELECT l_returnflag, true AS near FROM lineitem GROUP BY l_returnflag")
def agg_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the estimated number of distinct orders is within a tenth of the exact one."""
    # distinct first: beside a distinct count, every order would have a sketch of its own
    orders = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey").distinct()
    both = orders.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("a"), F.count("l_orderkey").alias("n"))
    return both.select("l_returnflag", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))
