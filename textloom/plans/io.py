"""Queries of sources and sinks: tables are written to the shared folder and read back; and of filters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import filters, relops, taskgen
from textloom.plans import expansion
from textloom.plans.registry import query
from textloom.session import keep, shared_dir, stored, table
from textloom.sources import readers, sinks


def _place(spark: SparkSession) -> str:
    return keep(f"{shared_dir(spark)}/io-{uuid.uuid4().hex}")


def _qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pair_id"), F.col("c_name").alias("question"), F.col("c_mktsegment").alias("answer"))


_QA_SQL = "SELECT c_custkey AS pair_id, c_name AS question, c_mktsegment AS answer FROM customer"


@query(_QA_SQL)
def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark)
    sinks.jsonl(_qa(spark, sf_dir), at)
    return readers.jsonl_strict(spark, at, "pair_id long, question string, answer string")


@query(_QA_SQL + " WHERE c_custkey % 3 <> 0")
def scan_jsonl_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line is broken; every second row has its question under another name."""
    at = _place(spark)
    line = F.when(F.col("pair_id") % 3 == 0, F.lit("{broken")).when(F.col("pair_id") % 2 == 0, F.to_json(F.struct("pair_id", F.col("question").alias("prompt"), "answer"))).otherwise(F.to_json(F.struct("pair_id", "question", "answer")))
    _qa(spark, sf_dir).select(line.alias("value")).write.text(at, compression="gzip")
    got = readers.jsonl_tolerant(spark, at, "pair_id long, question string, prompt string, answer string", {"question": ["prompt"]}, ("question", "answer"))
    return got.select("pair_id", "question", "answer")


@query("""
SELECT 'scan' AS step, count(*) AS rows, count(*) FILTER (WHERE c_custkey % 3 = 0) AS rejected, count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_custkey % 5 = 0) AS incomplete FROM customer
UNION ALL SELECT 'filter', count(*), count(*) FILTER (WHERE c_custkey % 7 = 0 OR c_acctbal < 0), 0 FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0
""")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a tolerant scan skips and rows that a filter of confidence rejects, counted while the kept rows are written once."""
    at, scan = _place(spark), Observation(f"scan-{uuid.uuid4().hex}")
    key = F.col("c_custkey")
    row = F.struct(key.alias("pair_id"), F.when(key % 5 == 0, " ").otherwise(F.col("c_name")).alias("question"), F.when(key % 7 != 0, F.col("c_acctbal")).alias("confidence"))
    table(spark, sf_dir, "customer").select(F.when(key % 3 == 0, F.lit("{broken")).otherwise(F.to_json(row)).alias("value")).write.text(at)
    read = readers.jsonl_tolerant(spark, at, "pair_id long, question string, confidence double", required=("question",), watch=scan)
    sure, held = filters.watched(read, F.col("confidence").isNotNull() & filters.confidence("confidence", 0.0))
    stored(sure)
    a, b = scan.get, held.get
    return spark.createDataFrame([("scan", a["lines"], a["malformed"], a["incomplete"]), ("filter", b["total"], b["rejected"], 0)], "step string, rows long, rejected long, incomplete long")


@query(_QA_SQL)
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark)
    sinks.csv(_qa(spark, sf_dir), at, single=False)
    return readers.metrics_csv(spark, at, "pair_id long, question string, answer string")


@query("SELECT c_mktsegment AS answer, count(*) AS n FROM customer GROUP BY 1")
def sink_partition_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by value and counted by folder."""
    at = _place(spark)
    sinks.by_value(_qa(spark, sf_dir), at, ["answer"], "parquet")
    return readers.parquet(spark, at).groupBy("answer").agg(F.count("*").alias("n"))


def _write_pages(spark: SparkSession, sf_dir: str) -> str:
    """Parts as one JSON document a page, with a byte-order mark, in folders named by page."""
    at = _place(spark)
    entry = F.struct(F.col("p_name").alias("headword"), F.when(F.col("p_size") % 2 == 0, F.format_string("id%d", "p_partkey")).alias("entry_id"))
    pages = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 40).alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))), lambda x: x["e"]).alias("entries"))
    meta = F.struct(F.col("page").cast("int").alias("page_number"), F.concat(F.lit("i"), "page").alias("image_path"))
    doc = F.concat(F.lit("\ufeff"), F.to_json(F.struct("entries", meta.alias("metadata"))))
    pages.select(doc.alias("value"), F.concat(F.lit("page_"), "page").alias("name")).repartition("name").write.partitionBy("name").text(at)
    return at


@query("SELECT p_partkey % 40 AS page, p_name AS headword FROM part WHERE trim(p_name) <> ''")
def scan_page_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.page_docs(spark, _write_pages(spark, sf_dir)).select(F.col("page").cast("long").alias("page"), "headword")


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 40 AS page, p_name, p_size, row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS n FROM part)
SELECT page AS meta_page, 'i' || page AS meta_image, CASE WHEN p_size % 2 = 0 THEN 'id' || p_partkey ELSE printf('page_%d_entry_%03d', page, n) END AS entry_id, p_name AS headword FROM p
""")
def scan_page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readers.page_meta(spark, _write_pages(spark, sf_dir))
    return out.select(F.col("meta_page").cast("long").alias("meta_page"), "meta_image", "entry_id", "headword")


@query("SELECT 'page_' || (p_partkey % 40) AS name, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def scan_bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that begin with a byte-order mark, and how many entries each has."""
    docs = readers.without_bom(spark, _write_pages(spark, sf_dir), "entries array<struct<headword:string>>")
    return docs.select(F.regexp_extract("path", r"name=(page_\d+)", 1).alias("name"), F.size("doc.entries").cast("long").alias("n"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
def scan_lfs_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a nation, of which every other one is a stub."""
    at = _place(spark)
    body = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit(readers.STUB), F.lit("v1\noid sha256:0")))
    table(spark, sf_dir, "nation").select(body.alias("value"), "n_nationkey").repartition("n_nationkey").write.partitionBy("n_nationkey").text(at)
    return readers.without_stubs(spark, at).select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"))


@query("SELECT CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS rule_index, 'r' || n_nationkey AS rule_id, n_name AS rule_name, 'syntax' AS rule_type FROM nation")
def scan_rules_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of rules for each region."""
    at = _place(spark)
    rule = F.struct("n_nationkey", F.concat(F.lit("r"), "n_nationkey").alias("rule_id"), F.col("n_name").alias("rule_name"), F.lit("syntax").alias("rule_type"))
    docs = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    docs.select(F.to_json(F.struct("rules")).alias("value"), "n_regionkey").repartition("n_regionkey").write.partitionBy("n_regionkey").text(at)
    return readers.rules_json(spark, at).select(F.col("rule_index").cast("long").alias("rule_index"), "rule_id", "rule_name", "rule_type")


@query("SELECT n_nationkey, n_name FROM nation")
def scan_source_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing source, an empty one, and one with rows."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return readers.first_source([lambda: readers.parquet(spark, _place(spark)), lambda: nations.limit(0), lambda: nations])


@query("SELECT n_nationkey, CAST(length(n_name) + 1 AS BIGINT) AS length, sha256(n_name || chr(10)) AS sha256 FROM nation")
def file_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a nation: its length and digest."""
    at = _place(spark)
    table(spark, sf_dir, "nation").select("n_name", "n_nationkey").repartition("n_nationkey").write.partitionBy("n_nationkey").text(at)
    files = readers.fingerprints(spark, f"{at}/*/*.txt")
    return files.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), "length", "sha256")


@query("SELECT '| r_regionkey | r_name | share |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' | ' || printf('%.3f', r_regionkey / 3.0::DOUBLE) || ' |', chr(10) ORDER BY r_regionkey) AS report FROM region")
def sink_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name", (F.col("r_regionkey") / 3.0).alias("share")).orderBy("r_regionkey")
    return spark.createDataFrame([(sinks.markdown(rows),)], "report string")


@query("SELECT o_orderkey, o_orderstatus AS task FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_tasks_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the states asked for, all of which are known."""
    kinds = readers.strict_kinds(["F", "P"], ["F", "O", "P"])
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin(kinds)).select("o_orderkey", F.col("o_orderstatus").alias("task"))


@query("SELECT count(*) AS rows, count(DISTINCT c_mktsegment) AS segments, round(sum(c_acctbal), 2) AS balance FROM customer")
def sink_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report(table(spark, sf_dir, "customer"), rows=F.count("*"), segments=F.countDistinct("c_mktsegment"), balance=F.round(F.sum("c_acctbal"), 2))


@query("""
SELECT c_custkey, c_mktsegment FROM customer WHERE CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END >= 5000 AND lower(c_mktsegment) = 'building' AND trim(c_name) <> ''
""")
def filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By confidence (none if negative), language and blank values; no gold is a placeholder."""
    c = table(spark, sf_dir, "customer").withColumn("conf", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    c = filters.by_language(filters.by_confidence(c, "conf", 5000.0), "c_mktsegment", "Building")
    return filters.without_placeholders(filters.nonempty(c, "c_name"), "c_name").select("c_custkey", "c_mktsegment")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 2)")
def filter_options_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("options", F.create_map(F.lit("1"), F.lit("x"), F.lit("2"), F.lit("y"))).withColumn("correct", F.col("n_regionkey").cast("string"))
    return filters.valid_options(n, "n_name", "options", "correct").select("n_nationkey", "n_name")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'noun' WHEN 1 THEN 'verb active' END AS pos FROM part")
def pos_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.when(F.col("p_size") % 3 == 0, "n.").when(F.col("p_size") % 3 == 1, "v. a.").otherwise("?")
    return table(spark, sf_dir, "part").select("p_partkey", filters.pos_expand(short).alias("pos"))


@query("""
WITH h AS (SELECT DISTINCT lower(n_name) AS head FROM nation), i AS (SELECT head, unnest(range(0, length(head) + 1)) AS i FROM h),
f AS (SELECT head, substr(head, 1, i) || 'wa' || substr(head, i + 1) AS form FROM i UNION SELECT head, substr(head, 1, i) || 'o' || substr(head, i + 2) FROM i WHERE substr(head, i + 1, 1) = 'a')
SELECT head, CAST(count(DISTINCT form) AS BIGINT) AS candidates FROM f GROUP BY head
""")
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = spark.sql("SELECT * FROM VALUES ('', 'wa'), ('a', 'o') AS t(old, new)")
    out = filters.candidate_counts(table(spark, sf_dir, "nation").select(F.lower("n_name").alias("head")), "head", edits)
    return out.select("head", F.col("candidates").cast("long").alias("candidates"))


@query("SELECT (SELECT list_sort(list(p_size))[count(*) // 2 + 1] FROM part) AS median, max(p_size) AS highest FROM part")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.upper_median(table(spark, sf_dir, "part"), "p_size")


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents)
SELECT CASE WHEN starts_with(w, 'th') THEN 'start' ELSE 'inside' END AS place, count(*) AS n FROM w WHERE contains(w, 'th') GROUP BY 1
""")
def position_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a given insertion stands in the words that have it."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1)).alias("w")).distinct().filter(F.contains("w", F.lit("th")))
    return w.groupBy(F.when(F.startswith("w", F.lit("th")), "start").otherwise("inside").alias("place")).agg(F.count("*").alias("n"))


@query("""
SELECT printf('lookup_gloss:e%06d', p_partkey) AS id, true AS in_budget, true AS replies_match, true AS target_seen, true AS answered, true AS passed FROM part WHERE p_size > 3 AND p_size % 4 <> 0
""")
def replay_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made lookup conversations, replayed against the dictionary: all pass."""
    lex = expansion.lexicon(spark, sf_dir)
    shown = lex.filter("headword_ok").withColumn("text", taskgen.format_entry(F.col("headword"), F.col("pos"), F.col("gloss"), F.col("derived_from"), F.col("inflected_forms"), F.col("page")))
    shown = relops.dedup_first(shown, ["plain"], ["entry_id"]).select("plain", "text")
    tasks = taskgen.entry_to_tasks(lex).filter(F.startswith("task", F.lit("lookup"))).withColumn("word", F.regexp_extract("prompt", r"Dakota word (\w+)", 1))
    said = taskgen.lookup_dialogue(tasks.select("id", "word", "target_plain", "hops", "prompt", "answer"), shown)
    checked = filters.replay(said.join(tasks.select("id", "target_plain", "answer"), "id"), shown)
    return checked.filter(F.startswith("id", F.lit("lookup_gloss")))


@query("SELECT p_partkey, 'row_' || p_partkey AS id, p_name AS question, p_type AS answer, 'e' || p_partkey AS pair FROM part")
def project_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = filters.record(F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.lit("t"), F.struct(F.col("p_size")))
    t = filters.translation_pair(F.concat(F.lit("e"), "p_partkey"), F.col("p_name"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", r["id"].alias("id"), r["question"].alias("question"), r["answer"].alias("answer"), t["id"].alias("pair"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'x' END AS DOUBLE) AS v, coalesce(CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_type END, 'none') AS first FROM events")
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("x")
    return table(spark, sf_dir, "events").select("event_id", raw.try_cast("double").alias("v"), X.first_truthy(F.when(F.col("event_id") % 2 == 0, " ").otherwise(F.col("event_type")), F.lit("none")).alias("first"))
