"""Queries of joins, splits, deduplication, graphs and grouped counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.udfs import canonical_key
from textloom.operators import graph, metrics, relops, splits, verdicts
from textloom.plans.registry import query
from textloom.session import table


@query("""
SELECT o_orderkey, o_custkey, coalesce(list_sort(list(c_custkey) FILTER (WHERE c_custkey IS NOT NULL)), []) AS dst_ids, count(c_custkey) > 0 AS resolved
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey GROUP BY o_orderkey, o_custkey
""")
def resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, cust = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return relops.resolve_refs(orders.select("o_orderkey", "o_custkey"), "o_custkey", cust, "c_custkey", "c_custkey")


_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM"


@query(f"""
WITH d AS ({_WORDS} documents), b AS ({_WORDS} benchmark), k AS (SELECT w, replace(w, 'n', '') AS l FROM b)
SELECT CASE WHEN w IN (SELECT w FROM k) THEN 'exact' WHEN replace(w, 'n', '') IN (SELECT l FROM k) THEN 'loose' ELSE 'none' END AS witness, count(*) AS n FROM d GROUP BY 1
""")
def benchmark_near_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that the benchmark has, or has but for the letter n."""
    words = lambda t: table(spark, sf_dir, t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1)).alias("w")).distinct()
    near = lambda d: d.withColumn("l", F.translate("w", "n", ""))
    out = relops.witnesses(near(words("documents")), "w", "l", near(words("benchmark")), "w", "l")
    return out.groupBy(F.coalesce("witness", F.lit("none")).alias("witness")).agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, c_name, count(o_orderkey) AS attested FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL
""")
def attest_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relops.attest_count(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS n_p_type, count(DISTINCT p_size) AS n_p_size FROM part GROUP BY p_brand")
def self_homographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relops.homographs(table(spark, sf_dir, "part"), "p_brand", ["p_type", "p_size"])


@query("""
SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def two_hop_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to nation to region; both lookup sides have a fixed, tiny size."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    hops = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return table(spark, sf_dir, "customer").join(hops, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("""
WITH k AS (SELECT lower(n_name) AS w, left(lower(n_name), 1) AS l, n_name FROM nation), a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'zz' ELSE lower(n_name) END AS w FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT l, array_to_string(list_slice(list_sort(list(DISTINCT w)), 1, 3), ', ') AS near FROM k GROUP BY l), e AS (SELECT w, array_to_string(list_sort(list(n_name)), ' | ') AS texts FROM k GROUP BY w)
SELECT c_custkey, coalesce(texts, 'near: ' || near, 'no entry') AS found, texts IS NOT NULL AS hit FROM a LEFT JOIN e ON a.w = e.w LEFT JOIN n ON left(a.w, 1) = n.l
""")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lower("n_name").alias("w"), F.left(F.lower("n_name"), F.lit(1)).alias("l"))
    asked = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    word = F.when(F.col("c_custkey") % 3 == 0, F.lit("zz")).otherwise(F.col("w"))
    asked = asked.select("c_custkey", word.alias("ask"), F.left(word, F.lit(1)).alias("ask_l"))
    return relops.lookup(asked, "ask", "ask_l", nation, "w", "l", "n_name").select("c_custkey", "found", "hit")


@query("""
WITH o AS (SELECT c_nationkey, min(c_mktsegment) AS m, count(DISTINCT c_mktsegment) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
SELECT n_nationkey, CASE WHEN n = 1 THEN m END AS c_mktsegment FROM nation LEFT JOIN o ON n_nationkey = c_nationkey
""")
def gold_repair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9000")
    return relops.unique_match(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", rich, "c_nationkey", "c_mktsegment")


_HELD = "sha256('42|' || CAST(doc_id AS VARCHAR))"
_STRATA = f"""strata AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY lang, source ORDER BY {_HELD}, doc_id) <= CAST(round_even(count(*) OVER (PARTITION BY lang, source) * 0.1::DOUBLE, 0) AS BIGINT) THEN 'heldout' ELSE 'train' END AS split
  FROM documents
)"""


@query(f"WITH {_STRATA} SELECT doc_id, lang, source, split FROM strata")
def doc_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id")


@query(f"WITH {_STRATA}, h AS (SELECT doc_id, text, lang FROM strata WHERE split = 'heldout') SELECT s.doc_id, s.lang FROM strata s WHERE split = 'train' AND s.doc_id NOT IN (SELECT doc_id FROM h) AND trim(s.text) NOT IN (SELECT trim(text) FROM h)")
def anti_eval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training documents that equal no held-out one by id, by text and language, or by text."""
    both = splits.stratified_split(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id")
    train, held = both.filter("split = 'train'"), both.filter("split = 'heldout'")
    return relops.anti_overlap(train, held, [["doc_id"], ["text", "lang"], ["text"]]).select("doc_id", "lang")


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS n, count(*) OVER () AS total FROM documents)
SELECT doc_id, CASE WHEN n <= floor(total * 0.95::DOUBLE + 1e-9) THEN 'train' ELSE 'valid' END AS split FROM r
""")
def doc_shuffle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.cut_by_hash(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.95)


@query("""
SELECT doc_id, lang FROM documents ORDER BY sha256('42|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT (SELECT greatest(1, CAST(round_even(count(*) * 0.01::DOUBLE, 0) AS BIGINT)) FROM documents)
""")
def spot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.spot_check(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@query("""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) WHERE n <= 25
""")
def limit_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.limit_per_group(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 25)


@query("""
SELECT doc_id, tier FROM (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 0 WHEN l.doc_id IS NULL THEN 2 ELSE 1 END AS tier FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id))
ORDER BY tier, sha256('42|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 300
""")
def tiered_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    df = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    df = df.withColumn("tier", F.when(F.col("quality") == 1, 0).when(F.col("quality").isNull(), 2).otherwise(1))
    return splits.tiered_sample(df.select("doc_id", "tier"), "tier", "doc_id", 300)


@query("""
SELECT doc_id, quality FROM (SELECT d.doc_id, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY sha256('42|' || CAST(d.doc_id AS VARCHAR)), d.doc_id) AS n FROM documents d JOIN labels USING (doc_id)) WHERE n <= 5
""")
def balanced_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return splits.balanced_examples(df, ["lang"], "quality", "doc_id", 5).select("doc_id", "quality")


@query("SELECT quality, count(*) * CASE WHEN quality = 1 THEN 2 ELSE 1 END AS n FROM labels GROUP BY quality")
def upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.upsample(table(spark, sf_dir, "labels"), F.col("quality") == 1).groupBy("quality").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part ORDER BY sha256('42|' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 1")
def random_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_choice(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


@query("SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5) UNION SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5)")
def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.head_tail(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("""
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(text), '[^a-z]', '', 'g') ORDER BY doc_id) AS n FROM documents) WHERE n = 1
""")
def doc_canon_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each key of ASCII letters."""
    df = table(spark, sf_dir, "documents").withColumn("key", F.sha2(F.regexp_replace(F.lower("text"), "[^a-z]", ""), 256))
    return relops.dedup_first(df.select("doc_id", "lang", "key"), ["key"], ["doc_id"]).drop("key")


@query("""
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(strip_accents(lower(text)), '[^\\p{L}]', '', 'g') ORDER BY doc_id) AS n FROM documents) WHERE n = 1
""")
def doc_unicode_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by decomposed letters of any script."""
    df = table(spark, sf_dir, "documents").withColumn("key", F.sha2(canonical_key("text"), 256))
    return relops.dedup_first(df.select("doc_id", "lang", "key"), ["key"], ["doc_id"]).drop("key")


@query("""
WITH e AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer), base AS (SELECT * FROM e WHERE c_custkey % 2 = 0), extra AS (SELECT * FROM e WHERE c_custkey % 3 = 0)
SELECT * FROM base UNION ALL
SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS n FROM extra) x
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.c_mktsegment = x.c_mktsegment AND b.c_nationkey = x.c_nationkey)
""")
def append_if_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return relops.append_if_new(e.filter("c_custkey % 2 = 0"), e.filter("c_custkey % 3 = 0"), ["c_mktsegment", "c_nationkey"], ["c_custkey"])


@query("""
WITH r AS (
  SELECT c_nationkey AS k, c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE '' END AS name, round(c_acctbal / 1000, 0) AS conf, CASE WHEN c_custkey % 3 = 0 THEN [c_mktsegment] ELSE [] END AS ex,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer
), t AS (SELECT *, n = 1 OR conf > max(conf) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rec FROM r),
l AS (SELECT k, coalesce(max(n) FILTER (WHERE rec AND len(ex) > 0), 1) AS last FROM t GROUP BY k),
x AS (SELECT k, u, min(n) AS n FROM (SELECT t.k, unnest(ex) AS u, n FROM t JOIN l ON t.k = l.k AND t.n >= l.last) GROUP BY k, u)
SELECT t.k AS nation, min(id) AS id, arg_max(name, n) FILTER (WHERE rec AND name <> '') AS name, CASE WHEN max(conf) > arg_min(conf, n) THEN max(conf) ELSE arg_min(conf, n) END AS conf,
       coalesce((SELECT list(u ORDER BY n) FROM x WHERE x.k = t.k), []) AS examples, list(id ORDER BY n) FILTER (WHERE n > 1) AS absorbed
FROM t GROUP BY t.k
""")
def dedup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).otherwise("").alias("name"), F.round(F.col("c_acctbal") / 1000, 0).alias("conf"),
        F.when(F.col("c_custkey") % 3 == 0, F.array("c_mktsegment")).otherwise(none).alias("examples"), none.alias("aliases"), F.col("c_custkey").alias("at"),
    )
    out = relops.dedup_merge(rows, "nation", "at", "conf", ["name"], "id", "aliases", "examples")
    return out.select("nation", "id", "name", "conf", "examples", "absorbed")


_EDGES = """e AS (SELECT 2 * o_orderkey + 1 AS a, 2 * o_custkey AS b FROM orders
  UNION ALL SELECT 2 * c_custkey, 2 * min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) FROM customer)"""


@query(f"""
WITH RECURSIVE {_EDGES}, s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), reach(v, r) AS (SELECT a, a FROM s UNION SELECT s.b, r FROM reach JOIN s ON s.a = v),
f AS (SELECT v AS node, min(r) AS family FROM reach GROUP BY v), h AS (SELECT *, sha256(CAST(family AS VARCHAR)) AS h FROM f)
SELECT node, family, count(*) OVER (PARTITION BY family) AS family_size,
       CASE WHEN (6 * list_sum(list_transform(string_split(h[1:63], ''), lambda c: strpos('0123456789abcdef', c) - 1)) + strpos('0123456789abcdef', h[64]) - 1) % 10 = 0 THEN 'heldout' ELSE 'train' END AS split
FROM h
""")
def family_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of all orders and customers, where the customers of a nation and segment belong together, and the split that keeps them whole."""
    customers = table(spark, sf_dir, "customer")
    first = customers.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("first"))
    near = customers.join(first, ["c_nationkey", "c_mktsegment"]).select((2 * F.col("c_custkey")).alias("src"), (2 * F.col("first")).alias("dst"))
    return graph.families(table(spark, sf_dir, "orders").select((2 * F.col("o_orderkey") + 1).alias("src"), (2 * F.col("o_custkey")).alias("dst")).unionAll(near))


@query("""
WITH h AS (SELECT c_custkey, sha256(c_name) AS h FROM customer)
SELECT c_custkey, CAST((6 * list_sum(list_transform(string_split(h[1:63], ''), lambda c: strpos('0123456789abcdef', c) - 1)) + strpos('0123456789abcdef', h[64]) - 1) % 10 AS BIGINT) AS bucket FROM h
""")
def sha_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.sha_bucket(F.col("c_name")).cast("long").alias("bucket"))


@query("SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def count_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def count_by_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(DISTINCT p_partkey) AS parts, count(*) AS items, round(sum(l_quantity), 4) AS quantity, round(avg(l_discount), 6) AS discount FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return df.groupBy("p_brand").agg(F.countDistinct("p_partkey").alias("parts"), F.count("*").alias("items"), F.round(F.sum("l_quantity"), 4).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("""
WITH d AS (SELECT d.*, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))
SELECT count(*) AS total, count(*) FILTER (WHERE NOT regexp_matches(text, '[áéíóúñäöüßçèêà]')) AS improbable, count(*) FILTER (WHERE lower(trim(text)) = lower(trim(source)) AND trim(text) <> '') AS identical,
       count(*) FILTER (WHERE trim(text) = '' OR trim(source) = '') AS missing, round(count(*) FILTER (WHERE NOT regexp_matches(text, '[áéíóúñäöüßçèêà]')) / greatest(count(*), 1)::DOUBLE, 6) AS improbable_ratio FROM d
""")
def guardrail_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verdicts.guardrail_counts(docs, "text", "source", F.col("text").rlike("[áéíóúñäöüßçèêà]")).withColumn("improbable_ratio", F.round("improbable_ratio", 6))


@query(f"WITH {_STRATA} SELECT lang FROM strata WHERE split = 'train' INTERSECT SELECT lang FROM strata WHERE split = 'heldout'")
def overlap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = splits.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id")
    return both.filter("split = 'train'").select("lang").intersect(both.filter("split = 'heldout'").select("lang"))


@query("SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def resume_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that still have no returned item: what is left to do."""
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return relops.resume(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE lower(coalesce(nullif(source, ''), lang, 'x')) IN ('src1', 'src2')")
def filter_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.sources.readers import facets

    return facets(table(spark, sf_dir, "documents"), "source", "lang", "x", ["SRC1", "src2"]).select("doc_id", "lang")


@query("""
SELECT a.conv_id AS a, b.conv_id AS b, a.turn FROM conversations a JOIN conversations b ON a.turn = b.turn AND a.conv_id + 1 = b.conv_id WHERE a.role = b.role
""")
def trace_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    a = conv.select(F.col("conv_id").alias("a"), "turn", "role", (F.col("conv_id") + 1).alias("b"))
    return a.join(conv.select(F.col("conv_id").alias("b"), "turn", "role"), ["b", "turn", "role"]).select("a", "b", "turn")


@query("""
SELECT mktsegment, metric, round(value, 6) AS value FROM (
  SELECT c_mktsegment AS mktsegment, unnest(['mean', 'high']) AS metric, unnest([avg(c_acctbal), max(c_acctbal)]) AS value FROM customer GROUP BY 1)
""")
def flatten_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("mktsegment")).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"), F.max("c_acctbal").alias("high"))
    return metrics.flatten_summary(df, ["mktsegment"], ["n", "mean", "high"]).withColumn("value", F.round("value", 6))
