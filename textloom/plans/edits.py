"""Queries of edits between words: pairs are neighbouring words of whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import edits
from textloom.plans.registry import query
from textloom.session import stored, table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of a word and the next one, and the split of the first word."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1)
    both = table(spark, sf_dir, "documents").select(words.alias("w")).select(F.explode(F.arrays_zip(F.col("w").alias("head"), F.slice("w", F.lit(2), F.size("w")).alias("form"))).alias("p"))
    both = both.select("p.head", "p.form").filter("form is not null and form <> head").distinct()
    return both.withColumn("split", F.when(X.sha_bucket(F.col("head")) == 0, "heldout").otherwise("train"))


_BUCKET = "(6 * list_sum(list_transform(string_split(sha256({c})[1:63], ''), lambda x: strpos('0123456789abcdef', x) - 1)) + strpos('0123456789abcdef', sha256({c})[64]) - 1) % 10"
_PAIRS = f"""w AS (SELECT regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents), n AS (SELECT w, unnest(range(1, len(w))) AS i FROM w),
d AS (SELECT DISTINCT w[i] AS head, w[i + 1] AS form FROM n WHERE w[i] <> w[i + 1]), h AS (SELECT head, CASE WHEN {_BUCKET.format(c='head')} = 0 THEN 'heldout' ELSE 'train' END AS split FROM (SELECT DISTINCT head FROM d)),
p AS (SELECT head, form, split, CASE WHEN ends_with(form, 'pi') AND length(form) > 3 THEN left(form, length(form) - 2) END AS cut FROM d JOIN h USING (head))"""
_FOLDED = "translate({c}, '" + "".join(X.FOLDED) + "', '" + "".join(X.FOLDED.values()) + "')"


def _edit(name: str, source: str, a: str, b: str) -> str:
    """CTEs that add the edit (old, new) of columns a and b to a relation."""
    return f"""{name}_p AS (SELECT *, list_max(list_filter(range(0, least(length({a}), length({b})) + 1), lambda k: left({a}, k) = left({b}, k))) AS {name}_k FROM {source}),
{name}_s AS (SELECT *, list_max(list_filter(range(0, least(length({a}), length({b})) - {name}_k + 1), lambda k: right({a}, k) = right({b}, k))) AS {name}_r FROM {name}_p),
{name} AS (SELECT *, substr({a}, {name}_k + 1, length({a}) - {name}_k - {name}_r) AS {name}_old, substr({b}, {name}_k + 1, length({b}) - {name}_k - {name}_r) AS {name}_new FROM {name}_s)"""


_MINED = f"""{_PAIRS}, {_edit('e1', 'p', 'head', 'form')}, {_edit('e2', 'e1', 'head', 'cut')},
m AS (SELECT *, CASE WHEN length(e1_old) <= 2 AND length(e1_new) <= 5 THEN {{'old': e1_old, 'new': e1_new}} WHEN cut <> head AND length(e2_old) <= 2 AND length(e2_new) <= 5 THEN {{'old': e2_old, 'new': e2_new}} END AS e FROM e2),
adm AS (SELECT e.old AS old, e.new AS new, count(*) AS n FROM m WHERE e IS NOT NULL AND split = 'train' GROUP BY 1, 2 HAVING count(*) >= 25)"""


@query(f"WITH {_MINED} SELECT old, new, n FROM adm")
def edit_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of the training pairs that occur 25 times or more."""
    return edits.mined_edits(_pairs(spark, sf_dir), "head", "form", counted=F.col("split") == "train")


@query(f"""
WITH {_MINED}, f AS (SELECT head, form, split, cut, e1_old, e1_new, e2_old, e2_new, {_FOLDED.format(c='head')} AS fh, {_FOLDED.format(c='form')} AS ff, {_FOLDED.format(c='cut')} AS fc FROM m), {_edit('l1', 'f', 'fh', 'ff')}, {_edit('l2', 'l1', 'fh', 'fc')},
k AS (SELECT DISTINCT old, new FROM adm), kl AS (SELECT DISTINCT {_FOLDED.format(c='old')} AS old, {_FOLDED.format(c='new')} AS new FROM adm),
r AS (SELECT split, head = form OR coalesce(cut = head, false) OR (e1_old, e1_new) IN (SELECT (old, new) FROM k) OR coalesce((e2_old, e2_new) IN (SELECT (old, new) FROM k), false) AS strict,
  head = form OR coalesce(cut = head, false) OR (l1_old, l1_new) IN (SELECT (old, new) FROM kl) OR coalesce((l2_old, l2_new) IN (SELECT (old, new) FROM kl), false) AS loose FROM l2)
SELECT split, count(*) AS pairs, round(avg(strict::INT), 6) AS coverage, round(avg(loose::INT), 6) AS coverage_loose FROM r GROUP BY split
""")
def coverage_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the pairs of each split that the mined edits explain, with and without marks."""
    pairs = stored(_pairs(spark, sf_dir))
    admitted = stored(edits.mined_edits(pairs, "head", "form", counted=F.col("split") == "train"))
    strict = edits.explained(pairs, "head", "form", admitted).withColumnRenamed("explained", "strict")
    both = edits.explained(strict, "head", "form", admitted, loose=True)
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return both.groupBy("split").agg(F.count("*").alias("pairs"), rate("strict").alias("coverage"), rate("explained").alias("coverage_loose"))


@query(f"""
WITH {_PAIRS}, b AS (SELECT head, form FROM p WHERE starts_with(head, 'e') AND starts_with(form, 'a'))
SELECT (SELECT count(*) FROM b) AS n, (SELECT list(head || '>' || form ORDER BY head, form) FROM (SELECT * FROM b ORDER BY head, form LIMIT 8)) AS examples
""")
def suspect_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that look as if one letter was read as another: how many, and the first eight."""
    out = edits.suspect_pairs(_pairs(spark, sf_dir), "head", "form", ("e", "a"))
    return out.select("n", F.transform("examples", lambda x: F.concat(x["head"], F.lit(">"), x["form"])).alias("examples"))


@query(f"""
WITH {_PAIRS}, {_edit('e1', 'p', 'head', 'form')}, {_edit('e2', 'e1', 'head', 'cut')},
x AS (SELECT CASE WHEN e1_old = '' AND e1_new = 's' THEN e1_k WHEN e2_old = '' AND e2_new = 's' THEN e2_k END AS k, length(head) AS n FROM e2)
SELECT CASE WHEN k = 0 THEN 'prefix' ELSE 'inside the word' END AS place, count(*) AS n FROM x WHERE k IS NOT NULL GROUP BY 1
""")
def insertion_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a given insertion stands in the pairs that it explains."""
    def at(g):
        return F.when((g != "") & edits.within(F.col("head"), g, 0, 1), X.let(X.single_edit(F.col("head"), g), lambda e: F.when((e["old"] == "") & (e["new"] == "s"), e["pos"])))

    pos = F.coalesce(at(F.col("form")), at(edits.without_ending(F.col("form"))))
    found = _pairs(spark, sf_dir).select(pos.alias("pos")).filter("pos is not null")
    return found.groupBy(F.when(F.col("pos") == 0, "prefix").otherwise("inside the word").alias("place")).agg(F.count("*").alias("n"))
