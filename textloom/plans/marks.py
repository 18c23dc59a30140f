"""Queries of marked letters, terms and affixes.

The tables have few marked letters, so each text is given some: every letter of
the lists stands in some rows. The twins spell the lists themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import scores as S
from textloom.functions import text as X
from textloom.plans.registry import query
from textloom.plans.scoring import _answers
from textloom.session import table

_GIVEN = "ćšŋḣṡǧáéíóúķśṅźėčžʼ’âäǫȟĺṫųñöx"


def _letter(key: Column) -> Column:
    """The letter that a row is given."""
    return F.substring(F.lit(_GIVEN), (F.pmod(key, F.lit(len(_GIVEN))) + 1).cast("int"), F.lit(1))


def _given(text: Column, key: Column) -> Column:
    """A text in which words, quoted and bold terms have the row's letter, and words that don't count stand at the end."""
    letter = _letter(key)
    body = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("ou"), F.concat(F.lit("o"), letter, F.lit("u"))), F.lit(" de "), F.lit(" -de "))
    return F.concat(body, F.lit(" `Wo"), letter, F.lit("-ka` and **( Ta"), letter, F.lit(" )**, there would be into, word meaning used was "), letter, letter, F.lit("u. café"))


_LETTER_SQL = "substr('ćšŋḣṡǧáéíóúķśṅźėčžʼ’âäǫȟĺṫųñöx', CAST({k} % 30 AS INTEGER) + 1, 1)"
_GIVEN_SQL = "replace(replace(coalesce({t}, ''), 'ou', 'o' || {l} || 'u'), ' de ', ' -de ') || ' `Wo' || {l} || '-ka` and **( Ta' || {l} || ' )**, there would be into, word meaning used was ' || {l} || {l} || 'u. café'".replace("{l}", _LETTER_SQL)
_QUOTED_SQL = "trim(regexp_replace(translate(lower({c}), '`*“”’', '  \"\"' || chr(39)), '\\s+', ' ', 'g'))"
_PACKED_SQL = f"regexp_replace({_QUOTED_SQL}, '[^0-9a-zćšŋḣṡǧáéíóúķśṅźėčž''ʼ-]+', '', 'g')"


@query(f"""
WITH d AS (SELECT doc_id, text, {_GIVEN_SQL.format(t='text', k='doc_id')} AS t, {_LETTER_SQL.format(k='doc_id')} AS l FROM documents)
SELECT doc_id, list_sort(list_distinct(regexp_extract_all(t, '[ćšŋḣṡáéíóúķśṅźėčžʼ]'))) AS letters, coalesce(regexp_matches(text, '[áâäéíóúǫȟŋṡšžčḣĺǧṫų]'), false) AS probable,
  list_contains(['á', 'â', 'ä', 'é', 'í', 'ó', 'ú', 'ǫ', 'ȟ', 'ŋ', 'ṡ', 'š', 'ž', 'č', 'ḣ', 'ĺ', 'ǧ', 'ṫ', 'ų'], l) AS diagnostic FROM d
""")
def special_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters a task may expect in each text, and whether the spelling of a text or of one letter is diagnostic."""
    key = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", X.special_chars(_given(F.col("text"), key)).alias("letters"), X.orthography_probable(F.col("text")).alias("probable"), X.orthography_probable(_letter(key)).alias("diagnostic"))


@query(f"""
WITH p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
g AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN ' ' WHEN turn % 2 = 0 THEN {_GIVEN_SQL.format(t='text', k='turn')} ELSE text || {_LETTER_SQL.format(k='length(text)')} END AS span, CASE WHEN turn % 3 = 0 THEN 'x' ELSE {_GIVEN_SQL.format(t='before', k='(turn + length(before))')} END AS gold,
  CASE WHEN turn % 4 = 1 THEN ['š', 'š', 'é', 'ǧ'] ELSE [] END AS named FROM p WHERE before IS NOT NULL),
c AS (SELECT *, regexp_extract_all(span, '[ćšŋḣṡáéíóúķśṅźėčžʼ]') AS said, CASE WHEN len(named) > 0 THEN named ELSE regexp_extract_all(gold, '[ćšŋḣṡáéíóúķśṅźėčžʼ]') END AS wanted FROM g),
h AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(wanted), lambda x: least(len(list_filter(said, lambda y: y = x)), len(list_filter(wanted, lambda y: y = x))))), 0) AS hits FROM c)
SELECT conv_id, turn, round(CASE WHEN len(wanted) = 0 THEN -1.0 WHEN trim(span) = '' THEN 0.0 WHEN hits = 0 THEN 0.0 ELSE 2.0::DOUBLE * hits / (len(said) + len(wanted)) END, 6) AS f1 FROM h
""")
def special_char_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of the marked letters of each turn: against the turn before, or against letters that the row names."""
    turn = F.col("turn")
    df = _answers(spark, sf_dir).withColumnRenamed("gold", "before")
    span = F.when(turn % 5 == 0, " ").when(turn % 2 == 0, _given(F.col("text"), turn)).otherwise(F.concat("text", _letter(F.length("text"))))
    gold = F.when(turn % 3 == 0, "x").otherwise(_given(F.col("before"), turn + F.length("before")))
    named = F.when(turn % 4 == 1, F.array(*map(F.lit, "ššéǧ"))).otherwise(F.array().cast("array<string>"))
    return df.select("conv_id", "turn", F.round(S.special_char_f1(span, gold, named).cast("double"), 6).alias("f1"))


@query(f"""
WITH d AS (SELECT doc_id, {_GIVEN_SQL.format(t='text', k='doc_id')} AS t FROM documents),
r AS (SELECT doc_id, list_concat(regexp_extract_all(t, '`([^`]{{2,80}})`', 1), regexp_extract_all(t, '\\*\\*([^*]{{2,80}})\\*\\*', 1),
  list_filter(regexp_extract_all(t, '[A-Za-zćšŋḣṡǧáéíóúķśṅźėčž''ʼ-]{{3,}}'), lambda x: regexp_matches(lower(x), '[ćšŋḣṡǧáéíóúķśṅźėčžʼ’''-]'))) AS raw FROM d),
e AS (SELECT doc_id, i, trim(trim(raw[i], ' ' || chr(9) || chr(10)), '.,;:()[]{{}}') AS term FROM (SELECT doc_id, raw, unnest(range(1, len(raw) + 1)) AS i FROM r)),
k AS (SELECT *, {_PACKED_SQL.format(c='term')} AS key FROM e),
f AS (SELECT doc_id, i, term FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY i) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT doc_id, list(term ORDER BY i) AS terms FROM n WHERE n <= 12 GROUP BY doc_id
""")
def dakota_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve terms of each text: quoted, bold, or with a marked letter, hyphen or apostrophe."""
    return table(spark, sf_dir, "documents").select("doc_id", X.marked_terms(_given(F.col("text"), F.col("doc_id"))).alias("terms"))


@query(f"""
WITH d AS (SELECT doc_id, {_QUOTED_SQL.format(c=_GIVEN_SQL.format(t='text', k='doc_id'))} AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[0-9a-zćšŋḣṡǧáéíóúķśṅźėčž''ʼ-]{{3,}}')) AS w FROM d),
k AS (SELECT DISTINCT doc_id, trim(w, '-ʼ' || chr(39)) AS w FROM w WHERE w NOT IN ('the', 'and', 'that', 'with', 'from', 'this', 'they', 'their', 'there', 'would', 'could', 'should', 'which', 'what', 'when', 'where', 'using', 'into', 'about', 'also', 'because', 'within', 'while', 'your', 'you',
  'are', 'for', 'of', 'to', 'in', 'on', 'or', 'is', 'be', 'a', 'an', 'it', 'as', 'by', 'its', 'not', 'than', 'then', 'these', 'those', 'has', 'have')),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, w) AS n FROM k WHERE w <> '')
SELECT doc_id, list(w ORDER BY w) AS words, list(w ORDER BY n) FILTER (WHERE n <= 20) AS keywords FROM n GROUP BY doc_id
""")
def word_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of each text that count, and the twenty longest."""
    t = _given(F.col("text"), F.col("doc_id"))
    both = X.let(X.word_set(t), lambda w: F.struct(F.sort_array(w).alias("words"), X.longest(w).alias("keywords")))
    return table(spark, sf_dir, "documents").select("doc_id", both.alias("both")).select("doc_id", "both.words", "both.keywords")


@query(f"""
WITH d AS (SELECT doc_id, {_GIVEN_SQL.format(t='text', k='doc_id')} AS t FROM documents),
s AS (SELECT doc_id, t || ' un- (-ku) ho-ku, -' || doc_id || '. ta- x' AS a, '-' || {_LETTER_SQL.format(k='doc_id')} || 'u re- -b' AS b FROM d)
SELECT doc_id, list_sort(list_distinct(list_concat(regexp_extract_all(a, '(?:^|\\s)((?:[\\p{{L}}\\p{{N}}_]+)?-[\\p{{L}}\\p{{N}}_]+|[\\p{{L}}\\p{{N}}_]+-)(?:\\s|$|,|\\.)', 1), regexp_extract_all(b, '(?:^|\\s)((?:[\\p{{L}}\\p{{N}}_]+)?-[\\p{{L}}\\p{{N}}_]+|[\\p{{L}}\\p{{N}}_]+-)(?:\\s|$|,|\\.)', 1)))) AS affixes FROM s
""")
def extract_affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affixes that each text names, taken as a rule's pattern, and those of its constraints."""
    key = F.col("doc_id")
    pattern = F.concat(_given(F.col("text"), key), F.lit(" un- (-ku) ho-ku, -"), key, F.lit(". ta- x"))
    limits = F.concat(F.lit("-"), _letter(key), F.lit("u re- -b"))
    return table(spark, sf_dir, "documents").select("doc_id", X.extract_affixes(pattern, limits).alias("affixes"))
