"""Queries of scorers and score ledgers, on conversations and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import scores as S
from textloom.functions import text as X
from textloom.functions import udfs
from textloom.operators import metrics, ranges, verdicts
from textloom.plans.registry import ORACLE_SQL, query
from textloom.session import table


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn beside the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("gold", F.lag("text").over(w)).filter("gold is not null")


_PAIRS = "pairs AS (SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations) WHERE gold IS NOT NULL)"
_STOP = ", ".join(f"'{w}'" for w in X.GLOSS_STOP)
_TOKENS = "(SELECT CASE WHEN len(list_filter(u, lambda x: NOT list_contains([{stop}], x))) > 0 THEN list_filter(u, lambda x: NOT list_contains([{stop}], x)) ELSE u END FROM (SELECT list_distinct(regexp_extract_all(lower({c}), '[a-z]+')) AS u))"
_BIGRAMS = "list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)))"


@query(f"""
WITH {_PAIRS}, tok AS (
  SELECT *, {_TOKENS.format(c='text', stop=_STOP)} AS a, {_TOKENS.format(c='gold', stop=_STOP)} AS b,
         {_BIGRAMS.format(c='text')} AS x, {_BIGRAMS.format(c='gold')} AS y,
         length(text) / greatest(length(gold), 1) AS ratio
  FROM pairs
), scored AS (
  SELECT role, turn,
         CASE WHEN len(list_intersect(a, b)) > 0 THEN 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0.0 END AS f1,
         CASE WHEN len(x) > 0 AND len(y) > 0 THEN 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) ELSE 0.0 END AS dice,
         CASE WHEN ratio <= 3 OR length(text) <= 24 THEN 1.0 ELSE 3.0::DOUBLE / ratio END AS guard
  FROM tok
)
SELECT coalesce(role, 'all') AS role, coalesce(CAST(turn AS VARCHAR), 'all') AS turn, count(*) AS n, round(avg(f1), 6) AS token_f1, round(avg(dice), 6) AS dice,
       round(avg((0.6::DOUBLE * f1 + 0.4::DOUBLE * dice) * guard), 6) AS reward
FROM scored GROUP BY GROUPING SETS ((role), (turn), ())
""")
def score_conversation_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _answers(spark, sf_dir)
    df = df.withColumn("f1", S.set_f1(X.gloss_tokens(F.col("text")), X.gloss_tokens(F.col("gold")))).withColumn("d", S.bigram_dice(F.col("text"), F.col("gold")))
    df = df.withColumn("reward", (0.6 * F.col("f1") + 0.4 * F.col("d")) * S.length_guard(F.col("text"), F.length("gold")))
    out = metrics.score_summary(df, [["role"], ["turn"], []], ["f1", "d", "reward"])
    every = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c)
    return out.select(every("role"), every("turn"), "n", F.round("f1", 6).alias("token_f1"), F.round("d", 6).alias("dice"), F.round("reward", 6).alias("reward"))


_BARE = "replace(regexp_replace(trim(lower({c})), '\\s+', ' ', 'g'), ' ', '')"
_HITS = "list_sum(list_transform(list_distinct(string_split({b}, '')), lambda c: least(length({a}) - length(replace({a}, c, '')), length({b}) - length(replace({b}, c, '')))))"


@query(f"""
WITH {_PAIRS}, s AS (SELECT conv_id, turn, {_BARE.format(c='text')} AS a, {_BARE.format(c='gold')} AS b FROM pairs)
SELECT conv_id, turn, round(CASE WHEN {_HITS.format(a='a', b='b')} > 0 THEN 2.0::DOUBLE * {_HITS.format(a='a', b='b')} / (length(a) + length(b)) ELSE 0.0 END, 6) AS char_f1 FROM s
""")
def char_f1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("conv_id", "turn", F.round(S.char_f1(F.col("text"), F.col("gold")), 6).alias("char_f1"))


@query(f"""
WITH {_PAIRS}, w AS (
  SELECT conv_id, turn, list_filter(list_distinct(regexp_split_to_array(trim(lower(text)), '\\s+')), lambda x: x <> '') AS a,
         list_filter(list_distinct(regexp_split_to_array(trim(lower(gold)), '\\s+')), lambda x: x <> '') AS b,
         length(trim(text)) AS n, length(trim(gold)) AS g, trim(text) AS t
  FROM pairs
)
SELECT conv_id, turn, round(CASE WHEN len(b) > 0 THEN len(list_intersect(a, b)) / len(b)::DOUBLE ELSE 0.0 END, 6) AS overlap,
       round(CASE WHEN n = 0 THEN 0.0 WHEN n / greatest(g, 1) <= 3 THEN 1.0 ELSE 3.0::DOUBLE / (n / greatest(g, 1)) END, 6) AS penalty,
       round(CASE WHEN n = 0 THEN 0.0 WHEN n / greatest(g, 1) BETWEEN 0.35 AND 2.5 THEN 1.0
             ELSE greatest(0.0, 1.0 - least(abs(ln((n / greatest(g, 1)) / 0.35::DOUBLE)), abs(ln((n / greatest(g, 1)) / 2.5::DOUBLE))) / 2) END, 6) AS smooth
FROM w
""")
def length_and_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.trim(F.col("text")), F.trim(F.col("gold"))
    return _answers(spark, sf_dir).select("conv_id", "turn", F.round(S.word_overlap(a, b), 6).alias("overlap"), F.round(S.length_penalty(a, b), 6).alias("penalty"), F.round(S.length_smooth(a, b), 6).alias("smooth"))


@query(f"""
WITH {_PAIRS}, s AS (SELECT *, {_BARE.format(c='text')} AS a, {_BARE.format(c='gold')} AS b, regexp_replace(trim(lower(text)), '\\s+', ' ', 'g') AS na, regexp_replace(trim(lower(gold)), '\\s+', ' ', 'g') AS nb FROM pairs),
p AS (
  SELECT role, CASE WHEN na = nb AND na <> '' THEN 1.0 ELSE 0.0 END AS exact,
         CASE WHEN {_HITS.format(a='a', b='b')} > 0 THEN 2.0::DOUBLE * {_HITS.format(a='a', b='b')} / (length(a) + length(b)) ELSE 0.0 END AS c,
         CASE WHEN contains(na, 'the') THEN 1.0 ELSE 0.0 END AS pat,
         CASE WHEN length(trim(text)) / greatest(length(trim(gold)), 1) <= 3 THEN 1.0 ELSE 3.0::DOUBLE / (length(trim(text)) / greatest(length(trim(gold)), 1)) END AS len
  FROM s
)
SELECT role, count(*) AS n, round(sum(0.4::DOUBLE * exact + 0.2::DOUBLE * c + 0.15::DOUBLE * pat), 4) AS composite, round(sum((0.4::DOUBLE * exact + 0.2::DOUBLE * c + 0.15::DOUBLE * pat) * len), 4) AS reward, CAST(0 AS BIGINT) AS broken
FROM p GROUP BY role
""")
def ledger_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grammar rewards whose parts must add up to them; the answer is the whole turn."""
    a, b = F.col("text"), F.col("gold")
    parts = {"exact": S.exact_match(a, b), "char": S.char_f1(a, b), "pattern": S.literal_pattern(a, F.lit("the")), "affix": F.lit(0.0)}
    df = _answers(spark, sf_dir).withColumns({f"c_{k}": S.GRAMMAR_WEIGHTS[k] * v for k, v in parts.items()} | {"pre": S.weighted(parts, S.GRAMMAR_WEIGHTS), "len": S.length_penalty(a, b)})
    df = df.withColumn("reward", F.col("pre") * F.col("len"))
    rebuilt = (F.col("c_exact") + F.col("c_char") + F.col("c_pattern") + F.col("c_affix")) * F.col("len")
    return df.groupBy("role").agg(F.count("*").alias("n"), F.round(F.sum("pre"), 4).alias("composite"), F.round(F.sum("reward"), 4).alias("reward"), F.count_if(F.abs(rebuilt - F.col("reward")) > 1e-9).alias("broken"))


_F1 = "(CASE WHEN len(list_intersect({a}, {b})) > 0 THEN 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) ELSE 0.0 END)"
_CHAR = "(CASE WHEN coalesce({hits}, 0) > 0 THEN 2.0::DOUBLE * {hits} / (length({a}) + length({b})) ELSE 0.0 END)"


def _char_sql(a: str, b: str) -> str:
    return _CHAR.format(hits=_HITS.format(a=a, b=b), a=a, b=b)


_NORM = "trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
_STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_LAST = "coalesce(list_filter(list_transform(string_split(replace({c}, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1], '')"
# the tokens of a gold that bear an affix, and whether the answer has one
_GOLD_TOKENS = "list_transform(string_split(trim(regexp_replace(gold, '\\s+', ' ', 'g')), ' '), lambda t: regexp_replace(t, '^[^\\p{L}\\p{N}_ʼ]+|[^\\p{L}\\p{N}_ʼ]+$', '', 'g'))"


@query(f"""
WITH {_PAIRS}, s AS (SELECT *, {_LAST.format(c='text')} AS span FROM pairs),
n AS (SELECT *, {_NORM.format(c='span')} AS na, {_NORM.format(c='gold')} AS nb, {_GOLD_TOKENS} AS toks,
  CASE WHEN (turn % 2 = 0 AND contains({_NORM.format(c='span')}, '[the')) OR (turn % 2 <> 0 AND regexp_matches(span, 'th(e|at)s', 'i')) THEN 1.0 ELSE 0.0 END AS hit FROM s),
t AS (SELECT *, string_split(na, ' ') AS said, replace(na, ' ', '') AS ba, replace(nb, ' ', '') AS bb FROM n),
r AS (SELECT conv_id, turn, CASE WHEN na <> '' AND na = nb THEN 1.0 ELSE 0.0 END AS e, {_char_sql('ba', 'bb')} AS c, hit AS p, span,
  regexp_extract_all(span, '[ćšŋḣṡáéíóúķśṅźėčžʼ]') AS sa, regexp_extract_all(gold, '[ćšŋḣṡáéíóúķśṅźėčžʼ]') AS sb,
  ((len(list_intersect(said, list_transform(list_filter(toks, lambda t: ends_with(lower(t), 'ing') AND length(t) > 3), lambda t: lower(t)))) > 0)::INT
   + (len(list_intersect(said, list_transform(list_filter(toks, lambda t: starts_with(lower(t), 'th') AND length(t) > 2), lambda t: lower(t)))) > 0)::INT) / 2.0::DOUBLE AS x,
  CASE WHEN length(trim(text)) = 0 THEN 0.0 WHEN length(trim(text)) / greatest(length(trim(gold)), 1) <= 3 THEN 1.0 ELSE 3.0::DOUBLE / (length(trim(text)) / greatest(length(trim(gold)), 1)) END AS l FROM t),
w AS (SELECT *, 0.4::DOUBLE * e + 0.2::DOUBLE * c + 0.15::DOUBLE * p + 0.1::DOUBLE * x AS pre FROM r)
SELECT conv_id, turn, e::DOUBLE AS exact_raw, round(c, 6) AS char_raw, p::DOUBLE AS pattern_raw, x AS affix_raw, round(0.4::DOUBLE * e, 6) AS contrib_exact, round(0.2::DOUBLE * c, 6) AS contrib_char,
  round(0.15::DOUBLE * p, 6) AS contrib_pattern, round(0.1::DOUBLE * x, 6) AS contrib_affix, CASE WHEN len(sb) = 0 THEN -1.0 WHEN span = '' OR len(sa) = 0 THEN 0.0 ELSE round(2.0::DOUBLE * list_sum(list_transform(list_distinct(sb), lambda x: least(len(list_filter(sa, lambda y: y = x)), len(list_filter(sb, lambda y: y = x))))) / (len(sa) + len(sb)), 6) END::DOUBLE AS special_char_raw, round(l::DOUBLE, 6) AS length_penalty, round(pre, 6) AS composite_pre, 1.5::DOUBLE AS difficulty_multiplier,
  round(pre * l, 6) AS reward, e::DOUBLE AS passed FROM w
""")
def score_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grammar ledger of the last line of each turn; patterns are data, every other one no valid expression."""
    df = _answers(spark, sf_dir).withColumn("pattern", F.when(F.col("turn") % 2 == 0, F.lit("[the")).otherwise(F.lit("th(e|at)s")))
    df = df.withColumn("hit", udfs.pattern_score(X.extract_final(F.col("text")), F.col("pattern")))
    led = S.grammar_ledger(F.col("text"), F.col("gold"), F.array(F.lit("-ing"), F.lit("th-")), F.col("hit"), F.lit("hard"))
    return df.select("conv_id", "turn", *[F.round(v.cast("double"), 6).alias(k) for k, v in led.items()])


_GLYPHS, _GLYPHS_TO = "".join(X.GLYPH_VARIANTS), "".join(X.GLYPH_VARIANTS.values())
_ACCENTS = X.ACCENTS.replace("'", "''")
_CANON = f"trim(regexp_replace(translate(translate(lower({{c}}), '{_GLYPHS}', '{_GLYPHS_TO}'), '{_ACCENTS}', repeat(chr(39), {len(X.ACCENTS)})), '\\s+', ' ', 'g'))"
_PLAIN = f"translate({_CANON}, '-' || chr(39), '')"
_BARE_PARTS = "list_transform({p}, lambda x: replace(x, chr(39), ''))"
_CUTS = "list_transform(range(1, len({p})), lambda i: CAST(list_sum(list_transform({p}[1:i], lambda x: length(replace(x, chr(39), '')))) AS BIGINT))"
_END = "length(replace(array_to_string({p}[1:list_position(list_transform({p}, lambda x: contains(x, chr(39))), true)], ''), chr(39), ''))"
_FORMS = "list_distinct(list_filter(list_transform(regexp_split_to_array(span, '[,;/\\n]|\\band\\b'), lambda x: trim(" + _PLAIN.format(c="x") + ", ' .()')), lambda x: x <> ''))"
_KINDS = ", ".join(f"'{k}'" for k in S.SCORERS)


@query(f"""
WITH {_PAIRS}, t AS (SELECT conv_id, turn, [{_KINDS}][turn % {len(S.SCORERS)} + 1] AS task, text, CASE conv_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', '-') ELSE gold END AS gold FROM pairs),
f AS (SELECT *, trim(regexp_extract({_STRIP.format(c='text')}, '^([^\\r\\n]*)', 1)) AS first FROM t),
s AS (SELECT *, trim(first, ' `"*') AS span, first <> '' AS parsed FROM f),
k AS (SELECT *, replace({_CANON.format(c='span')}, ' ', '') AS cand, {_PLAIN.format(c='span')} AS pl, {_PLAIN.format(c='gold')} AS gp, string_split(replace({_CANON.format(c='span')}, ' ', ''), '-') AS ps, string_split(gold, '-') AS gs,
  {_FORMS} AS forms, regexp_replace(lower(span), '[^a-z]', '', 'g') = regexp_replace(lower(gold), '[^a-z]', '', 'g') AS chosen, {_TOKENS.format(c='span', stop=_STOP)} AS ta, {_TOKENS.format(c='gold', stop=_STOP)} AS tb FROM s),
m AS (SELECT *, {_CUTS.format(p='ps')} AS cu, {_CUTS.format(p='gs')} AS gc, replace(regexp_replace(pl, '^[ .]+|[ .]+$', '', 'g'), ' ', '') AS fc, replace(gp, ' ', '') AS fg,
  list_distinct(list_transform(forms, lambda x: translate(x, 'ŋ ', 'n'))) AS lf, [translate(gp, 'ŋ ', 'n')] AS lg FROM k),
l AS (SELECT *, {_BIGRAMS.format(c='fc')} AS ba, {_BIGRAMS.format(c='fg')} AS bb, translate({_PLAIN.format(c='cand')}, '-' || chr(39), '') = gp AS letters, cand = gold AS same,
  CASE WHEN len(cu) = 0 AND len(gc) = 0 THEN 1.0 ELSE {_F1.format(a='cu', b='gc')} END AS bound,
  (len(list_filter(ps, lambda x: contains(x, chr(39)))) = 1 AND {_END.format(p='ps')} = coalesce({_END.format(p='gs')}, length(replace(gs[1], chr(39), ''))))::INT AS stress,
  {_F1.format(a='forms', b='[gp]')} AS sf, {_F1.format(a='lf', b='lg')} AS lo, {_F1.format(a='ta', b='tb')} AS tf FROM m),
d AS (SELECT *, {_F1.format(a='ba', b='bb')} AS dice, translate({_PLAIN.format(c='fc')}, 'ŋ ', 'n') = translate(fg, 'ŋ ', 'n') AS near FROM l),
o AS (SELECT *, span <> '' AND task = 'syllabify' AS is_s, span <> '' AND task IN ('inflect', 'root') AS is_f, span <> '' AND task = 'pos' AS is_p, span <> '' AND task = 'en_to_dak' AS is_e, span <> '' AND task IN ('gloss', 'lookup_gloss', 'lookup_root_gloss') AS is_g FROM d),
r AS (SELECT *, CASE WHEN span = '' THEN 0.0 WHEN is_s THEN CASE WHEN NOT letters THEN 0.0 WHEN same THEN 1.0 ELSE 0.6::DOUBLE * bound + 0.2::DOUBLE * stress END WHEN is_f THEN sf WHEN is_p THEN chosen::INT WHEN is_e THEN CASE WHEN fc = fg THEN 1.0 WHEN near THEN 0.7 ELSE 0.0 END ELSE tf END AS raw,
  CASE WHEN span = '' THEN 0 WHEN is_s THEN same::INT WHEN is_f THEN (len(forms) = 1 AND forms[1] = gp)::INT WHEN is_p THEN chosen::INT WHEN is_e THEN (fc = fg)::INT ELSE (tf = 1)::INT END AS exact,
  CASE WHEN length(span) <= 24 OR length(span) / greatest(length(gold), 1) <= 3 THEN 1.0 ELSE 3.0::DOUBLE / (length(span) / greatest(length(gold), 1)) END AS guard FROM o)
SELECT conv_id, turn, task, round((raw * guard)::DOUBLE, 6) AS reward, exact::DOUBLE AS exact, round(raw::DOUBLE, 6) AS raw, CASE WHEN is_s THEN letters::INT::DOUBLE END AS letters_ok, CASE WHEN is_s THEN round(CASE WHEN letters THEN bound ELSE 0.0 END::DOUBLE, 6) END AS boundary_f1, CASE WHEN is_s THEN CASE WHEN letters THEN stress ELSE 0 END::DOUBLE END AS stress_ok,
  CASE WHEN is_f THEN round(sf::DOUBLE, 6) END AS set_f1, CASE WHEN is_f THEN round(lo::DOUBLE, 6) END AS loose_f1, CASE WHEN is_e THEN near::INT::DOUBLE END AS loose_match, CASE WHEN is_e THEN round(dice::DOUBLE, 6) END AS char_dice, CASE WHEN is_g THEN round(tf::DOUBLE, 6) END AS token_f1,
  parsed::INT::DOUBLE AS parse_ok, length(span)::DOUBLE AS answer_len, round(guard::DOUBLE, 6) AS length_mult FROM r
""")
def score_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scorer by its task: the turns of a conversation go through the tasks; the gold is the turn itself, its words with hyphens, or the turn before."""
    return _scored_tasks(_answers(spark, sf_dir), F.lit("gated"))


#: The same by arm: the baseline pays for the overlap of a form, the gated one doesn't.
_ARMS_SQL = ORACLE_SQL["score_tasks"]
for _old, _new in (
    ("AS gold FROM pairs)", "AS gold, arm, version FROM pairs, (VALUES ('baseline', '2026-11-10.2'), ('gated', '2026-11-13-gated.1')) v(arm, version))"),
    ("WHEN near THEN 0.7 ELSE 0.0 END ELSE tf", "WHEN near THEN 0.7 WHEN arm = 'gated' THEN 0.0 ELSE 0.25::DOUBLE * dice END ELSE tf"),
    ("SELECT conv_id, turn, task, round((raw", "SELECT conv_id, turn, arm, version, task, round((raw"),
):
    assert _old in _ARMS_SQL
    _ARMS_SQL = _ARMS_SQL.replace(_old, _new)


@query(_ARMS_SQL)
def score_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scorer under every arm of the experiment at once, with the version of the arm's rules."""
    df = _answers(spark, sf_dir).withColumn("arm", S.every_arm()).withColumn("version", S.scorer_version(F.col("arm")))
    return _scored_tasks(df, F.col("arm"), ("arm", "version"))


def _scored_tasks(df: DataFrame, arm: Column, more: tuple[str, ...] = ()) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in S.SCORERS])
    df = df.withColumn("task", F.element_at(kinds, (F.col("turn") % len(S.SCORERS) + 1).cast("int")))
    kind = F.col("conv_id") % 3
    df = df.withColumn("gold", F.when(kind == 0, F.col("text")).when(kind == 1, F.replace("text", F.lit(" "), F.lit("-"))).otherwise(F.col("gold")))
    led = S.score(F.col("task"), F.concat(F.lit("<think>hm</think>ANSWER: "), "text"), F.col("gold"), F.array("gold"), arm)
    keys = ["conv_id", "turn", *more, "task"]
    out = df.select(*keys, led.alias("l")).select(*keys, "l.*")
    return out.select(*keys, *[F.round(c, 6).alias(c) for c in out.columns[len(keys) :]])


def _scored(df: DataFrame) -> DataFrame:
    """Beside each pair a task, required affixes, hints, expected letters and a difficulty."""
    kind = (F.col("conv_id") + F.col("turn")) % 5
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (kind + 1).cast("int"))
    none = F.array().cast("array<string>")
    return df.withColumns({
        "task": pick("morphology", "word_translation", "reverse_translation", "syntax", "sentence_translation"), "difficulty": pick("easy", "medium", "hard", "expert", "other"),
        "affixes": F.when(kind == 4, none).otherwise(F.array(F.lit("-er"), F.lit("th-"), F.lit("-an-"))), "hints": F.when(kind < 2, none).otherwise(F.array(F.lit("The"), F.lit("zzz"))),
        "letters": F.when(kind == 3, none).otherwise(F.array(F.lit("é"), F.lit("á"), F.lit("ć"))), "pattern": pick("", "rule: the", "[an", "th(e|at)s", "zzz"), "kind": kind,
    })


_SCORED = """k AS (SELECT *, (conv_id + turn) % 5 AS kind FROM pairs), z AS (SELECT *, ['morphology', 'word_translation', 'reverse_translation', 'syntax', 'sentence_translation'][kind + 1] AS task, [1.0, 1.2, 1.5, 2.0, 1.0][kind + 1]::DOUBLE AS times, {na} AS na, {nb} AS nb, lower({sa}) AS la, lower({sb}) AS lb FROM k),
y AS (SELECT *, replace(na, ' ', '') AS ba, replace(nb, ' ', '') AS bb, list_distinct(list_filter(string_split(na, ' '), lambda x: x <> '')) AS wa, list_distinct(list_filter(string_split(nb, ' '), lambda x: x <> '')) AS wb,
  CASE WHEN kind = 4 THEN 1.0 ELSE (regexp_matches(text, '[\\p{{L}}\\p{{N}}_]+er([^\\p{{L}}\\p{{N}}_]|$)')::INT + regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])th[\\p{{L}}\\p{{N}}_]+')::INT + contains(text, 'an')::INT) / 3.0::DOUBLE END AS ends,
  CASE WHEN kind = 4 THEN 1.0 ELSE (contains(text, 'er')::INT + contains(text, 'th')::INT + contains(text, 'an')::INT) / 3.0::DOUBLE END AS anywhere,
  CASE WHEN kind = 3 THEN 1.0 ELSE (contains(text, 'é')::INT + contains(text, 'á')::INT + contains(text, 'ć')::INT) / 3.0::DOUBLE END AS letters,
  CASE kind WHEN 0 THEN false WHEN 1 THEN contains(na, 'rule: the') OR contains(na, 'the') OR regexp_matches(text, 'rule: the', 'i') WHEN 2 THEN contains(na, '[an') WHEN 3 THEN regexp_matches(text, 'th(e|at)s', 'i') ELSE contains(na, 'zzz') END AS hit FROM z)""".format(
    na=_NORM.format(c="text"), nb=_NORM.format(c="gold"), sa=_STRIP.format(c="text"), sb=_STRIP.format(c="gold")
)


@query(f"""
WITH {_PAIRS}, {_SCORED},
p AS (SELECT *, CASE WHEN nb = '' OR contains(na, nb) THEN 1.0 ELSE len(list_intersect(wa, wb)) / len(wb)::DOUBLE END AS sem, {_char_sql('ba', 'bb')} AS ch, CASE WHEN hit THEN 1.0 WHEN kind >= 2 THEN contains(lower(text), 'the')::INT / 2.0::DOUBLE WHEN kind = 0 THEN 1.0 ELSE 0.0 END AS pat,
  CASE WHEN length({_STRIP.format(c='text')}) < 2 THEN 0.0 WHEN length({_STRIP.format(c='gold')}) > 0 AND length({_STRIP.format(c='text')}) > 8 * length({_STRIP.format(c='gold')}) THEN 8.0::DOUBLE * length({_STRIP.format(c='gold')}) / length({_STRIP.format(c='text')}) ELSE 1.0 END AS len,
  CASE WHEN lb <> '' AND contains(la, lb) THEN 1.0 WHEN kind IN (1, 4) THEN CASE WHEN len(wb) > 0 THEN len(list_intersect(wa, wb)) / len(wb)::DOUBLE ELSE 0.0 END ELSE 0.0 END AS held FROM y)
SELECT conv_id, turn, round((0.35::DOUBLE * sem + 0.25::DOUBLE * ch + 0.2::DOUBLE * pat + 0.15::DOUBLE * ends + 0.05::DOUBLE * len) * times, 6) AS five_part,
  round(CASE kind WHEN 0 THEN 0.4::DOUBLE * letters + 0.4::DOUBLE * ends + 0.2::DOUBLE * held WHEN 2 THEN 0.5::DOUBLE * letters + 0.5::DOUBLE * held WHEN 3 THEN 0.33::DOUBLE * letters + 0.33::DOUBLE * ends + 0.34::DOUBLE * held ELSE 0.3::DOUBLE * letters + 0.7::DOUBLE * held END * times, 6) AS adaptive,
  round(0.9::DOUBLE * (regexp_extract(upper(text), '(?:^|[^\\p{{L}}\\p{{N}}_])([A-E])(?:[^\\p{{L}}\\p{{N}}_]|$)', 1) = 'A')::INT + 0.1::DOUBLE, 6) AS mcq, (sem >= 0.95)::INT::DOUBLE AS binary, round(sem + 0.1::DOUBLE * greatest(kind - 1, 0), 6) AS curriculum,
  la = lb OR (letters > 0.9 AND anywhere > 0.9) AS passed, round(CASE WHEN turn % 3 <> 0 THEN 1.0 + sem ELSE 0.0 END * [1.0, 1.5, 2.0, 1.0, 1.0][kind + 1]::DOUBLE + CASE WHEN turn = 1 THEN 0.5 ELSE 0.0 END, 6) AS step_reward
FROM p
""")
def score_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternative rewards: five parts, task weights, choices, rubrics, single turns and steps."""
    a, b, c = F.col("text"), F.col("gold"), F.col
    df = _scored(_answers(spark, sf_dir))
    df = df.withColumn("found", udfs.pattern_score(a, c("pattern"))).withColumn("sem", S.meaning(a, b))
    return df.select(
        "conv_id", "turn", F.round(S.five_part_score(a, b, c("affixes"), c("pattern"), c("found"), c("hints"), c("difficulty")), 6).alias("five_part"),
        F.round(S.adaptive_score(c("task"), a, b, c("letters"), c("affixes"), c("difficulty")), 6).alias("adaptive"), F.round(S.mcq_score(a, F.lit("a")), 6).alias("mcq"),
        S.binary_rubric(c("sem")).alias("binary"), F.round(S.curriculum_rubric(c("sem"), c("kind"), F.lit(1)), 6).alias("curriculum"), S.single_turn_check(a, b, c("letters"), c("affixes")).alias("passed"),
        F.round(verdicts.step_reward(c("turn") % 3 != 0, c("sem"), c("difficulty"), c("turn") == 1), 6).alias("step_reward"),
    )


_QUOTES = "trim(regexp_replace(translate(lower({c}), '`*“”’', '  \"\"' || chr(39)), '\\s+', ' ', 'g'))"
_TERM = "0-9a-zćšŋḣṡǧáéíóúķśṅźėčž''ʼ-"
_COMPACT = f"regexp_replace({_QUOTES}, '[^{_TERM}]+', '', 'g')"
#: The twin's own list of words that don't count.
_STOPPED = "the and that with from this they their there would could should which what when where using into about also because within while your you are for of to in on or is be a an it as by its not than then these those has have"
_META = ", ".join(f"'{w}'" for w in _STOPPED.split())
_WORDSET = f"list_distinct(list_filter(list_transform(list_filter(regexp_extract_all({_QUOTES}, '[{_TERM}]{{{{3,}}}}'), lambda w: NOT list_contains([{_META}], w)), lambda w: trim(w, '-' || chr(39) || 'ʼ')), lambda w: w <> ''))"


@query(f"""
WITH {_PAIRS}, q AS (SELECT conv_id, turn, text, '`Wo-ka` **Ta** ' || gold AS gold FROM pairs),
t AS (SELECT *, {_COMPACT.format(c='text')} AS ca, {_COMPACT.format(c='gold')} AS cb, {_WORDSET.format(c='text')} AS wa, {_WORDSET.format(c='gold')} AS wb, {_QUOTES.format(c='text')} = {_QUOTES.format(c='gold')} AS same,
  list_concat(regexp_extract_all(gold, '`([^`]{{2,80}})`', 1), regexp_extract_all(gold, '\\*\\*([^*]{{2,80}})\\*\\*', 1), list_filter(regexp_extract_all(gold, '[A-Za-zćšŋḣṡǧáéíóúķśṅźėčž''ʼ-]{{3,}}'), lambda x: regexp_matches(lower(x), '[ćšŋḣṡǧáéíóúķśṅźėčžʼ’''ʼ-]'))) AS raw FROM q),
u AS (SELECT *, list_filter(list_transform(raw, lambda x: {_COMPACT.format(c="trim(x, ' .,;:()[]{}')")}), lambda x: x <> '') AS every, list_transform(list_sort(list_transform(wb, lambda w: {{'n': -length(w), 'w': w}})), lambda x: x.w)[1:20] AS top FROM t),
v AS (SELECT *, list_filter(every, lambda x, i: list_position(every, x) = i)[1:12] AS terms, length(trim({_STRIP.format(c='text')})) AS n, greatest(length(gold), 1) AS g FROM u),
p AS (SELECT *, same::INT AS e, CASE WHEN len(terms) = 0 THEN 1.0 ELSE len(list_filter(terms, lambda x: contains(ca, x))) / len(terms)::DOUBLE END AS ts, {_char_sql('ca', 'cb')} AS ch, CASE WHEN len(top) = 0 THEN 1.0 ELSE len(list_intersect(top, wa)) / len(top)::DOUBLE END AS ks,
  CASE WHEN n = 0 THEN 0.0 WHEN n / g BETWEEN 0.35 AND 2.5 THEN 1.0 ELSE greatest(0.0, 1.0 - least(abs(ln(greatest(n / g, 1e-6) / 0.35::DOUBLE)), abs(ln(greatest(n / g, 1e-6) / 2.5::DOUBLE))) / 2) END AS le FROM v)
SELECT conv_id, turn, e::DOUBLE AS exact, round(ts, 6) AS terms, round(ch, 6) AS "char", round(ks, 6) AS keywords, round(le::DOUBLE, 6) AS length, round(0.2::DOUBLE * e + 0.3::DOUBLE * ts + 0.25::DOUBLE * ch + 0.15::DOUBLE * ks + 0.1::DOUBLE * le, 6) AS score FROM p
""")
def score_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free answers by exactness, terms, characters, keywords and length; two terms stand in every gold."""
    a, b = F.col("text"), F.col("gold")
    df = _answers(spark, sf_dir).withColumn("gold", F.concat(F.lit("`Wo-ka` **Ta** "), "gold"))
    return df.select("conv_id", "turn", *[F.round(v.cast("double"), 6).alias(k) for k, v in S.qa_parts(a, b).items()], F.round(S.qa_score(a, b), 6).alias("score"))


@query(f"""
WITH {_PAIRS}, s AS (SELECT conv_id, turn, length(text) / (length(text) + length(gold))::DOUBLE AS score FROM pairs)
SELECT conv_id, turn, round(greatest(0.0, score - lag(score) OVER (PARTITION BY conv_id ORDER BY turn)), 6) AS improvement FROM s
""")
def reward_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = _answers(spark, sf_dir).withColumn("score", F.length("text") / (F.length("text") + F.length("gold")))
    gain = F.col("score") - F.lag("score").over(w)
    # greatest() skips a null, here there is none before the first score
    return df.select("conv_id", "turn", F.round(F.greatest(F.lit(0.0), gain), 6).alias("improvement"))


@query(f"""
WITH {_PAIRS}, g AS (SELECT conv_id, min((length(text) > length(gold))::INT) AS lo, max((length(text) > length(gold))::INT) AS hi FROM pairs GROUP BY conv_id),
k AS (SELECT CASE WHEN hi = 0 THEN 'all_wrong' WHEN lo = 1 THEN 'all_right' ELSE 'mixed' END AS outcome, count(*) AS groups FROM g GROUP BY 1)
SELECT outcome, groups, round(groups / (SELECT sum(groups) FROM k)::DOUBLE, 6) AS share FROM k
""")
def group_outcome_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.outcome_shares(_answers(spark, sf_dir), "conv_id", F.length("text") > F.length("gold"))
    return out.withColumn("share", F.round("share", 6))


@query("""
SELECT l_orderkey, l_linenumber,
       round(l_quantity - avg(l_quantity) OVER w, 6) AS advantage,
       round((l_quantity - avg(l_quantity) OVER w) / greatest(stddev_pop(l_quantity) OVER w, 0.25), 6) AS scaled
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)
""")
def group_advantage_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(metrics.group_advantage(q, ["l_orderkey"]), 6).alias("advantage"), F.round(metrics.group_advantage(q, ["l_orderkey"], 0.25), 6).alias("scaled"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_mfgr, p_name || CASE WHEN p_size % 2 = 0 THEN 'q̣' ELSE '' END AS d, p_brand AS e, length(p_name) AS n, p_size % 2 = 0 AS m FROM (SELECT *, p_type AS p_mfgr FROM part)),
j AS (SELECT a.p_mfgr AS kind, a.d AS da, b.d AS db, a.e AS ea, b.e AS eb, CASE WHEN a.m AND b.m THEN (a.n = b.n)::INT WHEN a.m OR b.m THEN 0 ELSE 1 END AS marks FROM p a JOIN p b ON b.k = a.k + 1 UNION ALL SELECT p_mfgr, d, d, e, e, 1 FROM p)
SELECT kind, count(*) AS n, round(avg((da = db AND ea = eb)::INT), 6) AS exact_rate,
  round(avg((levenshtein(ea, eb) / greatest(length(ea), length(eb), 1)::DOUBLE + levenshtein(replace(da, 'q̣', 'QX'), replace(db, 'q̣', 'QX')) / greatest(length(da), length(db), 1)::DOUBLE) / 2), 6) AS char_dist, round(avg((1.0 + marks) / 2), 6) AS diacritics FROM j GROUP BY kind
""")
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as the prediction of itself and of the next one: exact pairs, mean distance and marks that are kept, by type."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "q\u0323").otherwise("")).alias("d"), F.col("p_brand").alias("e"))
    truth = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("d").alias("td"), F.col("e").alias("te"))
    pairs = p.join(truth, "p_partkey").unionByName(p.withColumn("td", F.col("d")).withColumn("te", F.col("e")))
    out = metrics.pair_metrics(pairs.withColumnRenamed("p_type", "kind"), ["kind"], ("d", "e"), ("td", "te"))
    return out.select("kind", "n", *[F.round(c, 6).alias(c) for c in ("exact_rate", "char_dist", "diacritics")])


@query("""
SELECT p_partkey, s_suppkey, round(levenshtein(p.p_name, s.s_name) / greatest(length(p.p_name), length(s.s_name))::DOUBLE, 6) AS distance
FROM part p JOIN supplier s ON p.p_partkey = s.s_suppkey
""")
def levenshtein_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").join(table(spark, sf_dir, "supplier"), F.col("p_partkey") == F.col("s_suppkey"))
    return df.select("p_partkey", "s_suppkey", F.round(X.levenshtein_norm(F.col("p_name"), F.col("s_name")), 6).alias("distance"))


@query("""
WITH p AS (SELECT lang, text, lag(text) OVER (PARTITION BY lang ORDER BY doc_id) AS said FROM documents),
t AS (SELECT lang, said, unnest(list_distinct(regexp_extract_all(text, '[áéíóúñäöüßçèêà]'))) AS ch FROM p WHERE said IS NOT NULL)
SELECT lang, ch, count(*) AS expected, count(*) FILTER (WHERE contains(said, ch)) AS hit, round(count(*) FILTER (WHERE contains(said, ch)) / count(*)::DOUBLE, 6) AS accuracy FROM t GROUP BY lang, ch
""")
def accuracy_by_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each marked letter of a text, whether the text before it in its language has it; only letters are carried along."""
    letters = F.array_distinct(F.regexp_extract_all("text", F.lit("([áéíóúñäöüßçèêà])"), 1))
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", letters.alias("letters"))
    pairs = ranges.framed(docs, ["lang"], ["doc_id"], 2, lambda w: {"said": F.lag("letters").over(w)})
    each = pairs.filter("said is not null").select("lang", "said", F.explode("letters").alias("ch"))
    hit = F.array_contains("said", F.col("ch"))
    return each.groupBy("lang", "ch").agg(F.count("*").alias("expected"), F.count_if(hit).alias("hit"), F.round(F.avg(hit.cast("int")), 6).alias("accuracy"))
