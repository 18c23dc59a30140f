"""Verdicts on forms and golds: audits, repairs, guardrails, validators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.udfs import stem_keys


def relation(form: Column, head: Column) -> Column:
    """How a form relates to its headword: prefix means that the head begins it."""
    return F.when(head == "", "no-stem").when(form == head, "identity").when(F.startswith(form, head), "prefix").when(F.endswith(form, head), "suffix").when(F.contains(form, head), "contained").otherwise("other")


def form_verdict(forms: DataFrame, form: str, loose: str, head: str, bad: Column, keys: DataFrame, key: str, loose_key: str) -> DataFrame:
    """Add ``verdict`` and ``relation``: attested, ng-variant, alphabet-violation, licensed-pending or unexplained."""
    exact = keys.select(F.col(key).alias("__k")).distinct().withColumn("__e", F.lit(True))
    near = keys.select(F.col(loose_key).alias("__l")).distinct().withColumn("__n", F.lit(True))
    out = forms.join(exact, forms[form] == F.col("__k"), "left").join(near, forms[loose] == F.col("__l"), "left")
    rel = relation(F.col(form), F.col(head))
    verdict = F.when(F.col("__e"), "attested-headword").when(F.col("__n"), "ng-variant").when(bad, "alphabet-violation").when(rel.isin("prefix", "suffix", "contained"), "licensed-pending").otherwise("unexplained")
    return out.withColumn("relation", rel).withColumn("verdict", verdict).drop("__k", "__e", "__l", "__n")


def validate_entry(rows: DataFrame) -> DataFrame:
    """Add ``issues`` and ``is_valid`` to dictionary entries; a warning makes a row invalid too."""
    blank = lambda c: F.trim(X.text(F.col(c))) == ""
    conf = F.coalesce("confidence", F.lit(1.0))
    tests = [
        (blank("headword"), F.lit("Missing headword")),
        (blank("definition_primary"), F.lit("Missing primary definition")),
        (blank("entry_id"), F.lit("Missing entry ID")),
        (~conf.between(0.0, 1.0), F.concat(F.lit("Invalid confidence: "), conf.cast("string"))),
        (blank("part_of_speech"), F.lit("Warning: No part of speech specified")),
        (conf < 0.7, F.concat(F.lit("Low confidence extraction: "), conf.cast("string"))),
    ]
    return _with_issues(rows, tests)


def validate_rule(rows: DataFrame) -> DataFrame:
    """The same for rules; a testable rule needs examples and criteria."""
    blank = lambda c: F.trim(X.text(F.col(c))) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    tests = [
        (blank("rule_id"), F.lit("Missing rule_id")),
        (blank("rule_name"), F.lit("Missing rule_name")),
        (blank("description"), F.lit("Missing description")),
        (blank("pattern"), F.lit("Missing pattern specification")),
        (F.col("testable") & none("transformations") & none("interlinear_examples"), F.lit("Testable rule must have examples")),
        (F.col("testable") & none("verification_criteria"), F.lit("Warning: No verification criteria specified")),
    ]
    return _with_issues(rows, tests)


def _with_issues(rows: DataFrame, tests: list[tuple[Column, Column]]) -> DataFrame:
    issues = F.filter(F.array(*[F.when(t, m) for t, m in tests]), lambda x: x.isNotNull())
    return rows.withColumn("issues", issues).withColumn("is_valid", F.size("issues") == 0)


def _judged(a: str, b: str, probable: Column) -> dict[str, Column]:
    blank = lambda c: F.trim(X.text(F.col(c))) == ""
    same = (F.lower(F.trim(a)) == F.lower(F.trim(b))) & ~blank(a)
    return {"total": F.count(F.lit(1)), "improbable": F.count_if(~probable), "identical": F.count_if(same), "missing": F.count_if(blank(a) | blank(b))}


def guardrail_counts(rows: DataFrame, a: str, b: str, probable: Column) -> DataFrame:
    """Counts by which a build is judged: improbable, identical and missing pairs."""
    out = rows.agg(*[c.alias(n) for n, c in _judged(a, b, probable).items()])
    return out.withColumn("improbable_ratio", F.col("improbable") / F.greatest(F.col("total"), F.lit(1)))


def guardrail(rows: DataFrame, a: str, b: str, probable: Column, most: float, write: Callable[[DataFrame], None]) -> dict:
    """Write a build and count while its rows pass; the counts, or an error with samples if a limit is passed.

    The counters are an observation of the write, so a build that is in order
    takes one job. Only where a limit is passed are rows looked at again, for
    the five least samples. Empty builds pass.
    """
    watch = Observation(f"guardrail-{uuid.uuid4().hex}")
    write(rows.observe(watch, *[c.alias(n) for n, c in _judged(a, b, probable).items()]))
    got = watch.get
    got["improbable_ratio"] = got["improbable"] / max(got["total"], 1)

    def least(bad: Column) -> str:
        return ", ".join(r[0] for r in rows.filter(bad).select(X.text(F.col(a)).alias("a")).orderBy("a").limit(5).collect())

    if got["improbable_ratio"] > most:
        raise ValueError(f"{got['improbable_ratio']:.3%} of entries look improbable: {least(~probable)}")
    if got["identical"]:
        raise ValueError(f"{got['identical']} entries are identical in both languages: {least((F.lower(F.trim(a)) == F.lower(F.trim(b))) & (F.trim(X.text(F.col(a))) != ''))}")
    if got["missing"]:
        raise ValueError(f"{got['missing']} entries lack a text")
    return got


def strip_parenthetical(gold: Column, attested: Column) -> Column:
    """A form followed by an English gloss in brackets, without the gloss."""
    form = F.trim(F.regexp_extract(F.trim(gold), r"^(.+?)\s+\(([^)]+)\)\s*$", 1))
    gloss = F.regexp_extract(F.trim(gold), r"^(.+?)\s+\(([^)]+)\)\s*$", 2)
    english = gloss.rlike(r"^[\x00-\x7F]*$") & (X.english_metalanguage(gloss) | F.contains(gloss, F.lit(" ")) | gloss.rlike("^[A-Za-z]+$"))
    return F.when((form != "") & (X.has_marked_letter(form) | attested) & english, form).otherwise(gold)


def is_form_gold(gold: Column, attested: Column) -> Column:
    """Neither blank, placeholder nor English talk, and marked or attested."""
    return (F.trim(X.text(gold)) != "") & ~X.is_placeholder(gold) & ~X.english_metalanguage(gold) & (X.has_marked_letter(gold) | attested)


def better_forms(asks: DataFrame, examples: DataFrame) -> DataFrame:
    """(__ask, __better): for each distinct (rule_id, source, want), the shortest example form of the rule, the least of
    equally short ones, that bears a wanted affix and shares the source's stem; asks without one have no row.

    Forms are looked up, not tried: by the ends and starts of their tokens for
    affixes, and by runs of letters for stems. Only the best form of a rule, affix
    and run can be an answer, so a list of forms is one row, and work follows the
    letters of forms and sources. Nulls in any column meet nothing.
    """
    asks = asks.filter("rule_id IS NOT NULL AND source IS NOT NULL AND want IS NOT NULL").distinct()
    wanted = asks.select("rule_id", F.explode("want").alias("affix")).distinct().withColumn("border", X.affix_border(F.col("affix")))
    forms = examples.filter(X.has_marked_letter(F.col("form"))).select("rule_id", "form").distinct()
    borne = forms.withColumn("border", F.explode(X.token_borders(F.col("form")))).join(wanted, ["rule_id", "border"]).filter(F.size(X.affix_tokens(F.col("form"), F.col("affix"))) > 0)
    runs = borne.withColumn("run", F.explode(stem_keys(F.col("form"), left=False)))
    best = runs.groupBy("rule_id", "affix", "run").agg(F.min(F.struct(F.length("form").alias("n"), "form")).alias("best"))
    keys = asks.withColumn("__ask", F.struct("rule_id", "source", "want")).withColumn("affix", F.explode("want")).withColumn("run", F.explode(stem_keys(F.col("source"), left=True)))
    return keys.join(best, ["rule_id", "affix", "run"]).groupBy("__ask").agg(F.min("best").alias("__best")).select("__ask", F.col("__best.form").alias("__better"))


def repair(tasks: DataFrame, lexicon: DataFrame, examples: DataFrame) -> DataFrame:
    """Repair or drop tasks; no form is ever made up.

    ``tasks`` has id, task_type, rule_id, answer, source and required_affixes;
    ``lexicon`` has form and english; ``examples`` has rule_id, form, english.
    Placeholder and blank golds go. Implausible affixes go, and those that no
    token of the gold bears; if none is left, an example form of the rule that
    bears one and shares the source's stem takes the gold's place when it is the
    only one (or the shortest). A reverse translation whose gold is no form gets
    the only form with that English, from the rule's examples, else the lexicon,
    or goes; word and morphology tasks whose source is English talk go.
    """
    known = lexicon.select(F.lower(F.trim("form")).alias("__f")).distinct().withColumn("__known", F.lit(True))
    df = tasks.filter((F.trim(X.text(F.col("answer"))) != "") & ~X.is_placeholder(F.col("answer")))
    df = df.withColumn("__bare", F.trim(F.regexp_replace("answer", r"\s+\([^)]*\)\s*$", "")))
    df = df.join(known, F.lower(F.col("__bare")) == F.col("__f"), "left").withColumn("__ok", F.coalesce("__known", F.lit(False)))
    df = df.withColumn("answer", strip_parenthetical(F.col("answer"), F.col("__ok"))).drop("__f", "__known", "__bare")
    bears = lambda form, a: F.size(X.affix_tokens(form, a)) > 0
    df = df.withColumn("__want", F.filter(F.coalesce("required_affixes", F.array().cast("array<string>")), X.is_plausible_affix))
    df = df.withColumn("__have", F.filter("__want", lambda a: bears(F.col("answer"), a)))
    df = df.withColumn("__ask", F.when(F.size("__have") < F.size("__want"), F.struct("rule_id", "source", F.col("__want").alias("want"))))
    df = df.join(better_forms(df.select("__ask.*"), examples), "__ask", "left").withColumn("answer", F.coalesce("__better", "answer"))
    df = df.withColumn("required_affixes", F.filter("__want", lambda a: bears(F.col("answer"), a)))
    one = lambda d, keys: d.groupBy(*keys).agg(F.min("form").alias("v"), F.countDistinct("form").alias("n")).filter("n = 1").drop("n")
    ex = one(examples.withColumn("en", F.lower(F.trim("english"))), ["rule_id", "en"]).withColumnRenamed("v", "__ex")
    lx = one(lexicon.withColumn("en", F.lower(F.trim("english"))), ["en"]).withColumnRenamed("v", "__lx")
    df = df.withColumn("en", F.lower(F.trim("answer"))).join(ex, ["rule_id", "en"], "left").join(lx, "en", "left")
    good = is_form_gold(F.col("answer"), F.col("__ok"))
    reverse = F.col("task_type") == "reverse_translation"
    df = df.withColumn("answer", F.when(reverse & ~good, F.coalesce("__ex", "__lx")).otherwise(F.col("answer")))
    talk = F.col("task_type").isin("word_translation", "morphology") & X.english_metalanguage(F.col("source"))
    return df.filter(F.col("answer").isNotNull() & ~F.coalesce(talk, F.lit(False))).select(*tasks.columns)


def quality_counts(rows: DataFrame, gold: str, affixes: str) -> DataFrame:
    """Rows, placeholders, English golds, marked golds, and affixes by state, before or after a repair."""
    lang = X.gold_language(F.col(gold))
    n = F.greatest(F.coalesce(F.size(affixes), F.lit(0)), F.lit(0))
    tests = {"placeholder": lang == "placeholder", "english_like": lang == "english_like", "marked": lang == "dakota_markers", "empty": lang == "empty", "ascii_or_unknown": lang == "ascii_or_unknown", "with_affixes": n > 0, "without_affixes": n == 0}
    return rows.agg(F.count("*").alias("rows"), *[F.count_if(t).alias(k) for k, t in tests.items()])


# What a step counts by its difficulty; any other counts once.
STEP_WEIGHTS = {"easy": 1.0, "medium": 1.5, "hard": 2.0}


def step_reward(valid: Column, accuracy: Column, difficulty: Column, first_of_category: Column) -> Column:
    """1 and the accuracy for a valid step, times difficulty, and 0.5 for a category not seen before."""
    level = F.coalesce(difficulty, F.lit("medium"))
    times = F.lit(1.0)
    for name, weight in STEP_WEIGHTS.items():
        times = F.when(level == name, weight).otherwise(times)
    return F.when(valid, 1.0 + accuracy).otherwise(0.0) * times + F.when(first_of_category, 0.5).otherwise(0.0)


def model_card_checks(cards: DataFrame, text: str, sections: list[str]) -> DataFrame:
    """Missing sections and leftover placeholders of Markdown cards."""
    heads = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^##\s+(.+?)\s*$"), 1), lambda h: F.lower(h))
    missing = F.array_except(F.array(*[F.lit(s.lower()) for s in sections]), heads)
    return cards.withColumn("missing", missing).withColumn("placeholders", F.regexp_count(text, F.lit(r"\[(?:More Information Needed|TODO)\]")))


def markdown_normalize(c: Column) -> Column:
    """A blank line around headings and lists, never more than one, and one line feed at the end."""
    spaced = F.regexp_replace(c, r"(?m)^(#{1,6} .*)\n(?!\n)", "$1\n\n")
    spaced = F.regexp_replace(spaced, r"([^\n])\n(#{1,6} )", "$1\n\n$2")
    tidy = F.regexp_replace(F.regexp_replace(spaced, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(tidy, r"\s+$", ""), F.lit("\n"))
