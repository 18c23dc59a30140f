from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import scores as S
from textloom.operators import verdicts


def score(spark, task, said, gold, arm="baseline"):
    col = S.score(F.lit(task), F.lit(said), F.lit(gold), F.array(F.lit(gold)), F.lit(arm))
    return spark.range(1).select(col.alias("s")).first()["s"].asDict()


def test_form_task(spark):
    assert score(spark, "en_to_dak", "ANSWER: amdakedaŋ", "amdakedaŋ")["reward"] == 1.0
    near = score(spark, "en_to_dak", "ANSWER: amdakedan", "amdakedaŋ")
    assert (near["reward"], near["exact"], near["loose_match"]) == (0.7, 0.0, 1.0)
    assert score(spark, "en_to_dak", "amdakedaŋ is near\nANSWER: x", "amdakedaŋ")["reward"] < 0.3
    assert score(spark, "en_to_dak", "<think>amdakedaŋ", "amdakedaŋ")["reward"] == 0.0
    gated = score(spark, "en_to_dak", "ANSWER: amdakexyz", "amdakedaŋ", "gated")
    assert gated["reward"] == 0.0 and gated["char_dice"] > 0


def test_syllabify(spark):
    gold = "a-hi'-yo"
    assert score(spark, "syllabify", "ANSWER: a-hi'-yo", gold)["reward"] == 1.0
    assert score(spark, "syllabify", "ANSWER: a-hi'-ya", gold)["reward"] == 0.0
    assert 0 < score(spark, "syllabify", "ANSWER: a'-hi-yo", gold)["reward"] < 1


def test_sets_choices_and_length(spark):
    assert score(spark, "pos", "ANSWER: v.a.", "v. a.")["reward"] == 1.0
    assert score(spark, "root", "ANSWER: kin and apa", "kin")["set_f1"] == pytest.approx(2 / 3)
    assert score(spark, "gloss", "ANSWER: a dog", "the dog")["reward"] == 1.0
    assert score(spark, "gloss", "ANSWER: dog " + "dog " * 60, "dog")["reward"] < 0.1


def test_ledger_adds_up(spark):
    led = S.grammar_ledger(F.lit("\\boxed{atkuku}"), F.lit("atkuku"), F.array(F.lit("-ku")), F.lit(0.0), F.lit("hard"))
    r = spark.range(1).select(*[v.cast("double").alias(k) for k, v in led.items()]).first()
    assert r["composite_pre"] == pytest.approx(sum(r[f"contrib_{k}"] for k in S.GRAMMAR_WEIGHTS)) == pytest.approx(0.7)
    assert r["reward"] == pytest.approx(r["composite_pre"] * r["length_penalty"])
    assert r["special_char_raw"] == S.NOT_APPLICABLE
    none = S.grammar_ledger(F.lit("x"), F.lit("x"), F.array().cast("array<string>"), F.lit(0.0), F.lit("easy"))
    assert spark.range(1).select(none["affix_raw"].cast("double")).first()[0] == 0.0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.text("abñ .", max_size=12), st.text("abñ .", max_size=12)), min_size=1, max_size=20))
def test_char_f1(spark, pairs):
    def want(a, b):
        a, b = (Counter("".join(x.lower().split())) for x in (a, b))
        n = sum((a & b).values())
        return 2 * n / (sum(a.values()) + sum(b.values())) if n else 0.0

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(S.char_f1(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([want(*p) for p in pairs])


def rewards(spark, **kw):
    got = spark.range(1).select(*[c.cast("double").alias(k) for k, c in kw.items()]).first().asDict()
    return {k: round(v, 6) for k, v in got.items()}


def test_alternative_rewards(spark):
    """Values worked out by hand from the rules of each reward."""
    lit, arr = F.lit, lambda *xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    hard, none = lit("hard"), arr()
    got = rewards(
        spark,
        held=S.adaptive_score(lit("morphology"), lit("it is Atkuku."), lit("atkuku"), none, arr("-ku"), hard),
        letters=S.adaptive_score(lit("reverse_translation"), lit("š x"), lit("dog"), arr("š", "ć", "š"), none, lit("easy")),
        words=S.adaptive_score(lit("word_translation"), lit("the dog"), lit("a dog"), none, arr("zz-"), lit("other")),
        other=S.adaptive_score(lit("syntax"), lit("none"), lit("dog"), none, none, lit(None).cast("string")),
        edge=S.shown_affixes(lit("ku taku kuta"), arr("-ku", "ku-", "-ak-", "-zz")),
        whole=S.shown_affixes(lit("ku"), arr("-ku", "ku-")),
        odd=S.shown_affixes(lit("a(b"), arr("-(b")),
    )
    assert got == {"held": 1.5, "letters": 0.25, "words": 0.65, "other": round(0.66 * 1.2, 6), "edge": 0.75, "whole": 0.0, "odd": 1.0}
    got = rewards(
        spark,
        nothing=S.five_part_score(lit("dog"), lit("dog"), none, lit(""), lit(0.0), none, lit("easy")),
        hints=S.five_part_score(lit("a dog runs"), lit("cat"), arr("-ns"), lit("p"), lit(0.0), arr("DOG", "cow"), lit("easy")),
        short=S.length_quality(lit("x"), lit("")),
        long=S.length_quality(lit("x" * 32), lit("ab")),
        mcq=S.mcq_score(lit("so it is\nB\n1\n2\n3"), lit("b")),
        wrong=S.mcq_score(lit("none"), lit("b")),
        bonus=S.curriculum_rubric(lit(0.5), lit(3), lit(1)),
        same=S.curriculum_rubric(lit(0.5), lit(0), lit(1)),
        exact=S.single_turn_check(lit(" Dog "), lit("dog"), arr("š"), arr("-zz")),
        marks=S.single_turn_check(lit("xšku"), lit("dog"), arr("š"), arr("-ku")),
        twice=S.single_turn_check(lit("xšku"), lit("dog"), arr("š", "š"), none),
        free=S.single_turn_check(lit("x"), lit("dog"), none, none),
        step=verdicts.step_reward(lit(True), lit(0.5), lit("hard"), lit(True)),
        bad=verdicts.step_reward(lit(False), lit(1.0), lit("hard"), lit(False)),
        unset=verdicts.step_reward(lit(True), lit(0.0), lit(None).cast("string"), lit(False)),
    )
    char = 2 * 1 / (8 + 3)
    assert got == {"nothing": 1.0, "hints": round(0.25 * char + 0.2 * 0.5 + 0.15 + 0.05, 6), "short": 0.0, "long": 0.5, "mcq": 1.0, "wrong": 0.1, "bonus": 0.7, "same": 0.5, "exact": 1.0, "marks": 1.0, "twice": 0.0, "free": 1.0, "step": 3.5, "bad": 0.0, "unset": 1.5}
