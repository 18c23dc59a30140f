"""Filters, projections and small lookups of task and entry tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import ranges

# Parts of speech, short and spelt out.
POS_NAMES = {
    "v.": "verb", "v. a.": "verb active", "v. n.": "verb neuter", "v. recip.": "verb reciprocal", "n.": "noun", "a.": "adjective", "adv.": "adverb",
    "prep.": "preposition", "conj.": "conjunction", "pron.": "pronoun", "interj.": "interjection", "pos.": "possessive", "part.": "participle", "p.": "plural",
}


#: Keys over which the edits of one ``old`` are dealt.
EDIT_SALTS = 16


def by_confidence(rows: DataFrame, col: str, least: float) -> DataFrame:
    return rows.filter(confidence(col, least))


def watched(rows: DataFrame, keep: Column) -> tuple[DataFrame, Observation]:
    """The rows that are kept, and counters (total, rejected) that are known once an action on them has run.

    They are gathered while the rows pass, without a job of their own. A null
    verdict rejects.
    """
    watch = Observation(f"filter-{uuid.uuid4().hex}")
    keep = F.coalesce(keep, F.lit(False))
    return rows.observe(watch, F.count(F.lit(1)).alias("total"), F.count_if(~keep).alias("rejected")).filter(keep), watch


def confidence(col: str, least: float) -> Column:
    """A missing confidence counts as 0."""
    return F.coalesce(F.col(col), F.lit(0.0)) >= least


def by_language(rows: DataFrame, col: str, language: str) -> DataFrame:
    return rows.filter(F.lower(X.text(F.col(col))) == language.lower())


def nonempty(rows: DataFrame, *cols: str) -> DataFrame:
    return reduce(lambda d, c: d.filter(F.trim(X.text(F.col(c))) != ""), cols, rows)


def valid_options(rows: DataFrame, question: str, options: str, correct: str) -> DataFrame:
    """Choices with a question, options, and a key among them."""
    return rows.filter((F.trim(X.text(F.col(question))) != "") & (F.cardinality(options) > 0) & F.map_contains_key(options, F.col(correct)))


def without_placeholders(rows: DataFrame, col: str) -> DataFrame:
    return rows.filter(~X.is_placeholder(F.col(col)))


def pos_expand(c: Column) -> Column:
    """The name of an abbreviated part of speech; null if it isn't known."""
    return reduce(lambda a, kv: F.when(X.text(c) == kv[0], kv[1]).otherwise(a), POS_NAMES.items(), F.lit(None).cast("string"))


def record(idx: Column, question: Column, answer: Column, task: Column, info: Column, prefix: str = "row_") -> Column:
    """A row as environments take it."""
    return F.struct(F.concat(F.lit(prefix), idx.cast("string")).alias("id"), question.alias("question"), answer.alias("answer"), task.alias("task"), info.alias("info"))


def translation_pair(entry: Column, word: Column, gloss: Column) -> Column:
    return F.struct(entry.alias("id"), word.alias("source"), gloss.alias("target"))


def candidate_counts(forms: DataFrame, head: str, edits: DataFrame) -> DataFrame:
    """Per headword, how many distinct forms the edits (old, new) can build.

    Every occurrence of ``old`` may become ``new``; an empty ``old`` is an insertion at
    every place. Edits are looked up by ``old`` among the letter runs of a headword,
    so work follows the edits that apply. Insertions apply to every headword: each
    ``old`` is dealt over ``EDIT_SALTS`` keys, so that one of them is no hot key. An
    edit with a null part builds nothing; a null headword has no forms.
    """
    heads = forms.select(F.col(head).alias("__h")).distinct()
    edits = edits.filter("old IS NOT NULL AND new IS NOT NULL").select("old", "new").distinct()
    # as many numbers as there are lengths of ``old``
    lengths = sorted(r[0] for r in edits.select(F.length("old")).distinct().collect())
    if not lengths:
        return heads.select(F.col("__h").alias(head), F.lit(0).alias("candidates"))
    size = F.explode(F.array(*[F.lit(n) for n in lengths]))
    runs = heads.select("__h", size.alias("__n")).filter(F.col("__n") <= F.length("__h")).withColumn("__i", F.explode(F.sequence(F.lit(0), F.length("__h") - F.col("__n"))))
    runs = runs.select("__h", "__n", "__i", F.substring("__h", F.col("__i") + 1, F.col("__n")).alias("old"), F.pmod(F.xxhash64("__h", "__i"), F.lit(EDIT_SALTS)).alias("__s"))
    dealt = edits.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(EDIT_SALTS - 1)).cast("array<bigint>")))
    built = F.concat(F.substring("__h", F.lit(1), F.col("__i")), "new", F.substring("__h", F.col("__i") + F.col("__n") + 1, F.length("__h")))
    made = runs.join(dealt, ["old", "__s"]).select("__h", built.alias("__f")).distinct().groupBy("__h").agg(F.count("*").cast("int").alias("__c"))
    same = F.col("__h").eqNullSafe(F.col("__k"))
    return heads.join(made.withColumnRenamed("__h", "__k"), same, "left").select(F.col("__h").alias(head), F.coalesce("__c", F.lit(0)).alias("candidates"))


def upper_median(rows: DataFrame, col: str) -> DataFrame:
    """Element n // 2 of the sorted values, and the highest; values are ranked by ranges if there are very many."""
    found = ranges.ranks(rows, [], col, {"median": lambda n: F.floor(n / 2)})
    return found.crossJoin(F.broadcast(rows.agg(F.max(col).alias("highest"))))  # one row each


def replay(dialogues: DataFrame, shown: DataFrame, budget: int = 3) -> DataFrame:
    """Check solved lookup conversations against the dictionary, for (id, target_plain, answer, messages).

    A conversation passes if every lookup's reply is the entry's text, lookups
    stay in the budget, the target was looked up, and the last turn answers.
    """
    m = dialogues.select("id", "target_plain", "answer", F.posexplode("messages").alias("pos", "m"), F.size("messages").alias("n"))
    word = F.regexp_extract("m.content", r"^LOOKUP: (.*)$", 1)
    asked = m.withColumn("word", F.when(F.col("m.role") == "assistant", F.nullif(word, F.lit(""))))
    replies = m.select("id", (F.col("pos") - 1).alias("pos"), F.col("m.content").alias("reply"))
    met = asked.join(replies, ["id", "pos"], "left").join(shown.select(F.col("plain").alias("word"), F.col("text").alias("entry")), "word", "left")
    return met.groupBy("id").agg(
        (F.count("word") <= budget).alias("in_budget"),
        F.coalesce(F.bool_and(F.when(F.col("word").isNotNull(), F.col("reply").eqNullSafe(F.col("entry")))), F.lit(True)).alias("replies_match"),
        F.coalesce(F.bool_or(F.col("word") == F.col("target_plain")), F.lit(False)).alias("target_seen"),
        F.bool_or((F.col("pos") == F.col("n") - 1) & (F.col("m.content") == F.concat(F.lit("ANSWER: "), "answer"))).alias("answered"),
    ).withColumn("passed", F.col("in_budget") & F.col("replies_match") & F.col("target_seen") & F.col("answered"))
