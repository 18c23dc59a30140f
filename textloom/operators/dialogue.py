"""Multi-turn verification: what each turn gets right, its feedback, and when a dialogue is over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X

MAX_TURNS = 3
#: The share of the expected words above which a translation is right, and above which it is close.
RIGHT_SHARE, CLOSE_SHARE = 0.8, 0.5
# Tasks whose answers are compared by words.
TRANSLATIONS = ["word_translation", "sentence_translation"]
# What a turn is told.
WELL_DONE, MISSING, REQUIRED, CLOSE, EXPECTED = " Correct! Well done.", "Missing special characters: ", "Required affixes: ", "Close, but not quite right. Check the exact form.", "Incorrect. Expected: "

_WORD = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _strings(c: Column | None) -> Column:
    none = F.array().cast("array<string>")
    return none if c is None else F.coalesce(c, none)


def missing_letters(response: Column, expected: Column) -> Column:
    """The expected letters that a response lacks, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(_strings(expected)), X.special_chars(response)))


def bears_affix(response: Column, affix: Column) -> Column:
    """Whether a response has an affix where its hyphen says: at a word's end, at a word's start, or anywhere."""
    bare = F.regexp_replace(affix, "^-+|-+$", "")
    quoted = F.concat(F.lit(r"\Q"), F.replace(bare, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    ends, starts = affix.startswith("-"), F.endswith(affix, F.lit("-"))
    return (
        F.when(ends & ~starts, F.rlike(X.text(response), F.concat(F.lit(_WORD + "+"), quoted, F.lit(_EDGE))))
        .when(starts & ~ends, F.rlike(X.text(response), F.concat(F.lit(_EDGE), quoted, F.lit(_WORD + "+"))))
        .otherwise(F.contains(X.text(response), bare))
    )


def similarity(response: Column, expected: Column, task_type: Column) -> Column:
    """1 for the same answer but for case and outer blanks; the share of expected words for a translation; else 0."""
    a, b = F.lower(X.strip_ws(response)), F.lower(X.strip_ws(expected))
    words = lambda c: F.array_distinct(F.filter(F.split(X.collapse(c), " "), lambda t: t != ""))
    shared = X.let(words(b), lambda want: F.when(F.size(want) == 0, 0.0).otherwise(F.size(F.array_intersect(want, words(a))) / F.size(want)))
    return F.when(a == b, 1.0).when(task_type.isin(TRANSLATIONS), shared).otherwise(0.0)


def verify_turn(response: Column, expected: Column, task_type: Column, letters: Column, affixes: Column) -> Column:
    """A struct of flags, partial credit, feedback and whether the turn fulfils its task.

    ``letters`` and ``affixes`` are what the task asks for; null or empty asks
    for nothing. Affixes count in tasks of morphology only. A null response or
    answer counts as empty, a null task type as one without rules of its own.
    """
    kind = F.coalesce(task_type, F.lit(""))
    morphology = kind == "morphology"
    parts = F.struct(
        missing_letters(response, letters).alias("missing"),
        (~morphology | F.forall(_strings(affixes), lambda a: bears_affix(response, a))).alias("affixes_correct"),
        similarity(response, expected, kind).alias("partial_credit"),
        (F.lower(X.strip_ws(response)) == F.lower(X.strip_ws(expected))).alias("same"),
    )

    def told(p):
        chars = F.size(p["missing"]) == 0
        # the same answer is right whatever the task; a share counts for translations alone
        means = p["same"] | (kind.isin(TRANSLATIONS) & (p["partial_credit"] > RIGHT_SHARE))
        perfect = F.when(morphology, chars & p["affixes_correct"]).when(kind == "reverse_translation", chars & means).otherwise(means)
        faults = F.array(
            F.when(~chars, F.concat(F.lit(MISSING), F.array_join(p["missing"], ", "))),
            F.when(~p["affixes_correct"], F.concat(F.lit(REQUIRED), F.array_join(_strings(affixes), ", "))),
            F.when(~means, F.when(p["partial_credit"] > CLOSE_SHARE, CLOSE).otherwise(F.concat(F.lit(EXPECTED), X.text(expected)))),
        )
        feedback = F.when(chars & p["affixes_correct"] & means, WELL_DONE).otherwise(F.array_join(faults, " | "))
        return F.struct(chars.alias("special_chars_correct"), p["affixes_correct"].alias("affixes_correct"), means.alias("semantic_correct"), p["partial_credit"].alias("partial_credit"), feedback.alias("feedback"), perfect.alias("perfect"))

    return X.let(parts, told)


def multi_turn(turns: DataFrame, conv: str, turn: str, verified: Column, most: int = MAX_TURNS) -> DataFrame:
    """The turns that count, with ``attempts`` (from 1), what was verified, and ``completed``.

    ``verified`` is `verify_turn`. A dialogue is over with the first turn that
    fulfils its task, or with the ``most``-th; later turns don't count. No more
    than the first ``most`` turns of a dialogue are looked at, so one that holds
    most rows is cut down before it is shuffled. Turn
    numbers are distinct within a dialogue; of equal ones, any comes first.
    """
    order = Window.partitionBy(conv).orderBy(turn)
    # the rank is cut where the rows are; only the rows left are verified
    first = turns.withColumn("attempts", F.row_number().over(order)).filter(F.col("attempts") <= most)
    df = first.withColumn("__v", verified).select("*", "__v.*").drop("__v")
    df = df.withColumn("completed", F.col("perfect") | (F.col("attempts") >= most))
    done = F.max("completed").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__done", F.coalesce(done, F.lit(False))).filter(~F.col("__done")).drop("__done")


def outcome(told: DataFrame, conv: str) -> DataFrame:
    """One row a dialogue: attempts, whether one was right, the last flags and the best partial credit."""
    last = lambda c: F.max_by(c, "attempts").alias(c)
    return told.groupBy(conv).agg(F.max("attempts").alias("attempts"), F.max("perfect").alias("solved"), *[last(c) for c in ("special_chars_correct", "affixes_correct", "semantic_correct", "feedback")], F.max("partial_credit").alias("partial_credit"))
