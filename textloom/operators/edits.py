"""Edits between a headword and its forms: mined, admitted by count, and what they explain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X

#: An edit takes so many letters out and puts so many in, at most.
MOST_OLD, MOST_NEW = 2, 5
PLURAL = "pi"


def without_ending(form: Column, ending: str = PLURAL) -> Column:
    """A form of more than a letter and the ending, without the ending; else null."""
    n = len(ending)
    return F.when(F.endswith(form, F.lit(ending)) & (F.length(form) > n + 1), F.left(form, F.length(form) - n))


def within(head: Column, form: Column, old: Column | int, new: Column | int) -> Column:
    """Whether an edit of ``old`` letters out and ``new`` in, at most, may lead from head to form: none that does is missed.

    What an edit leaves of the head is its beginning and its end, so the longer of
    the two is half of it at least.
    """
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    n, m = F.length(head), F.length(form)
    k = F.greatest(F.floor((n - lit(old) + 1) / 2).cast("int"), F.lit(0))
    return (m - n).between(-lit(old), lit(new)) & (F.startswith(form, F.left(head, k)) | F.endswith(form, F.right(head, k)))


def mined_edits(pairs: DataFrame, head: str, form: str, least: int = 25, counted: Column | None = None) -> DataFrame:
    """(old, new, n): edits of small size that lead from the head to the form in ``least`` pairs or more.

    If the form itself is no small edit away, the form without its plural ending
    may be. Equal forms have no edit; null and empty ones count as none. Only pairs
    that are ``counted`` count: as a filter, that test would run on every pair,
    here it runs on those that a small edit may explain.
    """
    h, f = F.col(head), F.col(form)

    near = lambda g: within(h, g, MOST_OLD, MOST_NEW)

    def small(g: Column) -> Column:
        fits = lambda e: F.when((F.length(e["old"]) <= MOST_OLD) & (F.length(e["new"]) <= MOST_NEW), F.struct(e["old"].alias("old"), e["new"].alias("new")))
        return F.when((g != "") & (g != h) & near(g), X.let(X.single_edit(h, g), fits))

    # a filter for edits would compute each of them twice, so their count leaves the rows without one out
    edit = F.coalesce(small(f), small(without_ending(f)))
    found = pairs.select(F.when(near(f) | near(without_ending(f)), edit if counted is None else F.when(counted, edit)).alias("e")).groupBy("e").agg(F.count("e").alias("n"))
    return found.filter(F.col("n") >= max(least, 1)).select("e.old", "e.new", "n")


def explained(pairs: DataFrame, head: str, form: str, admitted: DataFrame, loose: bool = False) -> DataFrame:
    """Add ``explained``: equal, or one admitted edit away, as it is or without the plural ending.

    With ``loose``, letters and edits are compared without their marks.
    """
    bare = X.fold_glyphs if loose else (lambda c: c)
    known = admitted.select(bare(F.col("old")).alias("__old"), bare(F.col("new")).alias("__new")).distinct().withColumn("__hit", F.lit(True))
    # two numbers: pairs that no admitted edit can explain need no edit
    old, new = known.agg(F.max(F.length("__old")), F.max(F.length("__new"))).first()
    h, out, hits = F.col(head), pairs, []
    for i, g in enumerate((F.col(form), without_ending(F.col(form)))):
        out = out.withColumn(f"__e{i}", F.when((g != "") & within(bare(h), bare(g), old or 0, new or 0), X.single_edit(bare(h), bare(g))))
        side = known.select(F.col("__old").alias(f"__o{i}"), F.col("__new").alias(f"__n{i}"), F.col("__hit").alias(f"__h{i}"))
        out = out.join(side, (F.col(f"__e{i}.old") == F.col(f"__o{i}")) & (F.col(f"__e{i}.new") == F.col(f"__n{i}")), "left")
        hits += [F.coalesce(F.col(f"__h{i}"), F.lit(False)), F.coalesce((g != "") & (g == h), F.lit(False))]
    out = out.withColumn("explained", hits[0] | hits[1] | hits[2] | hits[3])
    return out.select(*pairs.columns, "explained")


def suspect_pairs(pairs: DataFrame, head: str, form: str, starts: tuple[str, str] = ("e", "ć"), shown: int = 8) -> DataFrame:
    """How many pairs look as if a letter was read as another, and the first of them: head and form start so."""
    bad = pairs.filter(F.startswith(F.col(head), F.lit(starts[0])) & F.startswith(F.col(form), F.lit(starts[1])))
    # a bounded list a task, then the first of all
    first = bad.orderBy(head, form).limit(shown).agg(F.array_sort(F.collect_list(F.struct(F.col(head).alias("head"), F.col(form).alias("form")))).alias("examples"))
    return bad.agg(F.count("*").alias("n")).join(first, F.lit(True))  # one row on each side
