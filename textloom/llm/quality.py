"""Quality rules: cross-document line frequency, on text statistics of each document.

Lines are normalised (lower case, white space collapsed) and hashed. Per host
and line, the distinct documents that hold it are counted; equal texts are one
document. Lines above the limits are removed and documents of which too little
is left are rejected. Copies of a document with small edits count once, so they
neither make a line boilerplate nor hide that it is. Copies are found once a
document, not once a line: of the lines that more than ``max_docs`` documents of
the host hold, each document has ``BANDS`` least ones, by as many orders; in each
band, the first document with the same least line stands for it. Two documents
are copies if one stands for the other in at least ``AGREE`` bands and they share
more than ``copy_share`` of the distinct lines of the larger one. A document
counts as the first of itself and those it is a copy of, and a line is above
the limits if more than ``max_docs`` such firsts hold it. So a document meets no
more than half as many others as there are bands, whatever the number of its
lines or of its copies, and work grows with the text. (Copies of a text of two
or three lines, each edited somewhere else, share too little to be told apart.)

Everything is DataFrame code. One pass over the texts makes a narrow table
(statistics, line hashes) in the shared folder; counts and the join back run on
hashes, pre-aggregated before each shuffle, so neither a hot host nor a hot line
gathers in one task.

Trigrams of words found twice are searched by sorting, per document, one long
per window: hash bits above, position below; equal hashes are confirmed on the
words themselves.

Defined cases: a null text has no words and fails; a null host is a host of its
own; repeated rows keep their rows and count as one document; lines without a
word don't count; empty tables give no rows; other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import discard, stored

#: White space of the word rule: blank, and tab to carriage return.
_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
#: Bands, how many of them copies agree in, and the multipliers that order lines differently in each.
BANDS, AGREE, PRIME = 8, 2, 2**31 - 1
MULTIPLIERS = [pow(48271, i + 1, PRIME) for i in range(BANDS)]
#: Before the names of columns that are carried along, so that none clashes.
_KEEP = "__in_"


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_docs: int = 10
    copy_share: float = 0.5
    min_left: float = 0.5


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the base statistics and ``lines``, an array of (line, words)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.withColumn("__t", text)
    df = df.withColumn("__w", F.filter(F.split("__t", _SPACE), lambda w: w != ""))
    df = df.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: F.translate(x, _BLANKS, "") != ""))
    df = df.withColumn("n_words", F.size("__w").cast("long")).withColumn("__bits", F.length(F.bin("n_words")))
    window = "xxhash64(__w[i], __w[i + 1], __w[i + 2])"
    df = df.withColumn("__s", F.expr(f"CASE WHEN n_words >= 3 THEN sort_array(transform(sequence(0, CAST(n_words AS INT) - 3), i -> shiftleft({window}, __bits) | CAST(i AS BIGINT))) ELSE array() END"))
    df = df.withColumn("__mask", F.expr("shiftleft(CAST(1 AS BIGINT), __bits) - 1"))
    same = "(shiftright(x, __bits) = shiftright(get(__s, {o}), __bits) AND __w[CAST(x & __mask AS INT)] = __w[CAST(get(__s, {o}) & __mask AS INT)] AND __w[CAST(x & __mask AS INT) + 1] = __w[CAST(get(__s, {o}) & __mask AS INT) + 1] AND __w[CAST(x & __mask AS INT) + 2] = __w[CAST(get(__s, {o}) & __mask AS INT) + 2])"
    found = f"filter(__s, (x, j) -> coalesce({same.format(o='j - 1')}, false) OR coalesce({same.format(o='j + 1')}, false))"
    df = df.withColumn("__p", F.expr(f"sort_array(transform({found}, x -> x & __mask))"))
    df = df.withColumn("n_repeat_words", F.expr("aggregate(transform(__p, (p, j) -> least(CAST(3 AS BIGINT), coalesce(get(__p, j + 1) - p, CAST(3 AS BIGINT)))), CAST(0 AS BIGINT), (a, b) -> a + b)"))
    df = df.withColumn("word_chars", F.length(F.translate("__t", _BLANKS, "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length("__t") - F.length(F.translate("__t", _SYMBOLS, ""))).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    df = df.withColumn("__n", F.transform("__l", normalised))
    df = df.withColumn("__h", F.transform("__n", line_id))
    lines = "transform(__h, (h, j) -> named_struct('line', h, 'words', size(split(__n[j], ' '))))"
    df = df.withColumn("lines", F.expr(lines))
    return df.drop("__t", "__w", "__l", "__s", "__p", "__n", "__h", "__bits", "__mask")


def normalised(line: Column) -> Column:
    """Lower case; runs of white space are one blank; none at the ends."""
    return F.trim(F.lower(F.regexp_replace(line, _SPACE, " ")))


def line_id(line: Column) -> Column:
    """60 bits that know a normalised line, in which SQL engines agree."""
    return F.conv(F.left(F.md5(line), F.lit(15)), 16, 10).cast("long")


def least_lines(hits: DataFrame) -> DataFrame:
    """Rows (host, doc, band, least) of the lines (host, doc, line) that documents share."""
    x = F.pmod("line", F.lit(PRIME))
    least = hits.groupBy("host", "doc").agg(*[F.min((x * m) % PRIME).alias(f"b{i}") for i, m in enumerate(MULTIPLIERS)])
    return least.select("host", "doc", F.posexplode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("band", "least"))


def frequent_lines(measured: DataFrame, limits: Limits) -> DataFrame:
    """A stored table of the (host, line) above the limits, of rows (host, doc, lines)."""
    sets = measured.select("host", "doc", F.expr("array_distinct(transform(lines, l -> l.line))").alias("set"))
    sets = stored(sets.groupBy("host", "doc").agg(F.first("set").alias("set")))
    each = sets.select("host", "doc", F.explode("set").alias("line"))
    common = each.groupBy("host", "line").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(each.join(common, ["host", "line"]))
    hits = shared.filter(F.col("n") > limits.max_docs).drop("n")
    # only what holds a frequent line need be told from its copies
    bands = stored(least_lines(shared.join(hits.select("host", "doc").distinct(), ["host", "doc"], "left_semi")))
    firsts = bands.groupBy("host", "band", "least").agg(F.min("doc").alias("first"))
    pairs = bands.join(firsts, ["host", "band", "least"]).filter("doc != first")
    pairs = pairs.groupBy("host", "doc", "first").agg(F.count("*").alias("n")).filter(F.col("n") >= AGREE).drop("n")
    # a pair meets the two sets once
    met = pairs.join(sets, ["host", "doc"]).join(sets.select("host", F.col("doc").alias("first"), F.col("set").alias("other")), ["host", "first"])
    copies = met.filter(F.size(F.array_intersect("set", "other")) > limits.copy_share * F.greatest(F.size("set"), F.size("other")))
    copies = copies.groupBy("host", "doc").agg(F.min("first").alias("first"))
    counted = hits.join(copies, ["host", "doc"], "left").select("host", "line", F.least("doc", F.coalesce("first", "doc")).alias("first")).distinct()
    above = stored(counted.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > limits.max_docs).drop("n"))
    discard(sets, shared, bands)
    return above


def _keyed(docs: DataFrame, keep: list[str], host_col: str, text_col: str) -> DataFrame:
    """``keep`` under names that don't clash, with the text, its host and 128 bits that know it."""
    text = F.col(f"`{text_col}`")
    return docs.select(
        *[F.col(f"`{c}`").alias(_KEEP + c) for c in keep],
        F.coalesce(F.xxhash64(F.col(f"`{host_col}`")), F.lit(0)).alias("host"),
        text.alias("__text"),
        # 60 bits in which SQL engines agree give the order in which copies are looked for
        F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("long").alias("doc"),
        F.xxhash64(text).alias("doc2"),
    )


def _failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))


def rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """Statistics and verdict of every document: ``id_col``, the counts, ``base_failed``, ``kept``, ``removed_words``."""
    limits = limits or Limits()
    measured = statistics(_keyed(docs, [id_col], host_col, text_col), "__text").drop("__text", "doc2")
    measured = stored(measured.withColumn("row", F.monotonically_increasing_id()))
    each = measured.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.*")
    above = frequent_lines(measured, limits)
    hits = each.select("row", "host", "line", "words").join(above, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("removed_words"))
    measured = measured.withColumnRenamed(_KEEP + id_col, id_col)
    out = measured.drop("lines", "host", "doc").join(hits, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", _failed(limits))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= limits.min_left * F.col("n_words")))
    return out.select(F.col(f"`{id_col}`"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def cleaned(docs: DataFrame, host_col: str = "source", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """The documents that are kept, without the lines above the limits; same columns.

    Lines that go take their line feed along; a text without such lines is left
    as it is. A verdict depends on host and text alone, so verdicts are stored
    for distinct texts, only where something goes, and no text is stored twice.
    """
    limits = limits or Limits()
    keyed = _keyed(docs, docs.columns, host_col, text_col)
    # the counts of one text are equal, so any row may give them
    measured = statistics(keyed.select("host", "doc", "doc2", "__text"), "__text").groupBy("host", "doc", "doc2")
    measured = stored(measured.agg(*[F.first(c).alias(c) for c in ("n_words", "n_repeat_words", "lines")]))
    above = frequent_lines(measured, limits)
    each = measured.select("host", "doc", "doc2", F.explode("lines").alias("l")).select("host", "doc", "doc2", "l.*")
    hits = each.join(above, ["host", "line"]).groupBy("host", "doc", "doc2").agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed"))
    found = measured.drop("lines").join(hits, ["host", "doc", "doc2"], "left")
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    found = found.select("host", "doc", "doc2", (_failed(limits) | (left < limits.min_left * F.col("n_words"))).alias("goes"), "removed")
    found = stored(found.filter(F.col("goes") | F.col("removed").isNotNull()))
    discard(measured, above)
    # each line is dealt with by its own hash, so nothing but hashes was stored
    rest = keyed.drop("__text").join(found, ["host", "doc", "doc2"], "left").filter(~F.coalesce("goes", F.lit(False)))
    text = F.col(f"`{_KEEP}{text_col}`")
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains("removed", line_id(normalised(x))))
    rest = rest.withColumn(f"{_KEEP}{text_col}", F.when(F.col("removed").isNotNull(), F.array_join(kept, "\n")).otherwise(text))
    return rest.select(*[F.col(f"`{_KEEP}{c}`").alias(c) for c in docs.columns])
