"""Source divergence audit: how far the sources of a language part in their words.

Terms are runs of letters and of characters beyond ASCII, A to Z lower-cased. A
language keeps the terms that occur in at least ``min_docs`` of its documents.
Each group (language, source), and each language, gives a kept term the integer
share ``p = 1 + floor(SCALE * (count + 2) / (N + 2 V))``: N is the group's
count over kept terms, V the number of kept terms. Two shares differ by
``f = floor((p - q)^2 / (p + q))``.

The sum of f over all V terms is never taken term by term. A share depends on
nothing but the count, so for each pair of sources the distinct combinations
(count here, count there) are tallied and f is evaluated once a combination,
times how many terms have it. Only terms that both sources have are met in a
join; cells with a zero are implied: the terms with count c here and none there
are those with c here less those that were met, and the terms that neither has
are V less both, plus those met. All of this is one sum of signed tallies.

Counting runs in Arrow batches (a bounded table of terms a task, flushed when
full); what is shuffled are partial counts. A term's sources are gathered in
blocks of ``BLOCK`` numbered sources, and blocks are joined with blocks, so no
row holds more than a block and no task more than its share; the result itself
has a row for each pair of sources of a language. Products are decimals of 38
digits; nothing is rounded.

Defined cases: null text, language and source count as ''; a group without
terms is there, with N = 0; a language that keeps no term gives 0 for each
pair; repeated rows are documents of their own; a language with one source has
no pairs; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import spread, stored

SCALE = 1_000_000_000
MIN_DOCS, TOP_TERMS = 10, 10
#: Sources that are gathered in one row; a joined row makes at most the square of it.
BLOCK = 64
#: Entries of a task's table of counts before it is flushed.
ENTRIES = 200_000
#: Bytes of a text: A to Z to lower case, other letters and bytes beyond ASCII as they are, the rest to blanks.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_BYTES).split()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences and documents of each term; the term '' stands for the group itself."""
    said = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))

    def rows(groups: dict) -> pa.RecordBatch:
        lang, source, term, n, d = [], [], [], [], []
        for (a, b), (count, held) in groups.items():
            lang += [a] * (len(count) + 1)
            source += [b] * (len(count) + 1)
            term += [b"", *count]
            n += [0, *count.values()]
            d += [0, *map(held.__getitem__, count)]
        cols = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                count, held = groups.setdefault((lang, source), (Counter(), Counter()))
                found, before = terms_of(text), len(count)
                count.update(found)
                held.update(set(found))
                size += 1 + len(count) - before
                if size > ENTRIES:
                    yield rows(groups)
                    groups, size = {}, 0
        if groups:
            yield rows(groups)

    part = spread(said).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, v: str = "v") -> Column:
    """A term's integer share by its count, the group's total and the number of kept terms; products beyond 64 bits are decimals."""
    small = f"{SCALE}L * ({count} + 2) div nullif({total} + 2 * {v}, 0)"
    large = f"CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(20, 0)) div nullif(CAST({total} + 2 * {v} AS DECIMAL(20, 0)), 0)"
    return F.expr(f"1 + CASE WHEN {count} < {2**63 // SCALE - 2} THEN {small} ELSE {large} END")


def apart(p: str, q: str) -> Column:
    """How far two shares are apart."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _blocks(groups: DataFrame) -> DataFrame:
    """Every pair of a language's groups once, smaller number first; blocks meet blocks."""
    last = F.floor((F.col("sources") - 1) / BLOCK)
    own = F.floor((F.col("no") - 1) / BLOCK)
    a = groups.select("lang", "v", F.col("no").alias("a"), F.col("total").alias("na"), own.alias("i"), F.explode(F.sequence(own, last)).alias("j"))
    b = groups.select("lang", F.col("no").alias("b"), F.col("total").alias("nb"), F.explode(F.sequence(F.lit(0).cast("long"), own)).alias("i"), own.alias("j"))
    return a.join(b, ["lang", "i", "j"]).filter(F.col("a") < F.col("b")).drop("i", "j")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: other sources by how far they are, and each group's most overused terms."""
    counts = stored(term_counts(docs, lang_col, source_col, text_col))
    real = counts.filter("term != ''")
    kept = stored(real.groupBy("lang", "term").agg(F.sum("n").alias("c"), F.sum("docs").alias("d")).filter(F.col("d") >= min_docs).drop("d"))
    langs = counts.groupBy("lang").agg(F.countDistinct("source").alias("sources"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("c").alias("all")), "lang", "left").fillna(0, ["v", "all"])
    held = stored(real.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "c"))
    groups = counts.filter("term = ''").select("lang", "source").join(held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own")), ["lang", "source"], "left")
    groups = groups.fillna(0, ["total", "own"]).join(langs, "lang")
    # a row for each source: the window sees no more than the result's rows of one source
    groups = stored(groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")))

    terms = held.join(groups.select("lang", "source", "total", "v", "all"), ["lang", "source"])
    terms = terms.withColumn("p", share("n", "total")).withColumn("q", share("c", "`all`")).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    pairs = stored(_blocks(groups))
    far = _distances(held, groups, pairs).select("lang", "a", "b", "value")
    names = groups.select("lang", "no", "source")
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = far.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.*", "value")
    both = both.join(names.withColumnRenamed("no", "a"), ["lang", "a"])
    both = both.join(names.select("lang", F.col("no").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return both.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def joint_counts(held: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, a, b, ca, cb, m): how many terms both sources have, by their two counts."""
    told = held.join(groups.select("lang", "source", "no"), ["lang", "source"])
    told = told.groupBy("lang", "term", F.floor((F.col("no") - 1) / BLOCK).alias("i")).agg(F.collect_list(F.struct("no", "n")).alias("xs"))
    met = told.join(told.select("lang", "term", F.col("i").alias("j"), F.col("xs").alias("ys")), ["lang", "term"]).filter(F.col("i") <= F.col("j"))
    met = met.select("lang", F.explode("xs").alias("x"), "ys").select("lang", "x", F.explode("ys").alias("y")).filter("x.no < y.no")
    met = met.select("lang", F.col("x.no").alias("a"), F.col("y.no").alias("b"), F.col("x.n").alias("ca"), F.col("y.n").alias("cb"))
    return met.groupBy("lang", "a", "b", "ca", "cb").agg(F.count("*").alias("m"))


def _distances(held: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with the sum of f over all kept terms."""
    joint = stored(joint_counts(held, groups))
    zero, ca, cb, m = F.lit(0).cast("long"), F.col("ca"), F.col("cb"), F.col("m")
    # a source's own histogram: how many terms it has by count
    own = stored(held.join(groups.select("lang", "source", "no"), ["lang", "source"]).groupBy("lang", "no", "n").agg(F.count("*").alias("m")))
    keys = ["lang", "a", "b"]
    sizes = groups.select("lang", "no", "own")
    neither = pairs.join(sizes.select("lang", F.col("no").alias("a"), F.col("own").alias("va")), ["lang", "a"]).join(sizes.select("lang", F.col("no").alias("b"), F.col("own").alias("vb")), ["lang", "b"])
    cells = [
        # a term that was met is in none of the three cells with a zero
        joint.select(*keys, F.explode(F.array(*[F.struct(x.alias("ca"), y.alias("cb"), m.alias("m")) for x, y, m in ((ca, cb, m), (ca, zero, -m), (zero, cb, -m), (zero, zero, m))])).alias("x")).select(*keys, "x.*"),
        pairs.select(*keys).join(own.select("lang", F.col("no").alias("a"), F.col("n").alias("ca"), "m"), ["lang", "a"]).select(*keys, "ca", zero.alias("cb"), "m"),
        pairs.select(*keys).join(own.select("lang", F.col("no").alias("b"), F.col("n").alias("cb"), "m"), ["lang", "b"]).select(*keys, zero.alias("ca"), "cb", "m"),
        neither.select(*keys, zero.alias("ca"), zero.alias("cb"), (F.col("v") - F.col("va") - F.col("vb")).alias("m")),
    ]
    tally = cells[0]
    for more in cells[1:]:
        tally = tally.unionByName(more)
    tally = tally.groupBy(*keys, "ca", "cb").agg(F.sum("m").alias("m")).filter("m != 0").join(pairs, keys)
    tally = tally.withColumn("p", share("ca", "na")).withColumn("q", share("cb", "nb"))
    sums = tally.groupBy(*keys).agg(F.sum(F.col("m") * apart("p", "q")).alias("value"))
    return pairs.join(sums, keys, "left").fillna(0, ["value"])
