"""Graph operators: connected components, families and reference edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import discard, stored

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label each vertex of ``edges`` with the smallest vertex it is connected to.

    Alternates large-star and small-star steps (each vertex links its larger,
    then its smaller neighbours to the smallest it knows) until the edges stop
    changing; they then form one star per component. The number of rounds grows
    with the logarithm of the longest chain. Edges stay distributed, each round
    is written to the shared folder, the round before is deleted, and only two
    numbers reach the driver. Vertices are best 64-bit numbers: others cost
    sorts where those are hashed.

    Returns ``(node, component)`` for every vertex of an edge. Self-loops and
    edges with a null end are ignored; repeated edges count once; an empty table
    gives no rows.
    """
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(now)
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # both sides of each join are stored, so a vertex with very many edges is split by the adaptive skew join
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stored(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        near = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, stored(near.union(small.select("u", F.col("m").alias("v"))).distinct())
        discard(last, least, large, small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.select(F.col("v").alias("node")).distinct()
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.union(roots.select("node", F.col("node").alias("component")))
        before = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def families(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each node's family (its smallest member), the family's size, and a split that keeps families whole."""
    from textloom.functions.text import sha_bucket

    found = connected_components(edges, src, dst).withColumnRenamed("component", "family")
    sizes = found.groupBy("family").agg(F.count("*").alias("family_size"))
    sizes = sizes.withColumn("split", F.when(sha_bucket(F.col("family")) == 0, "heldout").otherwise("train"))
    return found.join(sizes, "family").select("node", "family", "family_size", "split")


def reference_edges(entries: DataFrame, keys: DataFrame, kinds: list[str]) -> DataFrame:
    """One edge for each reference of each kind: src, src_plain, kind, dst_plain, dst_ids and resolved.

    ``entries`` has entry_id, plain and an array column of each kind; ``keys``
    has the trusted entries' entry_id and plain. Each edge holds all ids of its
    key; where many entries share a key, `counted_edges` doesn't repeat them.
    """
    from textloom.operators.relops import resolve_refs

    return resolve_refs(_references(entries, kinds), "dst_plain", keys, "plain", "entry_id")


def _references(entries: DataFrame, kinds: list[str], plain: str = "plain") -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, [entries.select(F.col("entry_id").alias("src"), F.col(plain).alias("src_plain"), F.lit(k).alias("kind"), F.explode(k).alias("dst_plain")) for k in kinds])


def counted_edges(entries: DataFrame, keys: DataFrame, kinds: list[str], plain: str = "plain") -> DataFrame:
    """The same edges, from each entry to a key, with the number of its ``targets``: src, src_plain, kind, dst_plain, targets and resolved.

    ``keys`` itself tells which ids a key has, so edges and keys together are the
    whole graph, in as many rows as there are references and entries: n entries
    that refer to a key of m entries are n + m rows, not n * m ids.
    """
    counts = keys.filter("plain IS NOT NULL").groupBy(F.col("plain").alias("__key")).agg(F.count("entry_id").alias("targets"))
    edges = _references(entries, kinds, plain)
    met = edges.join(counts, edges["dst_plain"] == F.col("__key"), "left")
    return met.select("src", "src_plain", "kind", "dst_plain", F.coalesce("targets", F.lit(0).cast("long")).alias("targets"), F.col("__key").isNotNull().alias("resolved"))


def equivalent_edges(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """One edge for each attested form of an English entry and each entry that has it."""
    forms = entries.select(F.col("entry_id").alias("src"), F.col("english").alias("src_plain"), F.explode("attested_forms").alias("dst_plain"))
    ids = keys.select(F.col("plain").alias("dst_plain"), F.col("entry_id").alias("dst"))
    return forms.join(ids, "dst_plain").select("src", "src_plain", F.lit("english_equivalent").alias("kind"), "dst_plain", F.array("dst").alias("dst_ids"), F.lit(True).alias("resolved"))
