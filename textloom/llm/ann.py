"""Approximate nearest neighbours: a forest of random-projection trees.

A tree splits its points by random projections at their medians. Trees are
fitted on a bounded sample of the vectors and broadcast; every vector is routed
to one leaf of each tree. Leaves grow in number with the vectors, as far as the
sample can tell them apart. A query walks all trees at once: a priority queue,
shared by the trees, holds the branches not taken, ordered by how far the query
lies on their wrong side, and gives the next leaf to visit until the leaves seen
hold a share of the points, and some thousands at least: few points are all
looked at. All vectors of the visited leaves are candidates and are ranked by
their exact inner product in double precision.

For inner products of vectors of any length, points get one more component that
makes all norms equal; for unit vectors it is zero.

Leaves and the queries that visit them meet in blocks of bounded size, joined
on (tree, leaf, block of points) and multiplied as matrices, so a leaf of any
size is dealt over many tasks. Visits come in two rounds: the first
leaf of each tree gives each query a bound, and later leaves return only what
reaches it.

Equal vectors are one point, represented by its smallest ids, so copies neither
fill a leaf nor repeat a query's work.

Defined cases: vectors that are null, zero, or hold null or non-finite
components, or have another length than most, take no part; rows with one id
are one another's own; ties go to the smaller id; an empty table gives no rows;
other columns don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import stored

TREES = 3
#: About the points of a leaf.
LEAF_POINTS = 256
#: Points that a query's leaves hold, over all trees, as a share of all points: under 1, so a query
#: costs less than a search of everything. Vectors without any cluster need about this much for
#: nine in ten neighbours in 64 dimensions; clustered ones need far less.
VISITS = 0.98
#: A query's leaves hold so many points at least.
LEAST_POINTS = 4096
#: The fit reads about so many vectors at most; a leaf has 8 of them at least.
FIT_ROWS = 1 << 17
TOP = 20
BLOCK_POINTS, BLOCK_QUERIES = 2048, 1024


@dataclass
class Forest:
    depth: int
    scale: float  # the largest norm
    planes: np.ndarray  # trees x nodes x components
    cuts: np.ndarray  # trees x nodes

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Points with equal norms."""
        unit = x / self.scale
        rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
        return np.column_stack([unit, rest])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """trees x points: the leaf of each point."""
        x, first = self.lifted(x), (1 << self.depth) - 1
        out = []
        for planes, cuts in zip(self.planes, self.cuts, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, planes[node]) > cuts[node]
                node = 2 * node + 1 + side
            out.append(node - first)
        return np.array(out)

    def visits(self, q: np.ndarray, most: float, sizes: np.ndarray | None = None) -> list[tuple[int, int]]:
        """The first (tree, leaf) of the shared priority queue until they hold ``most`` points by ``sizes`` (trees x leaves; without them, each counts 1)."""
        unit = np.append(q / np.linalg.norm(q), 0.0)
        sides = (self.planes @ unit - self.cuts).tolist()
        first, trees = (1 << self.depth) - 1, len(self.planes)
        queue = [(0.0, t, 0) for t in range(trees)]
        out, held = [], 0
        while queue and held < most:
            far, tree, node = heapq.heappop(queue)
            side = sides[tree]
            while node < first:
                d = side[node]
                near = 2 * node + (2 if d > 0 else 1)
                other = 2 * node + (1 if d > 0 else 2)
                heapq.heappush(queue, (max(far, abs(d)), tree, other))
                node = near
            out.append((tree, node - first))
            held += 1 if sizes is None else int(sizes[tree, node - first])
        return out


def grow(sample: np.ndarray, scale: float, trees: int = TREES, leaves: int = 64, seed: int = 7) -> Forest:
    """Fit on a sample: as deep as ``leaves`` need, with 8 sample rows a leaf at least."""
    depth = min(int(np.log2(max(1, leaves))), int(np.log2(max(1, len(sample) / 8))))
    nodes, rng = max(1, (1 << depth) - 1), np.random.default_rng(seed)
    made = Forest(depth, scale, np.zeros((trees, nodes, sample.shape[1] + 1)), np.zeros((trees, nodes)))
    x = made.lifted(sample)
    for t in range(trees):
        at = np.zeros(len(x), np.int64)
        for node in range((1 << depth) - 1):
            plane = rng.normal(size=x.shape[1])
            plane /= np.linalg.norm(plane)
            own = np.flatnonzero(at == node)
            values = x[own] @ plane
            cut = float(np.median(values)) if len(own) else 0.0
            made.planes[t, node], made.cuts[t, node] = plane, cut
            at[own] = 2 * node + 1 + (values > cut)
    return made


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0)


def _blocks(rows: DataFrame, keys: list[str], item: str, most: int, item_id: str) -> DataFrame:
    """Items of a key in blocks ``b`` of about ``most``."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    dealt = rows.join(sizes, keys).withColumn("b", F.pmod(F.xxhash64(item_id), F.ceil(F.col("__n") / most)).cast("int"))
    return dealt.groupBy(*keys, "b").agg(F.collect_list(item).alias("items"))


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, trees: int = TREES, leaf_points: int = LEAF_POINTS, visits: float = VISITS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The ``top`` nearest found of each query: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("is_query"))
    rows = rows.filter(F.col("id").isNotNull() & _usable(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 1
    # a vector is known by 128 bits
    rows = rows.filter(F.size("vec") == dim).withColumn("a", F.xxhash64("vec")).withColumn("b", F.xxhash64(F.lit(1), F.reverse("vec")))
    same = Window.partitionBy("a", "b").orderBy("id")
    # of equal vectors, only the smallest ids can be among the nearest of any query
    kept = rows.select("id", "vec", "a", "b").dropDuplicates(["id", "a", "b"]).withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= top + 1)
    kept = stored(kept)
    points = kept.filter("nth = 1").select("id", "vec", "a", "b")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    n, scale = points.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return spark.range(0).select(F.col("id").alias("query_id"), F.col("id").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    # below a bound on the whole range of 64-bit hashes, so any number of points gives its sample
    below = min((1 << 63) - 1, -(1 << 63) + int(min(1.0, fit_rows / n) * 2**64))
    sample = points.filter(F.xxhash64("id", F.lit("fit")) <= F.lit(below)).select("id", "vec").toArrow()
    at = np.argsort(sample.column("id").to_numpy())
    forest = grow(_matrix(sample.column("vec").combine_chunks(), dim)[at], scale * (1 + 1e-12), trees, n // leaf_points)
    sent = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = sent.value.leaves(_matrix(batch.column(1), dim))
            for tree, own in enumerate(leaves):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(own), tree), pa.int32()), pa.array(own, pa.int32())], ["id", "vec", "tree", "leaf"])

    posted = points.select("id", "vec").mapInArrow(route, "id long, vec array<double>, tree int, leaf int")
    posted = _blocks(posted.withColumn("p", F.struct("id", "vec")), ["tree", "leaf"], "p", BLOCK_POINTS, "id").withColumnRenamed("items", "points")
    posted = stored(posted)
    # a row for each leaf: bounded by the sample of the fit
    held = posted.groupBy("tree", "leaf").agg(F.sum(F.size("points")).alias("n"), (F.max("b") + 1).alias("blocks"))
    sizes = np.zeros((trees, 1 << forest.depth), np.int64)
    for r in held.collect():
        sizes[r["tree"], r["leaf"]] = r["n"]
    known = spark.sparkContext.broadcast(sizes)
    most = max(visits * n, LEAST_POINTS)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            for r, q in enumerate(x):
                seen = np.array(sent.value.visits(q, most, known.value), np.int32)
                k = pa.array(np.full(len(seen), r), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(k), batch.column(1).take(k), pa.array(seen[:, 0]), pa.array(seen[:, 1]), pa.array(np.arange(len(seen)), pa.int32())], ["q", "vec", "tree", "leaf", "nth"])

    queries = rows.filter("is_query").select("id", "a", "b").distinct()
    asked = points.join(queries.select("a", "b").distinct(), ["a", "b"], "left_semi").select("id", "vec")
    probes = asked.repartition(F.col("id")).mapInArrow(walk, "q long, vec array<double>, tree int, leaf int, nth int")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                p, q = batch.column(0)[r].values, batch.column(1)[r].values
                ids, qs, least = p.field(0).to_numpy(), q.field(0).to_numpy(), q.field(2).to_numpy()
                scores = _matrix(q.field(1), dim) @ _matrix(p.field(1), dim).T
                out_q, out_id, out_s = [], [], []
                for i in range(len(qs)):
                    s = scores[i]
                    own = np.flatnonzero(s >= least[i])
                    if len(own) > top + 1:
                        own = own[np.lexsort((ids[own], -s[own]))[: top + 1]]
                    out_q.append(np.full(len(own), qs[i]))
                    out_id.append(ids[own])
                    out_s.append(s[own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_id, out_s)], ["q", "id", "score"])

    def found(visiting: DataFrame) -> DataFrame:
        asking = _blocks(visiting.withColumn("p", F.struct("q", "vec", "least")), ["tree", "leaf"], "p", BLOCK_QUERIES, "q").select("tree", "leaf", F.col("items").alias("queries"))
        asking = asking.join(F.broadcast(held.select("tree", "leaf", "blocks")), ["tree", "leaf"])
        asking = asking.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        met = posted.join(asking, ["tree", "leaf", "b"]).select("points", "queries")
        return met.mapInArrow(ranked, "q long, id long, score double").groupBy("q", "id").agg(F.max("score").alias("score"))

    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    probes = stored(probes)
    early = found(probes.filter(F.col("nth") < trees).withColumn("least", F.lit(float("-inf"))))
    early = stored(early.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= top + 1).drop("nth"))
    bound = early.groupBy("q").agg(F.when(F.count("*") > top, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
    late = found(probes.filter(F.col("nth") >= trees).join(bound, "q"))
    both = early.unionByName(late).groupBy("q", "id").agg(F.max("score").alias("score"))
    both = both.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= top + 1).drop("nth")

    # back from points to rows: each point's smallest ids, then each query's own list without itself
    copies = kept.join(points.select(F.col("id").alias("point"), "a", "b"), ["a", "b"]).select("point", F.col("id").alias("vec_id"), "a", "b")
    listed = both.join(copies.select(F.col("point").alias("id"), "vec_id"), "id")
    lists = listed.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, top + 1).alias("near"))
    of_point = copies.select(F.col("point").alias("q"), "a", "b").distinct().join(lists, "q").select("a", "b", "near")
    out = queries.join(of_point, ["a", "b"]).withColumn("near", F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("id")), 1, top))
    out = out.select(F.col("id").alias("query_id"), F.posexplode("near").alias("pos", "s"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("vec_id"), (-F.col("s.far")).alias("score"))
