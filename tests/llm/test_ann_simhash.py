from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from helpers import DOCS, ODD, WORD, docs, low
from pyspark.sql import functions as F

from textloom.llm import ann, simhash

VECS = "vec_id long, embedding array<float>, label int"


def brute(rows, query, top=20):
    q = np.array(query[1], float)
    scored = [(-float(np.array(v, float) @ q), i) for i, v in rows if i != query[0]]
    return [i for _, i in sorted(scored)[:top]]


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECS).repartition(3)
    out = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x *= rng.uniform(0.5, 2.0, size=(3000, 1)).astype(np.float32)  # inner product, not angle
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(spark, rows)
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, near in got.items():
        want = brute(rows, rows[q])
        hits += len(set(want) & {i for _, i, _ in near})
        assert [r for r, _, _ in near] == list(range(1, 21)) and q not in {i for _, i, _ in near}
        assert all(abs(s - float(x[i].astype(float) @ x[q].astype(float))) < 1e-9 for _, i, s in near)
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)
    assert hits / (20 * len(got)) >= 0.9


def test_work_and_recall_at_two_sizes():
    """Points looked at by a query stay below all points, at a recall of nine in ten and more, with leaves that grow with them."""
    rng = np.random.default_rng(4)
    for n in (6000, 24_000):
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        forest = ann.grow(x[: 1 << 13], 1.0, leaves=n // ann.LEAF_POINTS)
        leaves = forest.leaves(x)
        sizes = np.array([np.bincount(own, minlength=1 << forest.depth) for own in leaves])
        hits = work = 0
        for q in range(40):
            seen = forest.visits(x[q], max(ann.VISITS * n, ann.LEAST_POINTS), sizes)
            work += sum(sizes[t, leaf] for t, leaf in seen)
            found = set(np.concatenate([np.flatnonzero(leaves[t] == leaf) for t, leaf in seen]).tolist())
            hits += len(found & set(np.argsort(-(x @ x[q]))[:21].tolist()))
        assert work < 40 * n * 1.05 and hits >= 0.9 * 40 * 21 and forest.depth == int(np.log2(n // ann.LEAF_POINTS))


def test_leaves_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_POINTS", 7)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    for q, near in found(spark, rows, leaf_points=40).items():
        assert [i for _, i, _ in near] == brute(rows, rows[q])


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], 0, 0, "x") for i in range(30)], "q long, points array<double>, leaf int, score int, items string")
    got = ann.nearest(df, F.col("q") == 0, "q", "points")
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 20


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    some = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    same = [(100 + i, [1.0] * 8) for i in range(90)]
    bad = [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] + [1.0] * 7), (504, [float("inf")] * 8), (505, [1.0, 2.0]), (520, None)]
    rows = some + same
    got = found(spark, [*rows, *bad, some[3]], visits=20)  # every leaf: exact
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    for q, near in got.items():
        assert [i for _, i, _ in near] == brute(rows, next(r for r in rows if r[0] == q))
    assert found(spark, []) == {} and found(spark, bad) == {}
    assert found(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])]) == {0: [(1, 1, 0.5)]}


def test_queue_is_best_first():
    rng = np.random.default_rng(3)
    forest = ann.grow(rng.normal(size=(600, 6)), 4.0, trees=3, leaves=8)
    q = rng.normal(size=6)
    seen = forest.visits(q, 24)
    assert sorted(seen) == [(t, leaf) for t in range(3) for leaf in range(8)]
    assert {t for t, _ in seen[:3]} == {0, 1, 2}
    unit = np.append(q / np.linalg.norm(q), 0.0)

    def far(tree, leaf):
        node, worst = leaf + 7, 0.0
        while node:
            up = (node - 1) // 2
            d = forest.planes[tree, up] @ unit - forest.cuts[tree, up]
            if (node == 2 * up + 2) != (d > 0):
                worst = max(worst, abs(d))
            node = up
        return worst

    order = [far(*s) for s in seen]
    assert order == sorted(order)


def plain_fingerprint(text):
    w = WORD.findall(low(text))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(fps, bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= bits:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_groups(spark):
    rng = random.Random(4)
    texts = list(ODD)
    for _ in range(25):
        w = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(2, 400))]
        for _ in range(rng.randint(1, 5)):
            v = list(w)
            v[rng.randrange(len(v))] = "zz"
            texts.append(" ".join(v))
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_groups(fps, 4)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert len(set(want)) < len(set(fps)) < len(texts)


def test_covering_and_forest():
    for bits in range(8):
        family = simhash.covering(bits)
        assert all(any(set(c) <= set(s) for c in family) for s in combinations(range(8), 8 - bits))
    pairs = [p for c in simhash.triples(24) for p in combinations(c, 2)]
    assert len(pairs) == len(set(pairs)) >= 3 * 80
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    fps = np.unique(np.array([s ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (2**64 - 1) for s in seeds for _ in range(60)], np.uint64))
    u, v = simhash.forest(np.zeros(len(fps), np.int64), np.arange(len(fps)), fps.reshape(-1, 1), 4, 4)
    want = plain_groups(fps.tolist(), 4)
    assert len(u) == len(fps) - len(set(want)) and all(want[x] == want[y] for x, y in zip(u, v, strict=True))


def test_forest_is_lightest(monkeypatch):
    """Weights of the forest against Kruskal's, links thinned on the way or not."""
    rng = np.random.default_rng(7)
    for held in (1 << 20, 40):
        monkeypatch.setattr(simhash, "HELD", held)
        fps = rng.integers(0, 2**14, size=(90, 1), dtype=np.uint64)
        bits = lambda i, j: bin(int(fps[i, 0] ^ fps[j, 0])).count("1")  # noqa: E731, B023
        lists = np.repeat([0, 1, 2], [1, 29, 60])
        u, v = simhash.forest(lists, np.arange(90), fps, 0, 5)
        parent, want = list(range(90)), []
        for w, i, j in sorted((bits(i, j), i, j) for i, j in combinations(range(90), 2) if lists[i] == lists[j] and bits(i, j) <= 5):
            a, b = i, j
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[a] = b
                want.append(w)
        assert sorted(bits(i, j) for i, j in zip(u, v, strict=True)) == want


def joined(n, rows):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        parent[find(r["src"])] = find(r["dst"])
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("rows", [1 << 16, 100])
def test_big_lists_split(spark, monkeypatch, rows):
    """A list of several blocks, and lists that go on over Arrow batches and looks."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "ROWS", rows)
    rng = random.Random(6)
    fps = list({0x1234567890ABCDEF ^ (rng.getrandbits(12)) for _ in range(300)})
    df = spark.createDataFrame([(i, [f]) for i, f in enumerate(fps)], "vid long, fp array<long>")
    want = plain_groups(fps, 4)
    assert len(set(joined(len(fps), simhash.links(df).collect()))) == len(set(want))


def test_wide_fingerprints(spark):
    """Two words: nearly all pairs within 11 bits meet; none beyond the total is linked."""
    rng = random.Random(8)
    seeds = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(12)]
    wide = {tuple(w ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for w in s) for s in seeds for _ in range(20)}
    wide = [[x - (1 << 64) * (x >> 63) for x in f] for f in sorted(wide)]
    df = spark.createDataFrame(list(enumerate(wide)), "vid long, fp array<long>")
    bits = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(wide[a], wide[b], strict=True))
    rows = simhash.links(df, 2, 5, 11).collect()
    assert all(bits(r["src"], r["dst"]) <= 11 for r in rows)
    root = joined(len(wide), rows)
    assert all(root[a] == root[b] for a, b in combinations(range(len(wide)), 2) if bits(a, b) <= 11)


def test_recall_and_precision_of_exact_links(spark):
    """Pairs of a similarity of 0.8 and more by five-word shingles: at least nine in ten share a group, and no group has others."""
    rng, texts = random.Random(9), []
    for _ in range(120):
        w = [str(rng.randrange(5000)) for _ in range(rng.randint(40, 400))]
        texts.append(w)
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randint(0, len(w) // 35)):
                v[rng.randrange(len(v))] = str(rng.randrange(5000))
            texts.append(v)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for k in range(0, len(sets), 5) for a, b in combinations(range(k, k + 5), 2)}
    pairs = [p for p, j in alike.items() if j >= 0.8]
    edge = [p for p in pairs if alike[p] < 0.9]
    df = docs(spark, [" ".join(w) for w in texts] + [None, "", " "])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, words=5, width=3, total_bits=40, similarity=0.8).collect()}
    assert len(edge) > 100 and sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs) and sum(got[a] == got[b] for a, b in edge) >= 0.9 * len(edge)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(b)] = find(a)
    assert all(find(a) == find(b) for a, b in alike if got[a] == got[b])
    assert {got[len(texts) + k] for k in range(3)} == {len(texts)}


@pytest.mark.parametrize("similarity, block", [(0.8, 1024), (0.8, 3), (0.55, 1024)])
def test_no_similar_pair_is_left_out(spark, monkeypatch, similarity, block):
    """Groups are those of all pairs of sets so similar: at the bound, of few words, of common passages, of one set with other repeats."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SAMPLE", 2)
    rng, texts = random.Random(12), ["a b c d e", "a b c d e a b c d e a b c d e a", "a b c d e a b c d e"]
    passage = [f"p{k}" for k in range(30)]
    for k in range(160):
        w = [str(rng.randrange(5000)) for _ in range(rng.randint(5, 150))] + passage * (k % 3 == 0)
        texts.append(w)
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(0, 1 + len(w) // 45)):
                v[rng.randrange(len(v))] = str(rng.randrange(5000))
            texts.append(v[: len(v) - rng.randint(0, len(v) // 12)])
    texts = [" ".join(t) if isinstance(t, list) else t for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    alike = [{"src": a, "dst": b} for a, b in combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    root = joined(len(texts), alike)
    first = {r: i for i, r in reversed(list(enumerate(root)))}
    got = simhash.near_duplicates(docs(spark, texts), words=5, width=3, total_bits=40, similarity=similarity).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: first[r] for i, r in enumerate(root)}
    assert 100 < len(first) < len(texts) - 60


def test_sketch_slices(monkeypatch):
    """Borders of the slices in which shingles are hashed, and a text above a megabyte."""
    text = " ".join(str(i * i % 977) for i in range(300_000))
    texts = [None, "a b", text, "", "a b c d e f", " ".join(text.split()[:900])]
    whole = simhash.sketches(texts, 4, 2, True)
    assert len(text) > 1 << 20
    assert [len(set(simhash.sketches([t], 4, 1, True)[2].tolist())) for t in texts] == whole[3].tolist()
    monkeypatch.setattr(simhash, "_STEP", 1000)
    parts = simhash.sketches(texts, 4, 2, True)
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))
    short = " ".join(text.split()[:2500])
    monkeypatch.setattr(simhash, "_STEP", 7)
    assert simhash.fingerprint(short) == [plain_fingerprint(short)]


def test_clashing_columns(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f"]).withColumnRenamed("source", "fp").withColumnRenamed("lang", "fingerprint").withColumnRenamed("n_chars", "Text2")
    assert {r["component_id"] for r in simhash.near_duplicates(df).collect()} == {0}
    assert {r["component_id"] for r in simhash.near_duplicates(df.withColumnRenamed("doc_id", "row"), "row", similarity=0.8).collect()} == {0}


def test_empty_and_repeats(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(twice).collect()) == [(1, 1), (1, 1), (2, 2), (3, 2)]


def test_counts_leave_no_similar_sets_out():
    rng = np.random.default_rng(8)

    def counts(x):
        return np.bincount(x & (simhash.COUNTS - 1), minlength=simhash.COUNTS).clip(max=255).astype(np.uint8)

    told = []
    # the last one's counts pass 255
    for size, mask in [(1, -1), (9, -1), (500, -1), (4000, -1), (4000, ~1023)]:
        for part in (0, 0.02, 0.1, 0.11, 0.12, 0.5, 1):
            a = np.unique(rng.integers(0, 1 << 30, size) & mask)
            b = np.union1d(a[int(part * len(a)) :], rng.integers(0, 1 << 30, int(part * len(a))) & mask)
            common, n = len(np.intersect1d(a, b)), len(a) + len(b)
            kept = bool(simhash.within(counts(a)[None], counts(b)[None], np.array([n]), 0.8)[0])
            told.append((size, part, common >= 0.8 * (n - common), kept))
            assert kept or not told[-1][2]
    # large sets that share little are told apart, as parities don't
    assert (4000, 1, False, False) in told and (4000, 0.5, False, False) in told
