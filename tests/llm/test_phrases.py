"""Phrase collocation mining against a plain version."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DOCS, ODD, low

from textloom.llm import phrases as P


def plain(rows, min_count, max_words=5, top=2000):
    """Every phrase of every piece, counted as it is."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, count in f.items():
        frequent = {w: a for w, a in count.items() if a >= min_count}
        inside = {(w[i : i + m], a) for w, a in frequent.items() for m in range(2, len(w)) for i in range(len(w) - m + 1)}
        found = []
        for w, a in frequent.items():
            if len(w) > 1 and (w, a) not in inside:
                score, _, l, r = min((1000 * a * n[lang] // (count[w[:j]] * count[w[j:]]), j, count[w[:j]], count[w[j:]]) for j in range(1, len(w)))
                found.append((score, a, " ".join(w), l, r))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, w, a, l, r, n[lang], s) for i, (s, a, w, l, r) in enumerate(found[:top])]
    return sorted(out)


def made(n=300):
    rng = random.Random(13)
    words = ["a", "B", "b", "été", "中", "x\x1cy", "\x85", "\x00", "New", "York", "city", "of", "a-b"]
    fixed = ["New York city of dreams", "b b b b b", "a b a b a b", "of the people by the people"]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(p + rng.choice([". ", " ", "\t", "\n", ",", ";:", "\r\n", "  ", "! ?"]) for p in parts), rng.choice(["en", "en", "de", None]), "s", 0))
    return rows + [(900 + i, t, "en", "s", 0) for i, t in enumerate(ODD)] + rows[:20] + [(None, None, None, None, None)]


def shown(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("block,opened,piece", [(1 << 18, 1 << 21, 1 << 20), (20, 60, 16)])
def test_equals_plain(spark, monkeypatch, block, opened, piece):
    # tasks see these only where they are sent along
    monkeypatch.setattr(P, "BLOCK_WORDS", block)
    monkeypatch.setattr(P, "OPEN_WORDS", opened)
    monkeypatch.setattr(P, "SLICE", piece)
    rows = made()
    got = shown(P.collocations(spark.createDataFrame(rows, DOCS).repartition(3), min_count=12))
    assert got == plain(rows, 12)
    assert len({r[0] for r in got}) == 3 and max(len(r[2].split(" ")) for r in got) == 5


def test_few_words_and_clashing_columns(spark):
    rows = made(120)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS block", "2 AS seq", "3 AS n", "4 AS left", "5 AS words", "6 AS rank")
    assert shown(P.collocations(docs, min_count=5, max_words=3, top=7)) == plain(rows, 5, 3, 7)


def test_no_rows(spark):
    assert P.collocations(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, f"one{i} two{i}", "en", "s", 0) for i in range(5)]
    assert P.collocations(spark.createDataFrame(rows, DOCS), min_count=3).count() == 0


def test_texts_are_split_in_parts():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", " ", "  ", ".", "\n", "x" * 50]) for _ in range(200)).encode().translate(P._BYTES)
        parts = list(P.slices(text))
        assert b"".join(p for p, _ in parts) == text
    P_slice, P.SLICE = P.SLICE, 16
    try:
        parts = list(P.slices(text))
        assert len(parts) > 3 and b"".join(p for p, _ in parts) == text
        words = [w for p, _ in parts for w in p.replace(b"\n", b" \n ").split(b" ") if w]
        assert words == [w for w in text.replace(b"\n", b" \n ").split(b" ") if w]
    finally:
        P.SLICE = P_slice


def test_gaps_of_pairs():
    seq = np.array([0, 1, 0, 1, -1, 1, 2, 0, 0, 0], np.int32)
    got, left, right, n = P.paired(seq, np.array([0, 1], np.int32), np.array([70, 71]))
    told = [(int(left[c]), int(right[c])) if c >= 0 else None for c in got]
    assert told == [(70, 71), (71, 70), (70, 71), None, (70, 70), (70, 70)]
    assert dict(zip(zip(left.tolist(), right.tolist(), strict=True), n.tolist(), strict=True)) == {(70, 71): 2, (71, 70): 1, (70, 70): 2}


def test_products_beyond_64_bits_are_exact(spark):
    cases = [(100, 10**16, 100, 100), (10**15 + 7, 10**16 + 1, 10**15 + 9, 10**15 + 11), (3, 7, 2, 5), (10**9, 10**12 + 39, 10**10 + 1, 10**9 + 3)]
    got = spark.createDataFrame(cases, "a long, n long, l long, r long").withColumn("s", P.cut_score("a", "n", "l", "r")).collect()
    assert [r.s for r in got] == [1000 * a * n // (l * r) for a, n, l, r in cases]


def test_entries_are_shuffled_once_a_level(spark, monkeypatch):
    plans = []

    def noted(df, stored=P.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(P, "stored", noted)
    rows = made(60)
    P.phrases(spark.createDataFrame(rows, DOCS), min_count=5, max_words=3)
    moved = [p for p in plans if "block#" in p.split("\n")[-1] or "MapInArrow" in p]
    assert len(moved) >= 5 and not any("Join" in p or "Generate" in p for p in moved)
    # names of words, pairs, names, pairs, names: one exchange each
    assert [p.count("Exchange") for p in moved[1:6]] == [1] * 5


def test_numbers_are_packed_whole():
    rng = np.random.default_rng(3)
    for size in (0, 1, 7, 1000):
        cols = [rng.integers(0, top, size) for top in (1, 200, 1 << 20, 1 << 62)]
        assert [x.tolist() for x in P.unpacked(P.packed(*cols))] == [x.tolist() for x in cols]


@pytest.mark.parametrize("base", [0, 1 << 40])
def test_equal_pairs_are_summed(base):
    rng = np.random.default_rng(4)
    left, right, n = base + rng.integers(0, 9, 500), base + rng.integers(0, 9, 500), rng.integers(1, 5, 500)
    at, a, of = P.summed(left, right, n)
    want = Counter()
    for x, y, k in zip(left.tolist(), right.tolist(), n.tolist(), strict=True):
        want[x, y] += k
    keys = list(zip(left[at].tolist(), right[at].tolist(), strict=True))
    assert dict(zip(keys, a.tolist(), strict=True)) == want
    assert [keys[i] for i in of] == list(zip(left.tolist(), right.tolist(), strict=True))


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_BYTES", 50)
    monkeypatch.setattr(P, "BUCKET_PLACES", 20)
    rows = made(100)
    assert shown(P.collocations(spark.createDataFrame(rows, DOCS), min_count=5)) == plain(rows, 5)
