"""The source divergence audit against a plain version."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import DOCS, ODD, low

from textloom.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs=10, top=10):
    """Every sum taken term by term."""
    held, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall(low(text))
        held[lang, source].update(found)
        seen[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, d in seen[lang].items() if d >= min_docs]
        v, others = len(kept), [s for g, s in groups if g == lang and s != source]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * v) for t in kept}

        def far(a, b):
            return (a - b) ** 2 // (a + b)

        p = shares(held[lang, source])
        pairs = []
        for s in others:
            q = shares(held[lang, s])
            pairs.append((s, sum(far(p[t], q[t]) for t in kept)))
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(held[g])
        q = shares(whole)
        terms = [(t, far(p[t], q[t])) for t in kept if held[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found if part == "pair" else found[:top])]
    return sorted(out)


def made(n=240, sources=7):
    rng = random.Random(11)
    words = ["Aa", "bb", "été", "ÉTÉ", "中文", "x1y", "zz😀", "q-r", "\x85", "don't", *[f"w{chr(97 + k)}" for k in range(12)]]
    rows = []
    for i in range(n):
        s = rng.choice([f"s{k}" for k in range(sources)] + ["s0"] * 4 + [None, ""])
        lang = rng.choice(["en", "en", "de", None, "rare"] if i % 40 else ["once"])
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(0, 30))), lang, s, 0))
    rows += [(900 + i, t, "en", "odd", 0) for i, t in enumerate(ODD)] + rows[:9] + [(None, None, None, None, None)]
    return rows + [(2000 + i, "", "mute", f"m{i}", 0) for i in range(3)]


def shown(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("block,entries", [(64, 200_000), (2, 5)])
def test_equals_plain(spark, monkeypatch, block, entries):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "ENTRIES", entries)
    rows = made()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = shown(D.divergence(docs))
    assert got == plain(rows)
    assert any(r[2] == "pair" and r[4] == 0 for r in got)  # a language that keeps no term


def test_no_rows_and_clashing_columns(spark):
    assert D.divergence(spark.createDataFrame([], DOCS)).count() == 0
    rows = made(60, 2)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS part", "2 AS item", "3 AS value", "4 AS term", "5 AS n", "6 AS a")
    assert shown(D.divergence(docs, min_docs=3, top=4)) == plain(rows, 3, 4)


def test_products_beyond_64_bits_are_exact(spark):
    cases = [(0, 0, 1), (5, 40, 7), (9_223_372_034, 10**10, 10), (9_223_372_033, 10**10, 10), (9 * 10**15, 10**16, 10**8)]
    df = spark.createDataFrame(cases, "c long, total long, v long").withColumn("p", D.share("c", "total"))
    assert {(r.c, r.total): r.p for r in df.collect()} == {(c, n): 1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases}
