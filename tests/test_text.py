from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import udfs


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("fn", "given", "want"),
    [
        (X.canon, "Šuηka", "śuŋka"),
        (X.plain, "a-hi'-yo-ka-sin", "ahiyokasin"),
        (X.loose, "da-ŋ x", "danx"),
        (X.clean_form, " apa; ", "apa"),
        (X.clean_form, "beat the corn", None),
        (X.is_suspect, "qux", True),
        (X.extract_option, "the answer is (c)", "C"),
        (X.extract_final, "a\n\\boxed{x} then \\boxed{y}", "y"),
        (X.extract_final, "Final answer: so\nmore", "so"),
        (X.extract_final, None, ""),
        (X.redact_key, "k sk-abcdefgh1 z", "k sk-*** z"),
        (X.retry_delay, "Please retry in 3.5s", 3.5),
        (X.retry_delay, "no", None),
        (X.fenced_json, "a ```json\n[1]\n``` b", "[1]"),
        (X.json_array_slice, "x [1, [2]] y", "[1, [2]]"),
        (X.gold_language, "[TO BE GENERATED]", "placeholder"),
        (X.gold_language, "the verb tense", "english_like"),
        (X.gold_language, "šuŋka", "dakota_markers"),
        (X.gold_language, "kin", "ascii_or_unknown"),
        (X.gold_language, None, "empty"),
        (X.term_rule_type, "Negative prefix", "morphology"),
        (X.term_rule_type, "sound law", "phonology"),
    ],
)
def test_values(spark, fn, given, want):
    assert value(spark, fn(F.lit(given).cast("string"))) == want


def test_headword(spark):
    got = value(spark, X.parse_headword(F.lit("a-hi'-yo-ka-sin")))
    assert (got["syllables"], got["stress"], got["plain"]) == (["a", "hi", "yo", "ka", "sin"], 1, "ahiyokasin")
    for bad in ("a-to-ka-tu", "a'-b'", "a b", "", "-a'"):
        assert value(spark, X.parse_headword(F.lit(bad))) is None
    assert value(spark, X.parse_headword(F.lit("kin")))["stress"] == 0
    assert value(spark, X.syllable_cuts(F.array(F.lit("a"), F.lit("hi"), F.lit("yo")))) == [1, 3]


def test_answers(spark):
    span = lambda s: tuple(value(spark, X.extract_answer(F.lit(s))))
    assert span("<think>ANSWER: no</think> ok\nANSWER: `yes`\nmore") == ("yes", True)
    assert span("a\n last line ") == ("last line", False)
    assert span("<think>never closed ANSWER: x") == ("", False)
    assert span("") == ("", False)


def test_arrays(spark):
    lit = lambda *xs: F.array(*map(F.lit, xs))
    assert value(spark, X.split_refs(F.lit("apa and kin; two words, šuŋka"))) == ["apa", "kin", "śuŋka"]
    assert value(spark, X.equivalents(F.lit("apa; kin, apa: beat out"))) == ["apa", "kin"]
    assert value(spark, X.gloss_tokens(F.lit("The dog, the cat"))) == ["dog", "cat"]
    assert value(spark, X.gloss_tokens(F.lit("of the"))) == ["of", "the"]
    assert value(spark, X.marked_terms(F.lit("`šúŋka` and **a-b** šúŋka tok'n"))) == ["šúŋka", "a-b", "tok'n"]
    assert value(spark, X.extract_affixes(F.lit("add (-ku) or ho-ku and ta- x"))) == ["ho-ku", "ta-"]
    assert value(spark, X.extract_affixes(F.lit("-ku ta- wa-, a-b.c -\u0161u"), F.lit("ta-"))) == ["-ku", "-\u0161u", "a-b", "ta-", "wa-"]
    assert value(spark, X.strip_affixes(F.lit("taatkuku"), lit("-ku", "ta-"))) == "atku"
    assert value(spark, X.affix_tokens(F.lit("atkuku ku, kux"), F.lit("-ku"))) == ["atkuku"]
    assert tuple(value(spark, X.single_edit(F.lit("abcde"), F.lit("abXde")))) == ("c", "X", 2)
    assert tuple(value(spark, X.single_edit(F.lit("abc"), F.lit("abwac")))) == ("", "wa", 2)
    assert value(spark, X.version_tuple(F.lit("1.12.0rc1"))) == [1, 12, 0]
    assert [value(spark, X.is_plausible_affix(F.lit(a))) for a in ("-ku", "ta-", "-", "a/b", "-toolongaffix")] == [True, True, False, False, False]


def test_sha_bucket(spark):
    import hashlib

    for s in ("a", "śuŋka", ""):
        assert value(spark, X.sha_bucket(F.lit(s))) == int(hashlib.sha256(s.encode()).hexdigest(), 16) % 10


def test_udfs(spark):
    rows = [("wićaśta", "wicasta"), ("", "x"), (None, None), ("abcdef", "xxabcdyy")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(udfs.fold_letters("a"), udfs.shares_stem("a", "b"), udfs.pattern_score(F.col("b"), F.lit("[ab"))).collect()
    assert [g[0] for g in got] == ["wicasta", "", "", "abcdef"]
    assert [g[1] for g in got] == [True, False, False, True]
    assert [g[2] for g in got] == [0.0] * 4
    one = df.limit(1).select(X.hide_leak(F.lit("Rule\nPattern: zz\nExamples:\n - kin\nGo"), F.lit("kin"), F.lit("zz")), udfs.pattern_score(F.lit("it has p[x here"), F.lit("rule: p[x"))).first()
    assert tuple(one) == ("Rule\nPattern: [hidden]\nGo", 1.0)


def test_hide_leak_and_stems_against_plain_versions(spark):
    import random
    import re

    rng = random.Random(3)
    parts = ["Rule\n", "Pattern: kin\n", "pattern:  KIN \n", "Pattern: b\n", "\nExamples:\n", " - kin\n", "- other\n", "\t-Kin\n", "kin ", "Do it", "\n\n", "k.n", "Pattern: x\\Ey\n"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))), rng.choice(["kin", " ", None, "k.n", "x\\Ey"]), rng.choice(["b", "kin ", None])) for _ in range(300)]

    def plain(text, *said):
        needles = [n.strip() for n in said if n and n.strip()]
        out, at = "", 0
        for m in re.finditer(r"\n+Examples:\n(?:[ \t]*-[ \t]*.+\n?)+", text):
            out += text[at : m.start()] + ("\n" if any(n in m[0] for n in needles) else m[0])
            at = m.end()
        out += text[at:]
        for n in needles:
            if len(n) > 1:
                out = re.sub(rf"(?im)^Pattern:\s*{re.escape(n)}\s*$", "Pattern: [hidden]", out)
        return out.strip()

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, g string, t string").repartition(1)
    got = [r[0] for r in df.orderBy("i").select(X.hide_leak(F.col("p"), F.col("g"), F.col("t"))).collect()]
    assert got == [plain(p, g, t) for p, g, t in rows]

    def stem(a, b):
        run = any(a[i : i + 4] in b for i in range(len(a) - 3))
        part = any(len(x) > 2 and x in y for x, y in ((a, b), (b, a)))
        cut = any(b.startswith(p) and len(b) > len(p) + 2 and len(a) > 2 and (a in b[len(p) :] or b[len(p) :] in a) for p in udfs.STEM_PREFIXES)
        return bool(a and b) and (run or part or cut)

    words = ["".join(rng.choice("woa") for _ in range(rng.randint(0, 7))) for _ in range(400)]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(1500)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(pairs)], "i int, a string, b string").repartition(1)
    got = [r[0] for r in df.orderBy("i").select(udfs.shares_stem(F.col("a"), F.col("b"))).collect()]
    assert got == [stem(a, b) for a, b in pairs] and 50 < sum(got) < 1450


def test_edits_against_a_plain_version(spark):
    import random
    from collections import Counter

    from textloom.operators import edits

    rng = random.Random(12)
    letters = "abpiŋ"
    heads = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(80)]
    change = lambda w: w[: (i := rng.randint(0, len(w)))] + rng.choice(["", "a", "wa", "ŋ", "abcabc"]) + w[i + rng.randint(0, 3) :] + rng.choice(["", "pi"])
    pairs = [(h, change(h)) for h in heads for _ in range(12)] + [("a", None), ("a", ""), ("ab", "ab")]

    def edit(a, b):
        p = next(k for k in range(min(len(a), len(b)), -1, -1) if a[:k] == b[:k])
        s = next(k for k in range(min(len(a), len(b)) - p, -1, -1) if a[len(a) - k :] == b[len(b) - k :])
        return a[p : len(a) - s], b[p : len(b) - s]

    def variants(f):
        return [g for g in (f, f[:-2] if f and f.endswith("pi") and len(f) > 3 else None) if g]

    counts = Counter()
    for h, f in pairs:
        e = [x for g in variants(f) if g != h and len((x := edit(h, g))[0]) <= 2 and len(x[1]) <= 5]
        counts.update(e[:1])
    admitted = {e for e, n in counts.items() if n >= 9}
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, head string, form string")
    mined = edits.mined_edits(df, "head", "form", 9)
    assert {(r["old"], r["new"]): r["n"] for r in mined.collect()} == {e: counts[e] for e in admitted} and len(admitted) > 3
    for loose in (False, True):
        bare = lambda x: x.replace("ŋ", "n") if loose else x  # noqa: E731, B023
        known = {(bare(a), bare(b)) for a, b in admitted}
        want = {i: any(g == h or edit(bare(h), bare(g)) in known for g in variants(f)) for i, (h, f) in enumerate(pairs)}
        assert {r["i"]: r["explained"] for r in edits.explained(df, "head", "form", mined, loose).collect()} == want
    got = edits.suspect_pairs(df, "head", "form", ("a", "p"), 2).first()
    bad = sorted((h, f) for h, f in pairs if f and h.startswith("a") and f.startswith("p"))
    assert got["n"] == len(bad) and [tuple(x) for x in got["examples"]] == bad[:2]
    assert edits.suspect_pairs(df.limit(0), "head", "form").first()["n"] == 0
