from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, ODD, WORD, docs, low
from pyspark.sql import functions as F

from textloom.llm import langid, maxent
from textloom.session import table

SF = "/root/testdata/sf0.001"


def fold(mod):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == 1


def test_held_out_accuracy(spark):
    df = table(spark, SF, "documents")
    got = langid.predict(df.withColumn("held", fold(3)), langid.fit(df, ~fold(3)), keep=["doc_id", "held", "lang"]).filter("held").collect()
    assert len(got) > 30 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def plain_buckets(text):
    """Buckets of the 1- to 3-grams of a text, one by one."""
    codes = [32]
    for c in text + " ":
        x = ord(c.lower()[0]) if c.isalpha() else 32
        if x != 32 or codes[-1] != 32:
            codes.append(x)
    out, m = [], 1 << 32
    for order in (1, 2, 3):
        for i in range(order == 1, len(codes) - order + 1):
            h = codes[i] * 0x9E3779B1 % m
            for k in range(2, order + 1):
                h = (h ^ codes[i + k - 1]) * (0x85EBCA77 + 2 * k) % m
            out.append(((h ^ (h >> 15)) * (0xC2B2AE3D + 2 * order) % m) >> 17)
    return out


def test_equals_a_plain_naive_bayes(spark):
    rows = [(r["doc_id"], r["text"][:600], r["lang"], "s", 0) for r in table(spark, SF, "documents").orderBy("doc_id").limit(60).collect()]
    rows += [(1000 + i, t, "en", "s", 0) for i, t in enumerate(ODD)] + [(2000, "à la carte", None, "s", 0)]
    learn = [r for r in rows if r[0] % 3 and r[1] is not None and r[2]]
    counts, docs_of = {}, Counter(r[2] for r in learn)
    for _, text, lang, *_ in learn:
        counts.setdefault(lang, Counter()).update(plain_buckets(text))
    want = {}
    for i, text, *_ in rows:
        if text is None or not any(map(str.isalpha, text)):
            want[i] = ("und", 1.0)
            continue
        logs = {}
        for lang, c in counts.items():
            total = sum(c.values()) + 0.5 * (1 << 15)
            logs[lang] = math.log(docs_of[lang] / len(learn)) + sum(math.log((c[b] + 0.5) / total) for b in plain_buckets(text))
        best = min(sorted(logs), key=lambda x: -logs[x])
        want[i] = (best, 1 / sum(math.exp(v - logs[best]) for v in logs.values()))
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r["doc_id"]: r for r in langid.predict(df, langid.fit(df, F.col("doc_id") % 3 != 0), keep=["doc_id"]).collect()}
    assert len(docs_of) > 2
    for i, (lang, score) in want.items():
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-9)


def test_batches_and_excess(spark, monkeypatch):
    known = langid.fit(table(spark, SF, "documents"), F.lit(True))
    texts = [r["text"] for r in table(spark, SF, "documents").select("text").collect()] + ["q" * 1_200_000, "жзйк шщьы " * 40, None]
    whole = known.scored(texts)
    monkeypatch.setattr(langid, "CELLS", 1)
    parts = [known.scored(texts[at : at + 7]) for at in range(0, len(texts), 7)]
    for k in range(3):
        assert [x for p in parts for x in p[k]] == pytest.approx(whole[k], rel=1e-9) if k else [x for p in parts for x in p[k]] == whole[k]
    assert max(whole[2][:-3]) < 2 < min(whole[2][-3:-1]) and whole[2][-1] == 0


def test_a_small_share_still_gives_rows(spark):
    df = docs(spark, [f"text number {i} of many" for i in range(4000)])
    some = langid.fit(df, F.lit(True), train_rows=200)
    assert some.labels == ["en"] and langid.fit(df, F.lit(True), key_col="source", train_rows=200).labels == ["en"]


def test_languages_of_odd_texts(spark):
    known = langid.fit(table(spark, SF, "documents"), F.lit(True))
    df = docs(spark, ODD + ["123 !!", "é"]).withColumnRenamed("n_chars", "score")
    got = {r["doc_id"]: r for r in langid.predict(df, known).collect()}
    for i, t in enumerate([*ODD, "123 !!", "é"]):
        letters = any(map(str.isalpha, t or ""))
        assert (got[i]["lang_pred"] == "und") == (not letters)
    assert got[5]["lang_pred"] == got[6]["lang_pred"]
    none = langid.fit(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert langid.predict(df, none, keep=["doc_id"]).filter("lang_pred <> 'und'").count() == 0
    assert langid.predict(df.limit(0), known, keep=["doc_id"]).count() == 0


def test_slices_count_each_gram_once(monkeypatch):
    text = "Ab, çd  eé-f\n" * 50
    whole = [np.bincount(np.concatenate([g[k] for g in langid.grams(text)]), minlength=1 << 15) for k in range(3)]
    for size in (7, 64, 650):
        monkeypatch.setattr(langid, "SLICE", size)
        parts = [np.bincount(np.concatenate([g[k] for g in langid.grams(text)]), minlength=1 << 15) for k in range(3)]
        assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def brute(rows, training):
    toks = {i: WORD.findall(low(t)) for i, t in rows}
    c = Counter()
    for i, w in toks.items():
        if training(i):
            c.update(w)
            c[""] += 1
    n, v = sum(c.values()), len(c)
    d = n + 0.5 * (v + 1)
    return {i: (len(w) + 1, sum(c[x] > 0 for x in [*w, ""]), n, sum(math.log10((c[x] + 0.5) / d) for x in [*w, ""])) for i, w in toks.items()}


def test_base_scores_and_gain(spark):
    df = table(spark, SF, "documents").withColumn("held", fold(5))
    got = {r["doc_id"]: r for r in maxent.score(df, ~F.col("held"), keep=("held",), most=500).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()], lambda i: zlib.crc32(str(i).encode()) % 5 != 1)
    for i, (n, known, total, base) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r["held"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_add_up(spark):
    df = docs(spark, ["the dog the cat", "a dog. end", "zz yy"] * 5)
    counts = maxent.word_counts(df.select("text"))
    vocab, _ = maxent.vocabulary(counts)
    weights = maxent.train(maxent.history_counts(df.select("text"), vocab), rounds=3)
    table_ = 10.0 ** maxent.tabulate(weights).reshape(-1, maxent.CLASSES).astype(float)
    assert np.allclose(table_.sum(axis=1), 1, atol=1e-5) and (table_[:, maxent.START] == 0).all()
    for c in range(maxent.CLASSES):
        own = vocab.n[vocab.cls == c]
        if len(own):
            assert ((own + 0.5) / vocab.class_divisor[c]).sum() + 0.5 / vocab.class_divisor[c] == pytest.approx(1)


def plain_classes(texts, of):
    """Per text its tokens' classes, the end included."""
    return [[of(w.encode()) for w in WORD.findall(low(t))] + [maxent.END] for t in texts]


def plain_rows(one, two):
    """The four weight rows of a history (class before, class before that)."""
    h = (two * maxent.CLASSES + one) * 0x9E3779B97F4A7C15 % 2**64
    return [0, one, two, (h >> 40) % maxent.TRIGRAM_BUCKETS]


def plain_softmax(tables, rows):
    logits = [sum(t[r][c] for t, r in zip(tables, rows, strict=True)) for c in range(maxent.CLASSES)]
    top = max(x for c, x in enumerate(logits) if c != maxent.START)
    out = [0.0 if c == maxent.START else math.exp(x - top) for c, x in enumerate(logits)]
    return [x / sum(out) for x in out]


def test_model_against_plain_loops(spark):
    """Training by loops over histories, and scores token by token, without tables."""
    texts = ["the dog the cat", "a dog. end of it", "zz yy the dog", None, "", "The  dog\nran"] * 3
    df = docs(spark, texts)
    vocab, _ = maxent.vocabulary(maxent.word_counts(df.select("text")))
    seen = Counter()
    for classes in plain_classes(texts, vocab.classes.of):
        two = one = maxent.START
        for c in classes:
            seen[two, one, c] += 1
            two, one = one, c
    sizes = [1, maxent.CLASSES, maxent.CLASSES, maxent.TRIGRAM_BUCKETS]
    tables = [np.zeros((n, maxent.CLASSES)) for n in sizes]
    for _ in range(maxent.ROUNDS):
        real, model = [np.zeros_like(t) for t in tables], [np.zeros_like(t) for t in tables]
        for two, one in {k[:2] for k in seen}:
            rows = plain_rows(one, two)
            after = {c: n for (a, b, c), n in seen.items() if (a, b) == (two, one)}
            p = plain_softmax(tables, rows)
            for k, r in enumerate(rows):
                model[k][r] += np.array(p) * sum(after.values())
                for c, n in after.items():
                    real[k][r][c] += n
        for t, x, m in zip(tables, real, model, strict=True):
            t += maxent.RATE * (x - m) / (0.5 * (x + m) + 1.0)
    trained = maxent.train(maxent.history_counts(df.select("text"), vocab))
    for t, w in zip(tables, trained.parts(), strict=True):
        assert np.allclose(np.delete(t, maxent.START, 1), np.delete(w, maxent.START, 1), atol=1e-9)
    counts = Counter(w for t in texts for w in WORD.findall(low(t)))
    alone = {maxent.END, *vocab.classes.own.values()}
    members = {c: [w for w in counts if vocab.classes.of(w.encode()) == c] for c in range(maxent.CLASSES)}
    asked = [*texts[:6], "the unseen word", "dog dog dog the"]
    got = {r["doc_id"]: r["score"] for r in maxent.score(docs(spark, [*texts, *asked[6:]]), F.col("doc_id") < len(texts), most=3).collect()}
    for i, t in [*enumerate(texts), (len(texts), asked[6]), (len(texts) + 1, asked[7])]:
        want, two, one = 0.0, maxent.START, maxent.START
        for w in [*WORD.findall(low(t)), None]:
            c = maxent.END if w is None else vocab.classes.of(w.encode())
            want += math.log10(plain_softmax(tables, plain_rows(one, two))[c])
            if c not in alone:
                total = sum(counts[x] for x in members[c]) + 0.5 * (len(members[c]) + 1)
                want += math.log10((counts[w] + 0.5) / total)
            two, one = one, c
        assert got[i] == pytest.approx(want, rel=1e-5)


def test_token_slices(spark, monkeypatch):
    """Borders of slices fall into words and blanks; a text above a megabyte."""
    text = "aé b\n" * 300_000
    whole = [w for part in maxent.tokens(text) for w in part]
    assert len(text.encode()) > maxent.SLICE and whole == text.encode().split()
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(maxent, "SLICE", size)
        assert [w for part in maxent.tokens(text[:60]) for w in part] == text[:60].encode().split()


def test_scores_of_odd_texts(spark):
    df = docs(spark, ODD).withColumnRenamed("lang", "score").withColumnRenamed("n_chars", "word")
    got = {r["doc_id"]: r for r in maxent.score(df, F.lit(True)).collect()}
    want = brute(list(enumerate(ODD)), lambda i: True)
    assert all(got[i]["base_score"] == pytest.approx(want[i][3]) and got[i]["n_known"] == want[i][1] for i in want)
    assert got[5]["score"] == got[6]["score"]
    untrained = maxent.score(df, F.lit(False)).collect()
    assert all(math.isfinite(r["score"]) and r["n_known"] == 0 and r["train_tokens"] == 0 for r in untrained)
    assert maxent.score(spark.createDataFrame([], DOCS), F.lit(True)).count() == 0
