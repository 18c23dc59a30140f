from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from helpers import DOCS, ODD, docs
from tokenizers import Tokenizer, models

from textloom.llm import bpe, packing

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PARTS = ["a", "b", "aaa", "  ", "\n", "\n\n", " \n", "\t", "é", "中文", "😀", "'s", "'LL", "<|endoftext|>", "<|endof", "1", "23", "!!", "  a", " ", "\x85", "́", "J̌", "İ", "ß", "\x00", "_", ".", ",", "..", "hello", " World", "tion", "\r\n", "Σ"]


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(1)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["a" * 3000, "ab" * 2000, " " * 3000, "".join(rng.choice("abehinorst") for _ in range(3000))]


def test_automaton_equals_the_library(strings):
    codec, ref = bpe.TextCodec(json.load(open(BYTE))), Tokenizer.from_file(BYTE)
    for s in strings:
        ids = ref.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(s), "<u4").tolist() == ids
        assert codec.decode(codec.encode(s)) == ref.decode(ids, skip_special_tokens=False) == s


def test_automaton_accepts_one_path_only():
    auto = bpe.compile_automaton(json.load(open(BYTE)))
    vocab = json.load(open(BYTE))["model"]["vocab"]
    words, rng, ref = [t for t in vocab if t.isascii() and t.isalpha()], random.Random(2), Tokenizer.from_file(BYTE)
    for _ in range(3000):
        a, b = rng.choice(words), rng.choice(words)
        alone = ref.encode(a + b, add_special_tokens=False).ids == [vocab[a], vocab[b]]
        assert auto.arc(auto.target[vocab[a]], vocab[b]) == alone
    assert not auto.gadget(99999, vocab["h"], vocab["e"], vocab["he"])  # they never stand side by side any more
    with pytest.raises(ValueError, match="two merges"):
        auto.gadget(99999, vocab["q"], vocab["z"], vocab["he"])


def test_small_vocabularies():
    """Overlapping merges of one letter, against repeated replacement."""
    letters = {c: i for i, c in enumerate(bpe.byte_alphabet())}
    merges = [("a", "a"), ("aa", "a"), ("b", "aa"), ("a", "b")]
    vocab = letters | {x + y: 256 + i for i, (x, y) in enumerate(merges)}
    spec = {"model": {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]}, "added_tokens": []}
    enc = bpe.Encoder(spec)
    rng = random.Random(3)
    for _ in range(500):
        word = "".join(rng.choice("aab") for _ in range(rng.randint(1, 14)))
        parts = list(word)
        for x, y in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (x, y):
                    parts[i : i + 2] = [x + y]
                i += 1
        assert enc.word(word.encode()) == [vocab[p] for p in parts]


def test_merges_that_never_fire():
    """Random merge lists, dead merges among them, against the library."""
    letters, rng = {c: i for i, c in enumerate(bpe.byte_alphabet())}, random.Random(3)
    lists = [[("a", "b"), ("b", "c"), ("a", "bc")]]
    for _ in range(150):
        made = {}
        for _ in range(rng.randint(1, 8)):
            x, y = (rng.choice([*"abc", *made]) for _ in range(2))
            made.setdefault(x + y, (x, y))
        lists.append(list(made.values()))
    for merges in lists:
        vocab = letters | {x + y: 256 + i for i, (x, y) in enumerate(merges)}
        enc = bpe.Encoder({"model": {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]}, "added_tokens": []})
        ref = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        for word in ["abc", *("".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(40))]:
            assert enc.word(word.encode()) == ref.encode(word, add_special_tokens=False).ids


def test_long_words_take_linear_work():
    """A word without a border, above a megabyte: steps, not seconds, are counted."""
    codec, rng = bpe.TextCodec(json.load(open(BYTE))), random.Random(5)
    steps = []
    for n in (300_000, 1_200_000):
        word = "".join(rng.choice("abehinorst") for _ in range(n))
        seen = [0]

        class Counting(list):
            def __getitem__(self, i, seen=seen):
                seen[0] += 1
                return super().__getitem__(i)

        codec.encoder.trie = Counting(codec.encoder.trie)
        ids = codec.encoder.word(word.encode())
        assert codec.decode(np.array(ids, "<u4").tobytes()) == word
        steps.append(seen[0])
    assert steps[1] < 4.2 * steps[0]


def test_column(spark):
    df = docs(spark, ODD)
    ref = Tokenizer.from_file(BYTE)
    got = {r["doc_id"]: r for r in bpe.encode_column(df, BYTE).collect()}
    for i, t in enumerate(ODD):
        ids = ref.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and got[i]["decoded"] == (t or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_column(df.limit(0), BYTE).count() == 0


def test_chunks_equal_the_library(strings):
    coder, ref = packing.Chunked(open(WORD, "rb").read()), Tokenizer.from_file(WORD)
    assert coder.by_chunk
    more = ["über, étreß. A.B", "µ ª ǰ", "don't, it's."]
    got = coder.encode([*strings, *more, None])
    for s, ids in zip([*strings, *more, ""], got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode(s, add_special_tokens=False).ids


def test_every_code_point_beside_a_border():
    coder, ref = packing.Chunked(open(WORD, "rb").read()), Tokenizer.from_file(WORD)
    odd = [*range(0x250), *range(0x300, 0x310), *range(0x2000, 0x2030), 0x345, 0x3A3, 0x3C2, 0x1680, 0x180E, 0x1E9E, 0x202F, 0x205F, 0x212A, 0x3000, 0xFEFF]
    texts = [t for c in map(chr, odd) for b in " .,'\n" for t in (f"a{c}{b}b", f"{c}{b}{c}", f"a{b}{c}.", f"{b}{c}s")]
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode(t, add_special_tokens=False).ids


def test_other_descriptions_go_through_the_library():
    spec = json.load(open(WORD))
    assert packing.splits_at_blanks(spec)
    spec["normalizer"]["normalizers"].pop()
    coder = packing.Chunked(json.dumps(spec).encode())
    assert not coder.by_chunk
    ref = Tokenizer.from_str(json.dumps(spec))
    for t, ids in zip(["Ab, c", "x"], coder.encode(["Ab, c", "x"]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode(t, add_special_tokens=False).ids


def test_fullest_is_fullest():
    rng = random.Random(4)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(1, 8))]
        found = packing.fullest(dict(Counter(items)), 40)
        assert all(found[k] <= items.count(k) for k in found) and max(items) in found
        rest = list(items)
        rest.remove(max(items))
        best = max(s for m in range(1 << len(rest)) if (s := max(items) + sum(x for i, x in enumerate(rest) if m >> i & 1)) <= 40)
        assert sum(k * n for k, n in found.items()) == best


def held(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    rng = random.Random(6)
    texts = ODD + [" ".join(rng.choice(["the", "of", "dog", "zqx"]) for _ in range(rng.randint(0, 3000))) for _ in range(60)] + ["same words"] * 40
    rows = packing.pack_documents(docs(spark, texts), WORD, ids=True).collect()
    n = held(rows, 2048)
    left = []  # first fit, longest first
    for length in sorted((r["length"] for r in rows), reverse=True):
        at = next((i for i, room in enumerate(left) if room >= length), None)
        if at is None:
            at = len(left)
            left.append(2048)
        left[at] -= length
    assert n <= len(left)
    ref, by = Tokenizer.from_file(WORD), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(by[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by[r["doc_id"]] += r["ids"]
    for i, t in enumerate(texts):
        assert by[i] == [*ref.encode(t or "", add_special_tokens=False).ids, 0]


def test_packing_repeats_and_empty(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    rows = packing.pack_documents(twice, WORD).collect()
    assert len(rows) == 3 and held(rows, 2048) == 1
    assert packing.pack_documents(spark.createDataFrame([], DOCS), WORD).count() == 0


def test_clashing_columns(spark):
    df = docs(spark, ["a b", None]).withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "length").withColumnRenamed("n_chars", "ids")
    assert [r["decoded"] for r in bpe.encode_column(df, BYTE).orderBy("doc_id").collect()] == ["a b", ""]
    assert [r["length"] for r in packing.pack_documents(df, WORD).orderBy("doc_id").collect()] == [3, 1]
    assert bpe.encode_column(df.withColumnRenamed("text", "ids2"), BYTE, text_col="ids2", ids=False).count() == 2
