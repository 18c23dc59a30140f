"""Token files and their index: against the library, file by file, and as an exact round trip."""

from __future__ import annotations

import glob
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from helpers import DOCS, ODD, docs
from test_bpe_packing import PARTS
from tokenizers import Tokenizer

from textloom.llm import idfiles as I
from textloom.llm import queries
from textloom.session import drop_stored, table

BYTE = P.path("byte_bpe_50k.json")
REF = Tokenizer.from_file(BYTE)


def ids_of(text):
    return [*REF.encode(text or "", add_special_tokens=False).ids, I.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def key_order(key):
    return (key is not None, key)


@pytest.mark.parametrize("shard_ids", [None, 40, 3000])
def test_round_trip(spark, monkeypatch, tmp_path, shard_ids):
    monkeypatch.setattr(I, "RANGE_ROWS", 7)
    monkeypatch.setattr(I, "BUCKET_KEYS", 5)
    rng = random.Random(12)
    rows = [(i * 3, t, "en", "s", 0) for i, t in enumerate(ODD)]
    rows += [(rng.choice([None, 7, 7, 7, 8, rng.randint(0, 200)]), " ".join(rng.choices(["a", "New", "é", "<|endoftext|>", "\x02\x00", "\n"], k=rng.randint(0, 9))), "en", "s", 0) for _ in range(150)]
    rows += rows[:30]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS key", "2 AS ids", "3 AS n", "4 AS shard", "5 AS start").repartition(5)
    path = I.write(frame, BYTE, str(tmp_path / "ids"), shard_ids=shard_ids)
    got = sorted(I.read(spark, path, I.lookup(spark, path, frame)).collect(), key=lambda r: r.start)
    # the same documents, in the order of their keys, without gaps
    assert sorted((key_order(r.key), r.ids) for r in got) == sorted((key_order(k), ids_of(t)) for k, t, *_ in rows)
    assert [key_order(r.key) for r in got] == sorted(key_order(k) for k, *_ in rows)
    at, nth = 0, {}
    for r in got:
        assert (r.start, r.n, r.ids_crc32, r.nth) == (at, len(r.ids), crc(r.ids), nth.get(r.key, 0))
        nth[r.key] = r.nth + 1
        at += r.n
    # the files are the raw ids and nothing else
    shards = {}
    for f in glob.glob(f"{path}/ids/shard=*/part-*"):
        k = int(f.split("shard=")[1].split("/")[0])
        assert k not in shards
        shards[k] = np.fromfile(f, "<u2").tolist()
    assert [i for k in sorted(shards) for i in shards[k]] == [i for r in got for i in r.ids]
    assert len(shards) > (1 if shard_ids else 0) and I.meta(spark, path)["ids"] == at


def test_keys_that_are_not_there(spark, tmp_path):
    path = I.write(docs(spark, ["a b", "c", None]), BYTE, str(tmp_path / "ids"))
    asked = spark.createDataFrame([(k,) for k in [*range(-500, 500), None]] + [(1,), (1,)], "k long")
    assert sorted((r.key, r.n) for r in I.lookup(spark, path, asked, "k").collect()) == [(0, 3), (1, 2), (2, 1)]
    assert I.lookup(spark, path, asked.limit(0), "k").count() == 0


def test_text_keys_and_wide_ids(spark, tmp_path, monkeypatch):
    rows = [(None, "x"), ("", "y z"), ("é", "New York"), ("b", "")]
    frame = spark.createDataFrame(rows, "name string, body string")
    monkeypatch.setattr(I, "BOUND_BYTES", 0)  # the way beyond it
    path = I.write(frame, BYTE, str(tmp_path / "ids"), end_id=50256, width=4, key_col="name", text_col="body")
    got = {r.key: r.ids for r in I.read(spark, path, I.lookup(spark, path, frame, "name")).collect()}
    assert got == {k: [*ids_of(t)[:-1], 50256] for k, t in rows}


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    path = I.write(empty, BYTE, str(tmp_path / "ids"))
    asked = spark.createDataFrame([(1,)], "doc_id long")
    found = I.lookup(spark, path, asked)
    assert found.count() == 0 and I.read(spark, path, found).count() == 0 and I.meta(spark, path)["docs"] == 0


def test_encoder_equals_the_library(monkeypatch):
    coder = I.Encoder(open(BYTE, "rb").read())
    assert coder.quick is not None
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    # every code point between, before and after letters, digits, blanks and signs
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{c}b {c} 1{c}2{c}{c}. {c}\n" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    for text, want in zip(texts, REF.encode_batch(texts, add_special_tokens=False), strict=True):
        assert coder.encode(text) == want.ids
    for text in ODD + [" " * 50_000 + "x", "\t\n" * 30_000, "ab" * 40_000]:
        assert coder.encode(text) == ids_of(text)[:-1]
    assert not coder.plain(" " * 9000 + "x") and not coder.plain("x" * 9000) and not coder.plain("a <|endoftext|>")


def test_texts_without_runs_of_white_space():
    coder = I.Encoder(open(BYTE, "rb").read())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"x{c}" for c in I.SPACES] + [f"{c}x" for c in I.SPACES]
    texts += ["".join(f"a{c}b1{c}2'{c}s.{c}-" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    for text, want in zip(texts, REF.encode_batch(texts, add_special_tokens=False), strict=True):
        assert not I.has_runs(text) and coder.single.encode_ordinary(text) == want.ids == coder.encode(text)
    assert all(I.has_runs(f"a{c}{d}b") for c in I.SPACES for d in I.SPACES)
    # no other character is white space to the library
    others = [c for c in points if c not in I.SPACES]
    for k in range(0, len(others), 64):
        text = "".join(f"a{c}{c}b" for c in others[k : k + 64])
        assert not I.has_runs(text) and coder.single.encode_ordinary(text) == coder.quick.encode_ordinary(text)


@pytest.mark.parametrize("width", [2, 4])
def test_payloads_are_made_of_arrays(width, monkeypatch):
    coder = I.Encoder(open(BYTE, "rb").read())
    texts = [*ODD, "New York, a <|never|> b", "<|never|><|never|>", "a  b <|never|>\n\n", "é" * 3000 + " x", "".join(PARTS)]
    want = [np.array(ids_of(t)[:-1], f"<u{width}").tobytes() for t in texts]

    def forbidden(*_):
        raise AssertionError("a Python number for each id")

    # the ways that list every id cost a quarter of the encoder's time
    for quick in (coder.quick, coder.single):
        monkeypatch.setattr(quick, "encode_ordinary", forbidden)
    got = [coder.ids(t) for t in texts]
    assert all(isinstance(x, np.ndarray) for x in got) and [I.packed(x, width) for x in got] == want


def test_ids_that_need_more_bytes(spark, tmp_path):
    with pytest.raises(ValueError, match="more than 2 bytes"):
        I.write(docs(spark, ["a"]), BYTE, str(tmp_path / "ids"), end_id=1 << 16, width=2)


@pytest.mark.parametrize("hint", [b"", bytes(range(256)) * 8])
def test_rows_come_back_as_they_were(hint):
    rng = random.Random(6)
    codec = I._row_compressor(hint)
    back = I.zstandard.ZstdDecompressor(dict_data=I._hint(hint))
    for size in (0, 1, 100, 70_000):
        raw = rng.randbytes(size // 2) + bytes(size - size // 2)
        assert back.decompress(codec.compress(raw)) == raw


def test_pairs_of_ids_are_found_again():
    rng = random.Random(7)
    words = [rng.randbytes(4) for _ in range(500)]
    hint, row, shard = (b"".join(rng.choice(words) + rng.randbytes(2) for _ in range(n)) for n in (9000, 1500, 60_000))
    # half of a word of two ids is saved at least, in rows and in shards, where two other bytes follow each
    for codec, raw in ((I._row_compressor(hint), row), (I.zstandard.ZstdCompressor(compression_params=I.search(*I.SHARD_SEARCH)), shard)):
        assert len(codec.compress(raw)) < len(raw) * 2 / 3


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 100, 40_000):
        h, g = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64)
        if n > 10:
            h[: n // 2] = h[0]  # half a hash alike isn't alike
        sizes, bits = I.build_levels(h, g)
        assert sorted(I.slots(h, g, sizes, bits).tolist()) == list(range(n))
        assert len(bits) <= 6 * n + 640
        other = I.slots(g, h, sizes, bits)
        assert ((other >= -1) & (other < max(n, 1))).all()
    with pytest.raises(ValueError, match="one hash"):
        I.build_levels(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def test_query_equals_the_library(spark):
    from places import SF

    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op12_idfiles(spark, SF).collect()}
    want, at = {}, 0
    for r in table(spark, SF, "documents").orderBy("doc_id").collect():
        ids = ids_of(r.text)
        want[r.doc_id] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want
    drop_stored(spark)
