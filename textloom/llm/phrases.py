"""Phrase collocation mining by hierarchical pair naming.

A language's frequent words have ids. A phrase of k words is the pair of its
first k - 1 and its last k - 1 words: where both are frequent and stand at
neighbouring places, the two ids are one occurrence of the pair, and a pair
that is frequent gets an id of its own. Round by round, texts are rewritten as
ids of ever longer phrases; what isn't frequent is a gap, so texts thin out.
The two ids of a pair are its parent pointers: following the left ones gives
the counts of all prefixes, the right ones those of all suffixes, and with them
every cut of a phrase; a phrase is subsumed if a pair points at it that is as
frequent (a longer phrase around it passes through such a pair).

Texts are kept as blocks of some hundred thousand words of one language: a
sequence of codes of the block's own. Only a block's distinct words or pairs,
with their counts, are dealt by hash into buckets that a task can hold, as one
row of packed numbers for each block and bucket. A bucket's task sums them over
all blocks, names what is frequent and sends each block the names of its own
entries. So an entry is shuffled once, whatever part of them is frequent, and
back only if it is; the names are global, no table of words or phrases is ever
broadcast or held by one task, and a frequent pair is one entry a block. Codes
follow the buckets, so a row's codes are known by the first. Pieces between
separators are never cut, so phrases are counted across a block's borders only
within the block that holds their piece.

A cut's score is ``floor(1000 a n / (l r))`` in decimals of 38 digits.

Defined cases: null text counts as empty, a null language as ``und``; repeated
rows count each; overlapping occurrences count each; an empty table, or one
without frequent pairs, gives no rows; other columns don't matter. Words may
hold any character but blank, tab and the separators.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import discard, spread, stored

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Words of a block, about, and all open blocks of a task together.
BLOCK_WORDS, OPEN_WORDS = 1 << 18, 1 << 21
#: Bytes of text for a bucket of words, places of the texts for a bucket of pairs, about; buckets for each core, at least.
BUCKET_BYTES, BUCKET_PLACES, CORE_BUCKETS = 1 << 25, 1 << 22, 4
#: Bytes of text that are split at once.
SLICE = 1 << 20
UNKNOWN = "und"
#: A to Z to lower case; separators to line feeds; tab to blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_GAP, _NOTHING = -1, -2


class _Codes(dict):
    """Codes of words, dealt as they come; a line feed is a gap."""

    def __init__(self):
        super().__init__({b"": _NOTHING, b"\n": _GAP})

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self) - 2
        return code


class _Block:
    def __init__(self):
        self.codes, self.parts, self.size = _Codes(), [], 0

    def rows(self, block: int, lang: str, buckets: int) -> pa.RecordBatch:
        seq = without_gaps(np.concatenate(self.parts)) if self.parts else np.empty(0, "<i4")
        words, salt = list(self.codes)[2:], zlib.crc32(lang.encode())
        n = np.bincount(seq[seq >= 0], minlength=len(words))
        bucket = np.array([zlib.crc32(w, salt) for w in words], np.int64) % buckets
        seq, order, bucket = by_bucket(seq, bucket, np.argsort(bucket, kind="stable"))
        words, n = [words[i] for i in order.tolist()], n[order]
        return _level(block, lang, seq, bucket, lambda a, b: (packed(n[a:b]), zstandard.compress(b"\n".join(words[a:b]), 3)))


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0, of one length: byte by byte, compressed."""
    parts, head = [], [len(columns[0]), len(columns)]
    for column in columns:
        width = max(1, -(-int(column.max(initial=0)).bit_length() // 8))
        parts.append(column.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
        head.append(width)
    return zstandard.compress(b"".join([np.array(head, "<i8").tobytes(), *parts]), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n, columns = np.frombuffer(raw, "<i8", 2).tolist()
    out, at = [], 16 + 8 * columns
    for width in np.frombuffer(raw, "<i8", columns, 16).tolist():
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(wide.reshape(-1).view("<i8"))
        at += n * width
    return out


def by_bucket(seq: np.ndarray, bucket: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence with codes in another order, that order, and the buckets in it."""
    code = np.empty(len(order) + 1, np.int64)
    code[order] = np.arange(len(order))
    code[-1] = _GAP
    return code[seq], order, bucket[order]


#: A level's rows: a block's sequence (no bucket), and its entries' parts by bucket: from which code on, counts (and ids of pairs), words.
_LEVEL = "block long, lang string, bucket long, start long, data binary, words binary"


def _level(block: int, lang: str | None, seq: np.ndarray | None, bucket: np.ndarray, part) -> pa.RecordBatch:
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    rows = [(block, lang, None, None, packed(seq + 1), None)] if seq is not None else []
    rows += [(block, lang, int(bucket[a]), a, *part(a, b)) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    return _batch(rows, [("block", pa.int64()), ("lang", pa.string()), ("bucket", pa.int64()), ("start", pa.int64()), ("data", pa.binary()), ("words", pa.binary())])


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(cols, fields, strict=True)], [c for c, _ in fields])


def _buckets(docs: DataFrame, size: int, most: int) -> int:
    return max(CORE_BUCKETS * docs.sparkSession.sparkContext.defaultParallelism, (size or 0) // most)


def without_gaps(seq: np.ndarray) -> np.ndarray:
    """The sequence with one gap for each run of gaps."""
    keep = seq != _GAP
    keep[1:] |= seq[:-1] != _GAP
    return seq[keep].astype("<i4")


def slices(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """Parts of a text whose bytes are mapped, none cut inside a word, and whether each ends a piece."""
    at = 0
    while len(text) - at > SLICE:
        end = text.rfind(b"\n", at, at + SLICE) + 1
        if not end:
            end = text.find(b" ", at + SLICE) + 1 or text.find(b"\n", at + SLICE) + 1 or len(text)
        yield text[at:end], text[end - 1 : end] == b"\n"
        at = end
    yield text[at:], True


def blocks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, int]:
    """Stored rows of the level of words, and the number of buckets."""
    said = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    buckets = _buckets(docs, said.agg(F.sum(F.octet_length("text"))).first()[0], BUCKET_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, _Block] = {}
        # a task's blocks have numbers of their own
        total, number = 0, TaskContext.get().partitionId() << 32

        def made(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return opened.pop(lang).rows(number, lang, buckets)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part, ends in slices(text.as_py().translate(_BYTES)):
                    block = opened.setdefault(lang, _Block())
                    codes = block.codes
                    seq = np.array([codes[w] for w in part.replace(b"\n", b" \n ").split(b" ")], np.int32)
                    seq = seq[seq != _NOTHING]
                    block.parts.append(np.append(seq, np.int32(_GAP)) if ends else seq)
                    block.size += len(seq)
                    total += len(seq)
                    if ends and block.size > BLOCK_WORDS:
                        total -= block.size
                        yield made(lang)
                if total > OPEN_WORDS:
                    for k in list(opened):
                        yield made(k)
                    total = 0
        for k in list(opened):
            yield made(k)

    return stored(spread(said).mapInArrow(run, _LEVEL)), buckets


def paired(seq: np.ndarray, codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sequence of neighbouring named places as pairs: new codes, and each code's left id, right id and count."""
    top = int(seq.max(initial=0)) + 1
    name = np.full(top + 1, -1, np.int64)  # the last entry is a gap's
    name[codes] = ids
    here = name[seq]
    both = (here[:-1] >= 0) & (here[1:] >= 0)
    key = seq[:-1][both].astype(np.int64) * top + seq[1:][both]
    found, code, n = np.unique(key, return_inverse=True, return_counts=True)
    out = np.full(max(len(seq) - 1, 0), _GAP, np.int32)
    out[both] = code
    return without_gaps(out), name[found // top], name[found % top], n


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by their first column, by its values."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for key, own in groupby(rows, lambda row: row[0]):
        yield key, list(own)


def _spread_names(name: np.ndarray, rows: list[tuple], sizes: list[int]) -> Iterator[tuple[int, bytes]]:
    """Of each row (block, start) of entries, what is named: the block, its codes (by differences) and ids."""
    at = 0
    for (block, start), size in zip(rows, sizes, strict=True):
        own = name[at : at + size]
        hit = np.flatnonzero(own >= 0)
        if len(hit):
            yield block, packed(np.diff(hit + start, prepend=0), own[hit])
        at += size


def named_words(level: DataFrame, buckets: int, min_count: int) -> DataFrame:
    """Stored rows: (block, data) of named entries; and, without a block, each bucket's and language's count of words and its frequent words (id, phrase, a)."""
    fields = [("block", pa.int64()), ("data", pa.binary()), ("lang", pa.string()), ("n", pa.int64()), ("id", pa.list_(pa.int64())), ("phrase", pa.list_(pa.string())), ("a", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(batches):
            first = 0
            for lang in sorted({r[1] for r in rows}):
                own = [r for r in rows if r[1] == lang]
                n = [unpacked(r[4])[0] for r in own]
                words = pa.array([w for r in own for w in zstandard.decompress(r[5]).split(b"\n")], pa.binary()).dictionary_encode()
                code, a = words.indices.to_numpy(), np.zeros(len(words.dictionary), np.int64)
                np.add.at(a, code, np.concatenate(n))
                good = np.flatnonzero(a >= min_count)
                ids = np.full(len(a), -1, np.int64)
                ids[good] = (first + np.arange(len(good))) * buckets + bucket
                first += len(good)
                out = [(*x, None, None, None, None, None) for x in _spread_names(ids[code], [(r[2], r[3]) for r in own], [len(x) for x in n])]
                yield _batch([*out, (None, None, lang, int(a.sum()), ids[good], words.dictionary.take(pa.array(good)).cast(pa.string()).to_pylist(), a[good])], fields)

    parts = level.filter("bucket IS NOT NULL").select("bucket", "lang", "block", "start", "data", "words")
    parts = parts.repartition("bucket").sortWithinPartitions("bucket")
    return stored(parts.mapInArrow(run, "block long, data binary, lang string, n long, id array<long>, phrase array<string>, a array<long>"))


def summed(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs as one: where each is found first, its sum, and each entry's pair."""
    if max(left.max(initial=0), right.max(initial=0)) < 1 << 31:
        order = np.argsort(left << 32 | right, kind="stable")
    else:
        order = np.lexsort((right, left))
    x, y = left[order], right[order]
    new = np.ones(len(order), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return order[starts], np.add.reduceat(n[order], starts), of


def named_pairs(level: DataFrame, buckets: int, min_count: int, last: bool) -> DataFrame:
    """Stored rows: (block, data) of named entries, unless they are the last ones; and, without a block, each bucket's frequent pairs (id, left, right, a)."""
    fields = [("block", pa.int64()), ("data", pa.binary()), *[(c, pa.list_(pa.int64())) for c in ("id", "left", "right", "a")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(batches):
            got = [unpacked(r[3]) for r in rows]
            left, right, n = (np.concatenate(x) for x in zip(*[(np.cumsum(x[0]), x[1], x[2]) for x in got], strict=True))
            at, a, of = summed(left, right, n)
            good = np.flatnonzero(a >= min_count)
            ids = np.full(len(a), -1, np.int64)
            ids[good] = np.arange(len(good)) * buckets + bucket
            out = [] if last else [(*x, None, None, None, None) for x in _spread_names(ids[of], [r[1:3] for r in rows], [len(x[0]) for x in got])]
            yield _batch([*out, (None, None, ids[good], left[at[good]], right[at[good]], a[good])], fields)

    parts = level.filter("bucket IS NOT NULL").select("bucket", "block", "start", "data")
    parts = parts.repartition("bucket").sortWithinPartitions("bucket")
    return stored(parts.mapInArrow(run, "block long, data binary, id array<long>, left array<long>, right array<long>, a array<long>"))


def pairs(level: DataFrame, named: DataFrame, buckets: int, last: bool) -> DataFrame:
    """Stored rows of the next level, without sequences if it is the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _grouped(batches):
            seq = [unpacked(r[2])[0] - 1 for r in rows if r[1]]
            names = [unpacked(r[2]) for r in rows if not r[1]]
            if not seq or not names:
                continue
            codes, ids = (np.concatenate(x) for x in zip(*[(np.cumsum(x[0]), x[1]) for x in names], strict=True))
            seq, left, right, n = paired(seq[0].astype(np.int32), codes, ids)
            if not len(left):
                continue
            bucket = (_mixed(left.astype(np.uint64) ^ _mixed(right.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
            seq, order, bucket = by_bucket(seq, bucket, np.lexsort((right, left, bucket)))
            left, right, n = left[order], right[order], n[order]

            def part(a: int, b: int) -> tuple[bytes, None]:
                return packed(np.diff(left[a:b], prepend=0), right[a:b], n[a:b]), None  # noqa: B023  called at once

            yield _level(block, None, None if last else seq, bucket, part)

    both = level.filter("bucket IS NULL").select("block", F.lit(True).alias("seq"), "data").union(named.filter("block IS NOT NULL").select("block", F.lit(False), "data"))
    return stored(both.repartition("block").sortWithinPartitions("block").mapInArrow(run, _LEVEL))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _found(named: DataFrame, *cols: str) -> DataFrame:
    """What is frequent, one row each."""
    each = named.filter("block IS NULL").select(*[c for c in ("lang",) if c in named.columns], F.explode(F.arrays_zip(*cols)).alias("x"))
    return each.select(*[c for c in each.columns if c != "x"], *[F.col("x")[c].alias(c) for c in cols])


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, lang_col: str = "lang", text_col: str = "text") -> tuple[list[DataFrame], DataFrame]:
    """Stored tables of the frequent words, pairs, ... up to ``max_words`` words, and each language's count of words.

    A table has (id, lang, phrase, a, pf, sf, left, right, la, ra): ``a``
    occurrences, the counts ``pf`` of its prefixes and ``sf`` of its suffixes of
    1, 2, ... words, its parents and their counts.
    """
    level, buckets = blocks(docs, lang_col, text_col)
    named = named_words(level, buckets, min_count)
    none, empty = F.lit(None).cast("long"), F.array().cast("array<long>")
    total = stored(named.filter("block IS NULL").groupBy("lang").agg(F.sum("n").alias("n")))
    tables = [stored(_found(named, "id", "phrase", "a").select("id", "lang", "phrase", "a", empty.alias("pf"), empty.alias("sf"), *[none.alias(c) for c in ("left", "right", "la", "ra")]))]
    for k in range(2, max_words + 1):
        # a pair's places are places of what is frequent
        buckets = _buckets(docs, tables[-1].agg(F.sum("a")).first()[0], BUCKET_PLACES)
        after = pairs(level, named, buckets, k == max_words)
        discard(level, named)
        level, named = after, named_pairs(after, buckets, min_count, k == max_words)
        tables.append(stored(_told(_found(named, "id", "left", "right", "a"), tables[-1])))
    discard(level, named)
    return tables, total


def _told(found: DataFrame, shorter: DataFrame) -> DataFrame:
    """The pairs with what their parents say."""
    left = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begins"), F.col("a").alias("la"), "pf")
    right = shorter.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("ends"), F.col("a").alias("ra"), "sf")
    both = found.join(left, "left").join(right, "right")
    phrase = F.concat_ws(" ", "begins", "ends").alias("phrase")
    return both.select("id", "lang", phrase, "a", F.concat("pf", F.array("la")).alias("pf"), F.concat("sf", F.array("ra")).alias("sf"), "left", "right", "la", "ra")


def cut_score(a: str, n: str, left: str, right: str) -> Column:
    """``floor(1000 a n / (l r))``, exactly."""
    big = "CAST({} AS DECIMAL(17, 0))"
    return F.expr(f"(1000 * {big.format(a)} * {big.format(n)}) div ({big.format(left)} * {big.format(right)})")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    tables, total = phrases(docs, min_count, max_words, lang_col, text_col)
    cols = ["lang", "phrase", "a", "pf", "sf"]
    found = None
    for k, now in enumerate(tables[1:], 1):
        if k + 1 < len(tables):
            longer = tables[k + 1]
            inside = longer.filter("a = la").select(F.col("left").alias("id")).union(longer.filter("a = ra").select("right"))
            now = now.join(inside.distinct(), "id", "left_anti")
        found = now.select(*cols) if found is None else found.union(now.select(*cols))
    cut = found.join(total, "lang").select("lang", "phrase", "a", "n", F.posexplode(F.arrays_zip(F.col("pf").alias("l"), F.reverse("sf").alias("r"))).alias("k", "x"))
    cut = cut.select("lang", "phrase", "a", "n", "k", "x.l", "x.r").withColumn("score", cut_score("a", "n", "l", "r"))
    best = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    best = best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
