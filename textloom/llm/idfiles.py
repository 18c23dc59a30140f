"""Token ids as binary files, with a minimal perfect hash index for keyed access.

The files. ``shard=K/part-*`` holds the raw ids of many documents, little-endian,
two bytes each if the vocabulary allows it and four otherwise, in ascending
order of keys and nothing else: a document's ids, then the end id. Spark writes
them, so any store that Spark reaches will do: a row is a document's payload,
and the writer's line separator is the end id's bytes. ``index/`` holds the
index, ``shards/`` where each shard starts, ``meta/`` the width and the counts.

The index. Keys are dealt into buckets by hash. A bucket's keys get a minimal
perfect hash by levels: a level is a bit array of about twice as many places as
keys are left, and a key stays there if no other one falls on its place; the
rest goes on to the next level. A key's slot is the number of set bits before
its own. Slots hold the document's place and a fingerprint of 64 further bits,
by which keys that were never indexed are told apart. So a key costs one bucket,
some two bit tests and one slot, and no key is stored. Keys that are looked up
stream past their bucket, and places that are read past their shard: rows are
dealt and sorted so that the bucket or the shard comes first.

The hash of a key is 128 bits wide, taken of the key and a number: documents
that share a key are numbered in the order of the files, and the first one's
slot says how many there are.

Places are prefix sums: rows are sorted within ranges of keys, a range's sum is
shifted by those of the ranges before, and only one row a range meets the one
before it. A shard takes the documents that start within ``shard_ids`` ids (a
document counts ``ROW_COST`` more, so that a shard's number of documents is
bounded as well), so a task holds a shard and no more, but for a document that
is longer by itself. Copies of a key are dealt by the rows' own hashes, so a key
that a third of all rows share is many ranges.

Defined cases: a null text counts as empty, which leaves the end id alone; null
keys come first and are a key like any other; repeated rows are documents of
their own; among equal keys the order is that of the ids' hash, then any; an
empty table makes an index without shards; other columns don't matter. Keys
are integers, strings, dates or decimals (Spark and Python order them alike).
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import bpe
from textloom.session import discard, keep, shared_dir, spread, stored

END_ID = 2
#: Ids of a shard: a part of all, within bounds that a task can hold; and what a document counts besides its ids.
SHARDS, LEAST_IDS, MOST_IDS, ROW_COST = 1024, 1 << 18, 1 << 24, 8
#: Keys of a bucket, about; places of a level for each key.
BUCKET_KEYS, SPARE = 1 << 15, 2
#: Rows of a range in which places are summed up, about.
RANGE_ROWS = 1 << 17
#: Levels of a bucket; half of the keys stay at each, so this is never reached by distinct hashes.
LEVELS = 64
#: Bits of the window and of the table by which a row's ids, and a shard's, are compressed while they are stored and
#: shuffled; files hold them as they are.
ROW_SEARCH, SHARD_SEARCH = (19, 18), (20, 17)
#: Documents whose first characters give the dictionary by which rows are compressed: it saves space, whatever they are.
HINT_DOCS, HINT_CHARS, HINT_BYTES = 128, 4096, 1 << 18
#: Texts of more characters are encoded by the automaton, and those that have words or runs of white space of
#: twice the second number (some that have them of once as many).
LONG_TEXT, LONG_WORD = 1 << 22, 4096
#: Fixed value: the published pre-splitting pattern of byte-level vocabularies, as the library of merge ranks spells it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same where no two characters of white space meet: without the look-ahead the library matches by automata.
SINGLE_PATTERN = PATTERN.replace(r"|\s+(?!\S)", "")
#: Fixed value: the characters of white space (Unicode's White_Space).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Bytes of the shards' first keys up to which they are broadcast; beyond, places are joined.
BOUND_BYTES = 1 << 25
#: What a slot holds.
SLOT = np.dtype([("mark", "<u8"), ("start", "<u8"), ("shard", "<u4"), ("ids", "<u8"), ("copies", "<u8")])


# --- the hash ----------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(h: np.ndarray, g: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_mixed(h ^ _mixed(g + np.uint64(level))) % np.uint64(size)).astype(np.int64)


def mark(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The fingerprint of a key."""
    return _mixed(g ^ _mixed(h))


def build_levels(h: np.ndarray, g: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and all their bits, for keys of two distinct words each."""
    sizes, bits, left = [], [], np.arange(len(h))
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("two keys have one hash")
        size = -(-SPARE * len(left) // 64) * 64
        at = _place(h[left], g[left], len(sizes), size)
        n = np.bincount(at, minlength=size)
        sizes.append(size)
        bits.append(n == 1)
        left = left[n[at] > 1]
    return sizes, np.concatenate(bits) if bits else np.empty(0, bool)


def slots(h: np.ndarray, g: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Each key's slot; -1 where no level has it, as for most keys that were not indexed."""
    before = np.cumsum(bits) - bits
    out, left, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    for level, size in enumerate(sizes):
        at = base + _place(h[left], g[left], level, size)
        hit = bits[at]
        out[left[hit]] = before[at[hit]]
        left, base = left[~hit], base + size
    return out


def _hashes(key: Column, nth: Column) -> list[Column]:
    """128 bits of a key and a number."""
    return [F.xxhash64(F.lit(k), key, key.isNull(), nth.cast("long")).alias(a) for k, a in ((1, "h"), (2, "g"))]


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), "h", "g"), F.lit(n)).alias("bucket")


# --- writing -----------------------------------------------------------------------------------


class Encoder:
    """Encodes as `bpe.TextCodec` does; by the library of merge ranks where that is the same.

    Ranks say which pieces of a word merge first by what they make, merges say
    it by the pieces. If ids come in the order of merges and every merge can
    fire, both are one: the inside of a label merges alike wherever it stands, so
    it is made of the pieces of its merge and no others. Very long texts, words
    and runs of white space go to the automaton, whose time and stack are bounded.
    """

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        self.codec, self.quick, self.single = bpe.TextCodec(spec), None, None
        model, auto, alphabet = spec["model"], self.codec.encoder.auto, bpe.byte_alphabet()
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        base = [model["vocab"].get(c, -1) for c in alphabet]
        if not model.get("end_of_word_suffix") and made == sorted(made) and min(base) >= 0 and max(base) < min(made, default=1 << 31) and all(i in auto.born for i in made):
            import tiktoken

            ranks = {auto.labels[i]: i for i in [*base, *made]}
            # a special label that is never allowed: with none at all the library looks for an empty one at every place
            never = {"<|never|>": max(ranks.values()) + 1}
            self.quick, self.single = (tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens=never) for p in (PATTERN, SINGLE_PATTERN))

    def plain(self, text: str) -> bool:
        """Whether a text is of common shape and names no added label."""
        if self.quick is None or len(text) > LONG_TEXT or any(t in text for t in self.codec.added):
            return False
        # a blank, and something that is none, in every stretch: words and runs are less than two stretches long
        stretches = range(0, len(text) - LONG_WORD + 1, LONG_WORD)
        return all(text.find(" ", i, i + LONG_WORD) >= 0 and not text[i : i + LONG_WORD].isspace() for i in stretches)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids as the library's own array: none of them becomes a Python number."""
        if text and self.plain(text):
            return (self.quick if has_runs(text) else self.single).encode_to_numpy(text, disallowed_special=())
        return np.frombuffer(self.codec.encode(text), "<u4")

    def encode(self, text: str | None) -> list[int]:
        return self.ids(text).tolist()


def has_runs(text: str) -> bool:
    """Whether two characters of white space meet anywhere."""
    kinds = [c for c in (SPACES[:6] if text.isascii() else SPACES) if c in text]
    return any(a + b in text for a in kinds for b in kinds)


def packed(ids: np.ndarray, width: int) -> bytes:
    """Ids as little-endian integers of so many bytes; `write` sees to it that they fit."""
    return ids.astype(f"<u{width}").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def _hint(content: bytes) -> zstandard.ZstdCompressionDict | None:
    """The dictionary of rows; without enough content there is none."""
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 64 else None


def search(window: int, table: int) -> zstandard.ZstdCompressionParameters:
    """The quickest search, for four bytes alike: levels that search as little want five or more, and many words are two ids."""
    return zstandard.ZstdCompressionParameters(window_log=window, hash_log=table, chain_log=16, search_log=1, min_match=4, target_length=0, strategy=zstandard.STRATEGY_FAST)


def _row_compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Compresses rows by their dictionary, which is prepared once, not for each row."""
    hint = _hint(content)
    if hint is None:
        return zstandard.ZstdCompressor(compression_params=search(*ROW_SEARCH))
    hint.precompute_compress(compression_params=search(*ROW_SEARCH))
    return zstandard.ZstdCompressor(dict_data=hint)


def _encoded(docs: DataFrame, blob: bytes, width: int, key_col: str, text_col: str) -> tuple[DataFrame, bytes]:
    """Stored rows (key, ids, n, h, row), and the content of their dictionary.

    ``ids`` is the compressed payload without the end id, ``n`` its number of ids with it.
    """
    digest, sent = hashlib.sha256(blob).hexdigest(), docs.sparkSession.sparkContext.broadcast(blob)

    def encoder() -> Encoder:
        if digest not in _ENCODERS:
            _ENCODERS[digest] = Encoder(sent.value)
        return _ENCODERS[digest]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([packed(encoder().ids(x.as_py()), width) for x in batch.column(0)], pa.binary())], ["ids"])

    # some documents, each but its first characters: a bounded size, on which no result depends
    few = docs.select(F.substring(docs[text_col], 1, HINT_CHARS).alias("text")).filter("text <> ''").limit(HINT_DOCS)
    hint = b"".join(r["ids"] for r in few.mapInArrow(sampled, "ids binary").collect())[-HINT_BYTES:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, codec = encoder().ids, _row_compressor(hint)
        for big in batches:
            for at in range(0, big.num_rows, 64):  # few texts at once: memory follows the texts, not the batch
                batch, ids, n, h = big.slice(at, 64), [], [], []
                for text in batch.column(1):
                    got = encode(text.as_py())
                    raw = packed(got, width)
                    n.append(len(got) + 1)
                    ids.append(codec.compress(raw))
                    h.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(h, pa.int64())], ["key", "ids", "n", "h"])

    kind = docs.schema[key_col].dataType.simpleString()
    made = spread(docs.select(docs[key_col].alias("key"), docs[text_col].alias("text"))).mapInArrow(run, f"key {kind}, ids binary, n long, h long")
    # the row's own number tells equal rows apart and is the same wherever the stored table is read
    return stored(made.select("key", "ids", "n", "h", F.monotonically_increasing_id().alias("row"))), hint


def _sharded(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The rows with their shard.

    A shard is known by its first row, so where the list of those is small, rows
    are looked up in it where they are; otherwise they are joined with their places.
    """
    first = places.groupBy("shard").agg(F.min_by(F.struct("key", "h", "row"), "start").alias("x"))
    size = first.agg(F.sum(F.coalesce(F.octet_length(F.col("x.key").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    if size > BOUND_BYTES:
        return rows.join(places.select("row", "shard"), "row")
    found = sorted((_ordered(*r["x"]), r["shard"]) for r in first.collect())
    sent = rows.sparkSession.sparkContext.broadcast(([x for x, _ in found], [s for _, s in found]))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", shard int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, shards = sent.value
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            keys = zip(*[col[c].to_pylist() for c in ("key", "h", "row")], strict=True)
            at = [shards[bisect_right(bounds, _ordered(*x)) - 1] for x in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "shard"])

    return rows.mapInArrow(run, schema)


def _ordered(key, h: int, row: int) -> tuple:
    """A row's place in the order of the files; null keys come first."""
    return (key is not None, key, h, row) if key is not None else (False, h, row)


def placed(rows: DataFrame, shard_ids: int | None = None) -> DataFrame:
    """Stored (row, key, h, n, start, nth, shard) of rows (key, h, row, n), in ascending order of keys.

    ``start`` counts the ids before, ``nth`` the documents before with the same key.
    """
    narrow = rows.select("key", "h", "row", "n")
    size = narrow.agg(F.count("*").alias("docs"), F.sum("n").alias("ids")).first()
    shard_ids = shard_ids or min(max((size["ids"] or 0) // SHARDS, LEAST_IDS), MOST_IDS)
    ranges = max(size["docs"] // RANGE_ROWS, rows.sparkSession.sparkContext.defaultParallelism)
    ranged = stored(narrow.repartitionByRange(ranges, "key", "h", "row").withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part").orderBy("key", "h", "row")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = ~F.lag("key").over(order).eqNullSafe(F.col("key")) | (F.row_number().over(order) == 1)
    dealt = ranged.withColumn("own", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("i", F.row_number().over(order)).withColumn("new", new)
    # of a run of equal keys: where it starts in its range
    dealt = stored(dealt.withColumn("run", F.max(F.when(F.col("new"), F.col("i"))).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    discard(ranged)
    sums = dealt.groupBy("part").agg(F.sum("n").alias("ids"), F.count("*").alias("docs"), F.min_by("key", "i").alias("first"), F.max_by("key", "i").alias("last"), F.max("run").alias("tail"))
    # one row for each range
    every = Window.partitionBy(F.lit(0)).orderBy("part")
    gone = every.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ids_before", F.coalesce(F.sum("ids").over(gone), F.lit(0))).withColumn("docs_before", F.coalesce(F.sum("docs").over(gone), F.lit(0)))
    # a range whose first key is the last one of the range before goes on with that one's run
    follows = F.lag("last").over(every).eqNullSafe(F.col("first")) & F.lag("part").over(every).isNotNull()
    whole = F.col("tail") == 1  # one key all along
    opens = F.when(~(follows & whole), F.col("docs_before") + F.col("tail"))
    sums = sums.withColumn("opened", F.last(opens, ignorenulls=True).over(gone)).withColumn("follows", follows)
    found = dealt.join(sums.select("part", "ids_before", "docs_before", "opened", "follows"), "part")
    first = F.when((F.col("run") == 1) & F.col("follows"), F.col("opened")).otherwise(F.col("docs_before") + F.col("run"))
    found = found.select("row", "key", "h", "n", (F.col("own") + F.col("ids_before")).alias("start"), (F.col("docs_before") + F.col("i") - first).alias("nth"), (F.col("docs_before") + F.col("i") - 1).alias("at"))
    shard = F.floor((F.col("start") + ROW_COST * F.col("at")) / shard_ids).cast("int").alias("shard")
    out = stored(found.select("row", "key", "h", "n", "start", "nth", shard))
    discard(dealt)
    return out


def write(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = END_ID, shard_ids: int | None = None, width: int | None = None, key_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode ``docs`` and write files and index to ``path``, a new folder (default: in the shared one); returns it.

    ``width`` is the bytes of an id: 2 or 4, by default what the vocabulary needs.
    """
    spark = docs.sparkSession
    if path is None:
        path = keep(f"{shared_dir(spark)}/textloom-ids-{uuid.uuid4().hex}")
    blob = bpe.read_file(spark, vocabulary)
    spec = json.loads(blob)
    top = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    width = width or (2 if top < 1 << 16 else 4)
    if top >> 8 * width:
        raise ValueError(f"id {top} needs more than {width} bytes")
    rows, hint = _encoded(docs, blob, width, key_col, text_col)
    places = placed(rows, shard_ids)
    kind = rows.schema["key"].dataType.simpleString()

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor(dict_data=_hint(hint))
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            ids = [codec.decompress(x.as_py()) for x in col["ids"]]
            yield pa.RecordBatch.from_arrays([*[col[c] for c in ("shard", "key", "h", "row")], pa.array(ids, pa.binary())], ["shard", "key", "h", "row", "ids"])

    payload = _sharded(rows, places).repartition("shard").mapInArrow(opened, f"shard int, key {kind}, h long, row long, ids binary")
    # one task writes a shard, in order: it is sorted by the folder first, so the writer adds no sort of its own
    payload = payload.sortWithinPartitions("shard", "key", "h", "row").select(F.col("ids").cast("string").alias("ids"), "shard")
    end = end_id.to_bytes(width, "little").decode("latin-1")
    payload.write.partitionBy("shard").option("lineSep", end).option("encoding", "ISO-8859-1").text(f"{path}/ids")
    discard(rows)
    counts = places.agg(F.count("*").alias("docs"), F.sum("n").alias("ids")).first()
    buckets = 1 + counts["docs"] // BUCKET_KEYS
    places.groupBy("shard").agg(F.min("start").alias("first"), F.sum("n").alias("ids")).write.parquet(f"{path}/shards")
    _index(places, buckets).write.parquet(f"{path}/index")
    meta = {"width": width, "end_id": end_id, "docs": counts["docs"], "ids": counts["ids"] or 0, "buckets": buckets, "vocabulary_sha256": hashlib.sha256(blob).hexdigest()}
    spark.range(1).select(F.lit(json.dumps(meta)).alias("value")).coalesce(1).write.text(f"{path}/meta")
    discard(places)
    return path


def _index(places: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, keys, sizes, bits, slots) of all documents."""
    # only keys of several documents have a row here
    more = places.filter("nth > 0").groupBy("key").agg((F.max("nth") + 1).alias("copies"))
    firsts = places.filter("nth = 0").alias("a").join(more.alias("b"), F.col("a.key").eqNullSafe(F.col("b.key")), "left").select("a.*", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    every = firsts.unionByName(places.filter("nth > 0").withColumn("copies", F.lit(0).cast("long")))
    every = every.select(*_hashes(F.col("key"), F.col("nth")), "start", "shard", F.col("n").alias("ids"), "copies")
    every = every.withColumn("bucket", _bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket")

    def made(key: int, rows: pa.Table) -> pa.RecordBatch:
        h, g = (rows.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("h", "g"))
        sizes, bits = build_levels(h, g)
        out = np.zeros(len(h), SLOT)
        at = slots(h, g, sizes, bits)
        for c in ("start", "shard", "ids", "copies"):
            out[c][at] = rows.column(c).to_numpy()
        out["mark"][at] = mark(h, g)
        cols = [pa.array([key], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([sizes], pa.list_(pa.int64())), pa.array([np.packbits(bits).tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["bucket", "keys", "sizes", "bits", "slots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come bucket by bucket; one bucket is held
        held, now = [], None
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("bucket")).to_numpy()
            for a, b in _runs(keys):
                if held and keys[a] != now:
                    yield made(now, pa.Table.from_batches(held))
                    held = []
                now = int(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield made(now, pa.Table.from_batches(held))

    return every.mapInArrow(run, "bucket long, keys long, sizes array<long>, bits binary, slots binary")


# --- reading -----------------------------------------------------------------------------------


def meta(spark: SparkSession, path: str) -> dict:
    """What the files say of themselves: a line."""
    return json.loads(spark.read.text(f"{path}/meta").first()["value"])


def _probed(spark: SparkSession, path: str, asked: DataFrame, buckets: int) -> DataFrame:
    """``asked`` (key, nth) that are in the index, with start, shard, ids and copies."""
    index = spark.read.parquet(f"{path}/index").select("bucket", "sizes", "bits", "slots")
    dealt = asked.select("key", "nth", *_hashes(F.col("key"), F.col("nth"))).withColumn("bucket", _bucket(buckets))
    kind = asked.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sizes, bits, table = None, [], np.empty(0, bool), np.empty(0, SLOT)
        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for a, b in _runs(col["bucket"].to_numpy()):
                if col["slots"][a].is_valid:  # the bucket comes before its keys
                    now, sizes = col["bucket"][a].as_py(), col["sizes"][a].as_py()
                    bits = np.unpackbits(np.frombuffer(col["bits"][a].as_py(), np.uint8), count=sum(sizes)).astype(bool)
                    table = np.frombuffer(col["slots"][a].as_py(), SLOT)
                    a += 1
                if a == b or col["bucket"][a].as_py() != now:
                    continue
                h, g = (col[c].slice(a, b - a).to_numpy().view(np.uint64) for c in ("h", "g"))
                at = slots(h, g, sizes, bits)
                good = np.flatnonzero(at >= 0)
                good = good[table["mark"][at[good]] == mark(h[good], g[good])]
                found, take = table[at[good]], pa.array(good + a)
                cols = [col["key"].take(take), col["nth"].take(take), *[pa.array(found[c].astype(np.int64)) for c in ("start", "shard", "ids", "copies")]]
                yield pa.RecordBatch.from_arrays(cols, ["key", "nth", "start", "shard", "n", "copies"])

    return _streamed(index, dealt, "bucket", "slots").mapInArrow(run, f"key {kind}, nth long, start long, shard long, n long, copies long")


def _streamed(holders: DataFrame, rows: DataFrame, by: str, last: str) -> DataFrame:
    """Both tables dealt by a column; in each part, the holder comes before its rows."""
    both = holders.unionByName(rows, allowMissingColumns=True)
    return both.repartition(by).sortWithinPartitions(by, F.col(last).isNull())


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each run of equal keys begins and ends."""
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def lookup(spark: SparkSession, path: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Places (key, nth, start, shard, n) of all documents with one of the keys; keys that aren't there give no row."""
    told = meta(spark, path)
    asked = keys.select(F.col(f"`{key_col}`").alias("key")).distinct().withColumn("nth", F.lit(0).cast("long"))
    first = stored(_probed(spark, path, asked, told["buckets"]))
    rest = first.filter("copies > 1").select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies") - 1)).alias("nth"))
    return first.unionByName(_probed(spark, path, rest, told["buckets"])).drop("copies")


def read(spark: SparkSession, path: str, places: DataFrame, ids: bool = True) -> DataFrame:
    """``places`` with ``ids_crc32`` of each document's ids as 32-bit integers and, if asked for, the ids, from the files.

    A shard's file is read once, by the task that has the places asked for in it.
    """
    told = meta(spark, path)
    width = told["width"]
    if told["docs"]:
        files = spark.read.format("binaryFile").load(f"{path}/ids").select(F.col("shard").cast("long").alias("shard"), "content")
    else:  # no shards, so no folder that names one
        files = spark.createDataFrame([], "shard long, content binary")
    firsts = spark.read.parquet(f"{path}/shards").select(F.col("shard").cast("long").alias("shard"), "first")
    kind = places.schema["key"].dataType.simpleString()
    names = ["key", "nth", "start", "shard", "n", "ids_crc32"] + ["ids"] * ids

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(compression_params=search(*SHARD_SEARCH))  # one context for all shards
        for batch in batches:
            for shard, content in zip(*batch.columns, strict=True):
                raw = content.as_buffer()
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()], pa.int64()), pa.array([raw.size], pa.int64()), pa.array([codec.compress(raw)], pa.binary())], ["shard", "size", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = np.empty(0), 0
        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for a, b in _runs(col["shard"].to_numpy()):
                if col["content"][a].is_valid:  # the shard comes before its places
                    raw = pa.decompress(col["content"][a].as_buffer(), col["size"][a].as_py(), "zstd", asbytes=True)
                    held, first = np.frombuffer(raw, f"<u{width}"), col["first"][a].as_py()
                    a += 1
                for at in range(a, b, 4096):
                    size = min(4096, b - at)
                    place = {c: col[c].slice(at, size) for c in names[:5]}
                    parts = [held[s - first : s - first + n].astype("<u4") for s, n in zip(place["start"].to_pylist(), place["n"].to_pylist(), strict=True)]
                    cols = [*place.values(), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                    if ids:
                        cols.append(pa.array([p.view("<i4") for p in parts], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(cols, names)

    files = files.mapInArrow(compressed, "shard long, size long, content binary")
    met = _streamed(files.join(firsts, "shard"), places.select(*names[:5]), "shard", "content")
    return met.mapInArrow(run, f"key {kind}, nth long, start long, shard long, n long, ids_crc32 long" + ", ids array<int>" * ids)
