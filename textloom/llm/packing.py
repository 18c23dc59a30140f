"""Best-fit packing of tokenised documents by minimum bin slack.

Each document becomes its ids plus one end id; a document longer than a
sequence is cut into full pieces and one last piece. Pieces then fill
sequences: per bin, a bitset subset-sum over the lengths that are left finds
the fullest combination that holds the longest of them, and that combination
is removed. Only the histogram of lengths matters for that, and it has at most
``capacity`` entries whatever the corpus, so the driver plans on the histogram
and a combination is removed as often as the counts allow at once. Pieces find
their place by their rank among those of their length: a rank within hashed
buckets plus the count of earlier buckets, so a length shared by a third of
all pieces is still dealt over many tasks.

Defined cases: a null or empty text is the end id alone; a repeated row is a
document of its own; an empty table gives no rows; other columns of the input
don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bpe import LONGEST_KEPT, byte_alphabet, read_file
from textloom.session import spread, stored

CAPACITY = 2048
#: Orders of the lengths that are tried while a plan needs more bins than the sum of lengths.
TRIES = 24
#: Entries of a worker's table of encoded chunks.
CHUNK_CACHE = 800_000
#: Pieces of a rank bucket, about.
BUCKET_ROWS = 50_000


#: What a description says whose words are runs of letters, single digits and runs of
#: other signs, in lower case, with white space dropped.
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# The characters that Unicode calls white space.
WHITE_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def splits_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer's description makes white space a border that leaves no ids."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split, rest = steps[0], steps[1:]
    plain = all(r.get("type") == "ByteLevel" and not r.get("add_prefix_space") and not r.get("use_regex", True) for r in rest)
    cut = split.get("pattern") == {"Regex": WORD_PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
    added = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized")) for t in spec.get("added_tokens", []))
    same = (spec.get("normalizer") or {}).get("normalizers") == WORD_NORMALIZERS
    return same and cut and plain and len(rest) == 1 and added and not spec.get("post_processor") and not spec["model"].get("dropout")


class Chunked:
    """Encodes a text as its tokenizer does, chunk by chunk at white space.

    Only for vocabularies that drop white space and treat it as a border, which
    the parsed description must say (`splits_at_blanks`); others are encoded by
    the library, whole text by whole text. Chunks are encoded by the library and
    kept in a bounded table.
    """

    def __init__(self, blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_chunk = splits_at_blanks(json.loads(blob))
        self.table: dict[str, bytes] = {}
        # marks may compose with a letter before it is lower-cased; a run of punctuation, or of marks
        # that a letter turns into, must stay whole: only plain letters and digits may precede a cut
        self.marks = re.compile(r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]|<\|")
        # a chunk of such letters is one word that normalising leaves alone: the library's model takes it as it is
        self.word = re.compile(r"[a-zß-öø-ÿ]+")
        self.model = self.tokenizer.model
        self.stand_ins = {b: c for c, b in byte_alphabet().items()}
        probe = "übere"
        if self._word(probe) != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            self.word = re.compile(r"(?!)")
        # white space of the vocabulary's by name: U+001C to U+001F are some of Python's only
        self.runs = re.compile(rf"[^0-9A-Za-zÀ-ÖØ-öø-įı-ſ{WHITE_SPACE}][.,]")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_chunk:
            got = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [_packed(e.ids) for e in got]
        out = []
        for text in texts:
            chunks = self._chunks(text or "")
            table = self.table
            try:
                out.append(b"".join(map(table.__getitem__, chunks)))
            except KeyError:
                missing = list(dict.fromkeys(c for c in chunks if c not in table))
                if len(table) + len(missing) > CHUNK_CACHE:
                    table.clear()
                    missing = list(dict.fromkeys(chunks))
                rest = []
                for c in missing:
                    if self.word.fullmatch(c):
                        table[c] = _packed(self._word(c))
                    else:
                        rest.append(c)
                for k in range(0, len(rest), 4096):
                    part = rest[k : k + 4096]
                    got = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
                    table.update(zip(part, [_packed(e.ids) for e in got], strict=True))
                out.append(b"".join([table[c] for c in chunks]))
                if max(map(len, missing)) > LONGEST_KEPT:
                    for c in [c for c in missing if len(c) > LONGEST_KEPT]:
                        del table[c]
        return out

    def _word(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.stand_ins))]

    def _chunks(self, text: str) -> list[str]:
        if text.isascii() and "<|" not in text or not self.marks.search(text):
            text = text.encode().lower().decode()
            if not self.runs.search(text):
                text = text.replace(".", " .").replace(",", " ,")
        return text.replace("\n", " ").split(" ")


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


_KEPT: dict[str, Chunked] = {}


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Cut each document's ids: ``id_col``, piece, start, length, ids_crc32 and, if asked for, the ids."""
    spark = docs.sparkSession
    blob = read_file(spark, vocabulary)
    digest, sent = hashlib.sha256(blob).hexdigest(), spark.sparkContext.broadcast(blob)
    end = _packed([end_id])
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _KEPT:
            _KEPT[digest] = Chunked(sent.value)
        coder = _KEPT[digest]
        for big in batches:
            for at in range(0, big.num_rows, 64):  # few texts at once: memory follows the texts, not the batch
                batch = big.slice(at, 64)
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for r, got in enumerate(coder.encode(batch.column(1).to_pylist())):
                    got += end
                    for p, s in enumerate(range(0, len(got), 4 * capacity)):
                        part = got[s : s + 4 * capacity]
                        row.append(r)
                        piece.append(p)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if ids:
                            kept.append(np.frombuffer(part, "<i4"))
                cols = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return spread(docs.select(docs[id_col], docs[text_col])).mapInArrow(run, schema)


def fullest(counts: dict[int, int], capacity: int, rank: dict[int, float] | None = None) -> dict[int, int]:
    """The combination with least slack that holds the longest length left.

    A bit set ``b`` has bit ``s`` set if some choice of the lengths so far sums
    to ``s``. Lengths come in long before short, or by ``rank``: combinations that
    fill a bin alike differ by that. Multiples of one length are added in powers
    of two.
    """
    first = max(counts)
    room = capacity - first
    steps: list[tuple[int, int, int]] = []  # reachable before, length, how many of it
    reach, mask = 1, (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True) if rank is None else sorted(counts, key=rank.__getitem__):
        if length > room:
            continue
        left = min(counts[length] - (length == first), room // length)
        take = 1
        while left > 0 and not reach >> room & 1:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= reach << (length * take) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    found = {first: 1}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + take
            at -= length * take
    return found


def plan(counts: dict[int, int], capacity: int = CAPACITY, tries: int = TRIES) -> list[tuple[int, dict[int, int]]]:
    """All bins: how often each combination is used. At most about as many entries as lengths.

    If there are more bins than the sum of lengths needs, other orders of the
    lengths are tried and the best plan is kept.
    """
    counts = {k: v for k, v in counts.items() if v}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    need = -(-sum(k * v for k, v in counts.items()) // capacity)
    best, rng = None, random.Random(0)
    for attempt in range(tries):
        rank = None if attempt == 0 else {k: k if attempt == 1 else rng.random() for k in counts}
        made = _one_plan(dict(counts), capacity, rank)
        if best is None or sum(t for t, _ in made) < sum(t for t, _ in best):
            best = made
        if sum(t for t, _ in best) <= need:
            break
    return best


def _one_plan(counts: dict[int, int], capacity: int, rank: dict[int, float] | None) -> list[tuple[int, dict[int, int]]]:
    out = []
    while counts:
        found = fullest(counts, capacity, rank)
        times = min(counts[k] // n for k, n in found.items())
        out.append((times, found))
        for k, n in found.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
    return out


def _places(bins: list[tuple[int, dict[int, int]]], capacity: int) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: where its bins begin and the offset in a bin."""
    rows, used, first_bin = [], {}, 0
    for times, found in bins:
        offset = 0
        for length in sorted(found, reverse=True):
            n, rank = found[length], used.get(length, 0)
            rows.append((length, rank, n, first_bin, offset))
            used[length] = rank + times * n
            offset += n * length
        first_bin += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "n", "bin", "offset"), cols, strict=True))


def pack(cut: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Give every piece of a stored table its ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan(counts, capacity), capacity))
    n_buckets = 64 + sum(counts.values()) // BUCKET_ROWS
    dealt = cut.withColumn("__bucket", F.pmod(F.xxhash64(F.col(id_col), F.col("piece"), F.col("ids_crc32")), F.lit(n_buckets)))
    sums = dealt.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__bucket").orderBy(F.col(id_col), "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("__rank", F.row_number().over(within).cast("long")).join(sums, ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before") - 1).select(*cut.columns, "__rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        top = 1 << 44  # ranks below; a length has far fewer pieces
        keys = p["length"] * top + p["rank"]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy()
            at = np.searchsorted(keys, length * top + rank, "right") - 1
            nth = rank - p["rank"][at]
            seq = p["bin"][at] + nth // np.maximum(p["n"][at], 1)
            offset = p["offset"][at] + nth % np.maximum(p["n"][at], 1) * length
            cols = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(seq), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack. The cut table is written once to the shared folder."""
    cut = stored(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, ids))
    return pack(cut, capacity, id_col)
