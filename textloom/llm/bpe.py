"""BPE encoding and decoding with a tokenization automaton.

Compilation. The automaton starts with one state that loops on every base
symbol. Each merge ``a b -> ab`` is applied as a gadget, in rank order:

* the state reached by ``a`` is split: its clone loses the arc ``b``, and all
  arcs labelled ``a`` now lead to the clone (``a`` followed by ``b`` would have
  been merged);
* wherever ``a`` then ``b`` was possible, a new arc ``ab`` leads to where ``b`` led.

All arcs with one label lead to one state, so the automaton is kept as four
arrays: per label its target state, its first half and its birth time; per
state the state it was cloned from, the arc it lost and its birth time. An arc
exists from a state iff `Automaton.arc` says so; both chains only grow older,
so the test is a short walk, and its answers are kept in a bounded table.
The automaton accepts, for each word, exactly one label sequence: its BPE
encoding.

Encoding runs the automaton against a byte trie of the labels, longest arc
first. A prefix has one accepted encoding, hence one state per position: a
position found dead stays dead and is never entered again, which bounds the
work by word length times the labels starting at one position.

Decoding emits the arc labels of the ids and reads the bytes as UTF-8.

Defined cases: a null text counts as empty; an empty text has no ids and
decodes to the empty text; repeated rows give repeated results; texts are never
cut. Extra columns of the input are kept out of the result unless they are
asked for by name.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from textloom.session import spread

#: Bounds of the per-worker tables (entries). They only save time.
WORD_CACHE = 400_000
ARC_CACHE = 400_000
#: Longer words are encoded each time, so the tables hold ``WORD_CACHE`` times this at most.
LONGEST_KEPT = 256

_NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies, by rule."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            table[chr(256 + extra)] = b
            extra += 1
    return table


@dataclass
class Automaton:
    """The compiled automaton; plain lists, so it is broadcast as it is."""

    suffix: str
    base: dict[str, int]
    labels: list[bytes]  # by id: the bytes that an arc emits
    arcs: list[int]  # label ids, for the trie, of base symbols and merges
    target: dict[int, int] = field(default_factory=dict)
    left: dict[int, int] = field(default_factory=dict)
    born: dict[int, int] = field(default_factory=dict)
    parent: list[int] = field(default_factory=lambda: [-1])
    lost: list[int] = field(default_factory=lambda: [-1])
    split_at: list[int] = field(default_factory=lambda: [-1])

    def arc(self, state: int, label: int) -> bool:
        """Whether an arc ``label`` leaves ``state``."""
        while True:
            if self.split_at[state] > self.born[label]:
                if self.lost[state] == label:
                    return False
                state = self.parent[state]
            elif label in self.left:
                label = self.left[label]
            else:
                # a base symbol is older than any split
                return True

    def gadget(self, time: int, a: int, b: int, ab: int) -> bool:
        """Apply the merge ``a b -> ab``; whether it can ever fire.

        A merge of parts that never stand side by side, or that no merge makes,
        adds no arc: its label is emitted by nothing.
        """
        if a not in self.born or b not in self.born:
            return False
        old = self.target[a]
        if not self.arc(old, b):
            return False
        if ab in self.born:
            raise ValueError(f"two merges make label {ab}; this automaton needs one")
        self.born[ab], self.left[ab] = time, a
        self.target[ab] = self.target[b]
        self.parent.append(old)
        self.lost.append(b)
        self.split_at.append(time)
        self.target[a] = len(self.parent) - 1
        return True


def compile_automaton(spec: dict) -> Automaton:
    """Compile the merges of a tokenizer description (the public JSON format)."""
    model = spec["model"]
    if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError("only plain byte-level BPE models are supported")
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    alphabet = byte_alphabet()
    size = 1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))])

    def emitted(token: str) -> bytes:
        if suffix and token.endswith(suffix):
            token = token[: -len(suffix)]
        return bytes(alphabet[c] for c in token)

    labels = [b""] * size
    for token, i in vocab.items():
        if all(c in alphabet for c in (token.removesuffix(suffix) if suffix else token)):
            labels[i] = emitted(token)
    for t in spec.get("added_tokens", []):
        labels[t["id"]] = t["content"].encode()
    base = {}
    for c in alphabet:
        for token in {c, c + suffix}:
            if token in vocab:
                base[token] = vocab[token]
    made = Automaton(suffix, base, labels, list(base.values()))
    for i in base.values():
        made.born[i], made.target[i] = -1, 0
    for time, (a, b) in enumerate(merges):
        ab = vocab[a + b]
        if made.gadget(time, vocab[a], vocab[b], ab):
            made.arcs.append(ab)
    return made


class Encoder:
    """Runs the automaton; one per Python worker."""

    def __init__(self, spec: dict, automaton: Automaton | None = None):
        self.auto = automaton or compile_automaton(spec)
        # Labels that end a word and labels that don't are told apart by the last symbol.
        self.ends = {i for t, i in spec["model"]["vocab"].items() if self.auto.suffix and t.endswith(self.auto.suffix)}
        self.trie: list[dict[int, int]] = [{}]
        self.at: list[int] = [-1]
        final = bool(self.auto.suffix)
        for i in self.auto.arcs:
            node = 0
            word = self.auto.labels[i]
            keys = [*word[:-1], word[-1] + 256 * (final and i in self.ends)]
            for b in keys:
                nxt = self.trie[node].get(b)
                if nxt is None:
                    nxt = len(self.trie)
                    self.trie.append({})
                    self.at.append(-1)
                    self.trie[node][b] = nxt
                node = nxt
            self.at[node] = i
        self.length = [len(x) for x in self.auto.labels]
        self.longest = max((self.length[i] for i in self.auto.arcs), default=0)
        # per label: the next shorter label that begins it
        self.shorter: dict[int, int] = {}
        for i in self.auto.arcs:
            node, last = 0, -1
            word = self.auto.labels[i]
            for b in word[:-1]:
                node = self.trie[node].get(b, -1)
                if node < 0:
                    break
                if self.at[node] >= 0:
                    last = self.at[node]
            self.shorter[i] = last
        self.table: dict[int, bool] = {}
        self.final = final

    def _arc(self, before: int, label: int) -> bool:
        key = before << 20 | label
        known = self.table.get(key)
        if known is None:
            known = self.auto.arc(self.auto.target[before], label)
            if len(self.table) >= ARC_CACHE:
                self.table.clear()
            self.table[key] = known
        return known

    def word(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        keys: Iterable[int] = word
        if self.final and word:
            keys = [*word[:-1], word[-1] + 256]
        n, out, pos, dead = len(word), [], 0, None
        trie, at, length, table, longest = self.trie, self.at, self.length, self.table, self.longest
        label = -1
        while pos < n:
            if label < 0:  # the longest label that begins here
                node = 0
                for b in keys[pos : pos + longest]:
                    node = trie[node].get(b)
                    if node is None:
                        break
                    if at[node] >= 0:
                        label = at[node]
            while label >= 0:
                end = pos + length[label]
                if dead is None or end not in dead:
                    if not out:
                        break
                    ok = table.get(out[-1] << 20 | label)
                    if ok is None:
                        ok = self._arc(out[-1], label)
                    if ok:
                        break
                label = self.shorter[label]
            if label >= 0:
                out.append(label)
                pos += length[label]
                label = -1
            else:  # dead: step back and take a shorter label
                if not out:
                    raise ValueError("the vocabulary lacks a base symbol")
                dead = dead or set()
                dead.add(pos)
                last = out.pop()
                pos -= length[last]
                label = self.shorter[last]
                while label < 0:
                    dead.add(pos)
                    last = out.pop()
                    pos -= length[last]
                    label = self.shorter[last]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the emitted arc labels."""
        labels = self.auto.labels
        return b"".join([labels[i] for i in ids]).decode("utf-8", "replace")


#: Fixed value: the published pre-splitting pattern of byte-level vocabularies.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _packed(ids: list[int]) -> bytes:
    got = array("I", ids)
    if sys.byteorder != "little":
        got.byteswap()
    return got.tobytes()


class _Chunks(dict):
    """Chunk of text -> its ids as bytes, bounded in entries and in what they hold; long chunks aren't kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk):
        got = self.make(chunk)
        if len(chunk) <= LONGEST_KEPT:
            if len(self) >= WORD_CACHE:
                self.clear()
            self[chunk] = got
        return got


class TextCodec:
    """Whole texts to ids and back, for a byte-level vocabulary."""

    def __init__(self, spec: dict, automaton: Automaton | None = None):
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level vocabularies with the usual pre-splitting are supported")
        self.encoder = Encoder(spec, automaton)
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        #: what the fast path can't cut at single blanks and line feeds
        self.odd = regex.compile(r"[^\S \n]|[ \n][ \n]|^[ \n]|[ \n]\Z|[^\S ]\Z")
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or match words are not supported")
        self.added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in spec.get("added_tokens", [])}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.words = _Chunks(lambda w: _packed(self.encoder.word(w.encode())))
        self.chunks = _Chunks(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.words[w] for w in self.pattern.findall(chunk)])

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.odd.search(text):
            return b"".join([self.words[w] for w in self.pattern.findall(text)])
        chunks, parts = self.chunks, []
        for line in text.split("\n"):
            # a word takes the blank before it along; a line feed stands alone
            parts.append(b"".join(map(chunks.__getitem__, line.replace(" ", "\n ").split("\n"))))
        return chunks["\n"].join(parts)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split_added is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join([self.added.get(x) or self._plain(x) for x in self.split_added.split(text)])

    def decode(self, ids: bytes) -> str:
        return self.encoder.decode(np.frombuffer(ids, "<u4").tolist())


_CODECS: dict[str, TextCodec] = {}


def codec_of(digest: str, blob: bytes) -> TextCodec:
    """The worker's codec of a vocabulary, compiled once."""
    if digest not in _CODECS:
        _CODECS.clear()
        _CODECS[digest] = TextCodec(json.loads(blob))
    return _CODECS[digest]


def read_file(spark: SparkSession, path: str) -> bytes:
    """A small file, read on the driver: local, or by Spark's binary reader."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def encode_column(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Encode and decode each text.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and,
    if ``ids``, the ids themselves and the decoded text. The vocabulary file
    (a few MB, its size fixed by the tokenizer) is broadcast.
    """
    spark = docs.sparkSession
    blob = read_file(spark, vocabulary)
    digest = hashlib.sha256(blob).hexdigest()
    sent = spark.sparkContext.broadcast(blob)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(digest, sent.value)
        for batch in batches:
            n, a, b, full, back = [], [], [], [], []
            for text in batch.column(1):
                got = codec.encode(text.as_py())
                out = codec.decode(got)
                n.append(len(got) // 4)
                a.append(hashlib.sha256(got).hexdigest())
                b.append(hashlib.sha256(out.encode()).hexdigest())
                if ids:
                    full.append(np.frombuffer(got, "<i4"))
                    back.append(out)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols += [pa.array(full, pa.list_(pa.int32())), pa.array(back, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return spread(docs.select(docs[id_col], docs[text_col])).mapInArrow(run, schema)
