"""Language-model scoring with a hashed maximum-entropy model.

P(token | history) = P(class | history) * P(token | class). Classes are the most
frequent words, one each, the most frequent word endings, hash classes for the
other endings, and the end of a text. The class is predicted by a softmax over
hashed features of the history: a bias, the class before (bigram), the two
classes before (trigram, hashed) and the class before the last (skip). Within a
class a token has its smoothed relative frequency, and unseen tokens share one
half of a count; the probabilities of a history add up to one.

Counts cover all training texts: words with their counts, and how often each
class follows each pair of classes. The model is trained on the latter, by
gradient updates that are computed in parallel over histories and summed. As a
history has two classes, the trained softmax is tabulated once (``CLASSES`` ** 3
numbers, whatever the corpus) and texts are scored in numpy by lookup.

Words in the corpus are unbounded, so only those above a frequency threshold
that at most ``COMMON`` words pass are broadcast; the rest of a text's words
are counted per text and joined with the stored counts.

Defined cases: a null text counts as empty and scores its end; an empty training
set gives uniform classes; repeated rows are scored alike and count as often as
they occur; other columns are not read; texts are read in slices, so memory
doesn't follow their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import spread, stored

#: Softmax classes, with the start of a text (never predicted) as 0 and its end as 1.
CLASSES, START, END = 128, 0, 1
OWN_WORDS, HASHED = 48, 16
TRIGRAM_BUCKETS = 1024
#: At most so many words are broadcast.
COMMON = 1 << 18
ROUNDS, RATE, TRAIN_PARTS = 12, 0.5, 4
SLICE = 1 << 20
FLUSH = 400_000


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """Lower-cased words of a whole text, slice by slice."""
    data = (text or "").encode().lower()
    at = 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and data[end] not in b" \t\n\x0b\f\r":
            end += 1
        yield data[at:end].split()
        at = end


def ending(word: bytes) -> bytes:
    """What stands for a word without a class of its own."""
    return word.rstrip(b".,;:!?")[-2:]


@dataclass
class Classes:
    """Which class a word has."""

    own: dict[bytes, int]
    endings: dict[bytes, int]
    known: dict[bytes, int] = field(default_factory=dict)

    def of(self, word: bytes) -> int:
        got = self.own.get(word)
        if got is None:
            tail = ending(word)
            got = self.endings.get(tail)
            if got is None:
                got = CLASSES - HASHED + zlib.crc32(tail) % HASHED
        return got


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over a one-column table of texts; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                for words in tokens(text.as_py()):
                    counts.update(words)
                counts[b""] += 1
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        yield out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_threshold(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words reach, on a scale of eighths of powers of two."""
    scale = F.floor(F.log2("n") * 8).cast("int")
    left, low = most, None
    for step, n in sorted(((r[0], r[1]) for r in counts.groupBy(scale.alias("s")).agg(F.count("*")).collect()), reverse=True):
        left -= n
        if left < 0:
            break
        low = step
    return 1 << 62 if low is None else int(np.ceil(2 ** (low / 8) - 1e-9))


def _by_word(counts: DataFrame, key, schema: str, names: list[str], top: int) -> list:
    """The ``top`` keys by count, of keys that a function gives words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: Counter = Counter()
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w:
                    sums[key(w)] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(sums.keys()), pa.binary()), pa.array(list(sums.values()), pa.int64())], names)

    made = counts.mapInArrow(run, schema).groupBy(names[0]).agg(F.sum("n").alias("n"))
    return [bytes(r[0]) for r in made.orderBy(F.desc("n"), names[0]).limit(top).collect()]


def make_classes(counts: DataFrame) -> Classes:
    own = [bytes(r[0]) for r in counts.filter(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(OWN_WORDS).collect()]
    endings = _by_word(counts, ending, "ending binary, n long", ["ending", "n"], CLASSES - HASHED - 2 - OWN_WORDS)
    first = 2 + OWN_WORDS
    return Classes({w: 2 + i for i, w in enumerate(own)}, {e: first + i for i, e in enumerate(endings)})


@dataclass
class Vocabulary:
    """Common words with their counts, and the totals."""

    classes: Classes
    index: dict[bytes, int]
    n: np.ndarray
    cls: np.ndarray
    total: int
    distinct: int
    in_class: np.ndarray  # tokens of each class
    of_class: np.ndarray  # words of each class

    @property
    def base_divisor(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    @property
    def class_divisor(self) -> np.ndarray:
        return self.in_class + 0.5 * (self.of_class + 1)


def is_common(classes: Classes, least: int) -> Column:
    """Whether a word is in the broadcast part: by its count, or for a class of its own."""
    return (F.col("n") >= least) | F.col("word").isin([bytearray(w) for w in classes.own])


def vocabulary(counts: DataFrame, most: int = COMMON) -> tuple[Vocabulary, int]:
    """The bounded part of the counts, and the threshold above which a word is in it."""
    classes = make_classes(counts)
    spark = counts.sparkSession
    sent = spark.sparkContext.broadcast(classes)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            cls = np.array([sent.value.of(w) if w else END for w in batch.column(0).to_pylist()], np.int64)
            np.add.at(tokens_, cls, batch.column(1).to_numpy())
            np.add.at(words, cls, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(tokens_), pa.array(words)], ["c", "t", "w"])

    in_class, of_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, t, w in counts.mapInArrow(totals, "c long, t long, w long").groupBy("c").agg(F.sum("t"), F.sum("w")).collect():
        in_class[c], of_class[c] = t, w
    least = common_threshold(counts, most)
    rows = counts.filter(is_common(classes, least)).toArrow()
    words = rows.column("word").to_pylist()
    vocab = Vocabulary(
        classes,
        {w: i for i, w in enumerate(words) if w},
        rows.column("n").to_numpy().astype(np.float64),
        np.array([classes.of(w) if w else END for w in words], np.int32),
        int(in_class.sum()),
        int(of_class.sum()),
        in_class,
        of_class,
    )
    return vocab, least


def _class_ids(vocab: Vocabulary, words: list[bytes], cache: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Per word its index (or -1) and class; the words that have no index."""
    index = np.fromiter(map(vocab.index.get, words, repeat(-1)), np.int32, len(words))
    cls = vocab.cls[index] if len(vocab.cls) else np.zeros(len(words), np.int32)
    rare_at = np.flatnonzero(index < 0)
    rare = [words[i] for i in rare_at.tolist()]
    if rare:
        if len(cache) > FLUSH:
            cache.clear()
        got = []
        for w in rare:
            c = cache.get(w)
            if c is None:
                c = cache[w] = vocab.classes.of(w)
            got.append(c)
        cls[rare_at] = got
    return index, cls, rare


def history_counts(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(history, list of (class, n)): how often each class follows two classes."""
    sent = texts.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, cache = sent.value, {}
        sums, waiting, held = np.zeros(CLASSES**3, np.int64), [], 0
        last = np.array([END], np.int32)
        for batch in batches:
            for text in batch.column(0):
                tail = np.array([START, START], np.int32)
                for words in tokens(text.as_py()):
                    cls = np.concatenate([tail, _class_ids(vocab, words, cache)[1]])
                    waiting.append(_cells(cls))
                    held += len(words)
                    tail = cls[-2:]
                waiting.append(_cells(np.concatenate([tail, last])))
                if held > FLUSH:
                    sums += np.bincount(np.concatenate(waiting), minlength=len(sums))
                    waiting, held = [], 0
        if waiting:
            sums += np.bincount(np.concatenate(waiting), minlength=len(sums))
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full // CLASSES), pa.array(full % CLASSES), pa.array(sums[full])], ["h", "c", "n"])

    cells = texts.mapInArrow(run, "h long, c long, n long").groupBy("h", "c").agg(F.sum("n").alias("n"))
    return cells.groupBy("h").agg(F.collect_list(F.struct("c", "n")).alias("after"))


def _cells(cls: np.ndarray) -> np.ndarray:
    """Number of (class before last, class before, class), at each class but the first two."""
    return (cls[:-2] * CLASSES + cls[1:-1]) * CLASSES + cls[2:]


@dataclass
class Weights:
    bias: np.ndarray
    bigram: np.ndarray
    skip: np.ndarray
    trigram: np.ndarray

    @staticmethod
    def zeros() -> Weights:
        return Weights(np.zeros((1, CLASSES)), np.zeros((CLASSES, CLASSES)), np.zeros((CLASSES, CLASSES)), np.zeros((TRIGRAM_BUCKETS, CLASSES)))

    def parts(self) -> list[np.ndarray]:
        return [self.bias, self.bigram, self.skip, self.trigram]


def features(history: np.ndarray) -> list[np.ndarray]:
    """Rows of the four weight tables that a history switches on."""
    two, one = history // CLASSES, history % CLASSES
    hashed = (history.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(TRIGRAM_BUCKETS)
    return [np.zeros(len(history), np.int64), one, two, hashed.astype(np.int64)]


def log_softmax(weights: Weights, history: np.ndarray) -> np.ndarray:
    """Natural log of P(class | history); the start is never predicted."""
    logits = sum(w[f] for w, f in zip(weights.parts(), features(history), strict=True))
    logits[:, START] = -np.inf
    logits = logits - logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def train(histories: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> Weights:
    """Distributed gradient updates; ``histories`` is a stored table of `history_counts`.

    The gradient of a weight is its observed minus its expected count. Each is
    scaled by half their sum, which bounds a step by the rate. Histories have at
    most ``CLASSES`` ** 2 rows whatever the corpus, so their table is kept in a
    few parts; each part sends one vector of the size of the weights.
    """
    spark = histories.sparkSession
    weights = Weights.zeros()
    sizes = [w.size for w in weights.parts()]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: B023
            w = sent.value  # noqa: B023
            seen = [np.zeros_like(x) for x in w.parts()]
            model = [np.zeros_like(x) for x in w.parts()]
            for batch in batches:
                h = batch.column(0).to_numpy()
                after = batch.column(1)
                row = np.repeat(np.arange(len(h)), after.value_lengths().to_numpy())
                flat = after.flatten()
                n = np.zeros((len(h), CLASSES))
                n[row, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
                expected = np.exp(log_softmax(w, h)) * n.sum(axis=1, keepdims=True)
                for f, s, m in zip(features(h), seen, model, strict=True):
                    np.add.at(s, f, n)
                    np.add.at(m, f, expected)
            vector = np.concatenate([x.ravel() for x in [*seen, *model]])
            if vector.any():
                yield pa.RecordBatch.from_arrays([pa.array([vector.tobytes()], pa.binary())], ["g"])

        both = np.zeros(2 * sum(sizes))
        for part in histories.mapInArrow(run, "g binary").collect():
            both += np.frombuffer(part[0])
        seen, model = both[: sum(sizes)], both[sum(sizes) :]
        step = rate * (seen - model) / (0.5 * (seen + model) + 1.0)
        at = 0
        for w, size in zip(weights.parts(), sizes, strict=True):
            w += step[at : at + size].reshape(w.shape)
            at += size
        sent.destroy()
    return weights


def tabulate(weights: Weights) -> np.ndarray:
    """log10 P(class | history) of every history, as one flat float32 table."""
    out = [log_softmax(weights, np.arange(a, a + CLASSES)) for a in range(0, CLASSES**2, CLASSES)]
    return (np.concatenate(out) / np.log(10)).astype(np.float32).ravel()


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), most: int = COMMON) -> DataFrame:
    """Learn from the rows for which ``training`` holds; score every row.

    Returns ``id_col``, the columns ``keep``, n_tokens, n_known, train_tokens,
    base_score (unigram) and score, both log10 of the text's probability.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    learn = spread(docs.filter(training).select(text.alias("text")))
    counts = stored(word_counts(learn))
    vocab, least = vocabulary(counts, most)
    table = tabulate(train(stored(history_counts(learn, vocab).coalesce(TRAIN_PARTS))))
    sent = spark.sparkContext.broadcast((vocab, table))
    names = [id_col, *keep]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    schema = f"row long, {fields}, n_tokens long, n_known long, base_score double, score double, word binary, tf long"
    extra = "n_tokens n_known base_score score word tf".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, table = sent.value
        base_log = np.log10((vocab.n + 0.5) / vocab.base_divisor)
        divisor = np.log10(vocab.class_divisor)
        # a class of one word leaves nothing to choose
        alone = np.zeros(CLASSES, bool)
        alone[[END, *vocab.classes.own.values()]] = True
        in_class = np.where(alone[vocab.cls], 0.0, np.log10(vocab.n + 0.5) - divisor[vocab.cls])
        base_divisor, cache = np.log10(vocab.base_divisor), {}
        end_base = np.log10((vocab.in_class[END] + 0.5) / vocab.base_divisor)
        end_known = int(vocab.in_class[END] > 0)
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                n_tokens, n_known, base, model, words, tfs, source = [], [], [], [], [], [], []
                for r, text in enumerate(batch.column(batch.num_columns - 1)):
                    tail = np.array([START, START], np.int32)
                    n = known = 0
                    b = s = 0.0
                    left: Counter = Counter()
                    for part in tokens(text.as_py()):
                        index, cls, rare = _class_ids(vocab, part, cache)
                        n += len(part)
                        hit = index[index >= 0]
                        known += len(hit)
                        b += base_log[hit].sum() - len(rare) * base_divisor
                        own = np.concatenate([tail, cls])
                        s += table[(own[:-2] * CLASSES + own[1:-1]) * CLASSES + own[2:]].sum(dtype=np.float64)
                        s += in_class[hit].sum() - divisor[cls[index < 0]].sum()
                        tail = own[-2:]
                        left.update(rare)
                    s += float(table[(tail[0] * CLASSES + tail[1]) * CLASSES + END])
                    n_tokens.append(n + 1)
                    n_known.append(known + end_known)
                    base.append(b + end_base)
                    model.append(s)
                    words += left.keys()
                    tfs += left.values()
                    source += [r] * len(left)
                # a row of the text itself, under a key that no word has, then one for each word to look up
                docs_ = len(n_tokens)
                rows = batch.column(0)
                take = pa.array(source, pa.int32())
                none = lambda kind: pa.nulls(len(words), kind)  # noqa: E731, B023
                keys = [b" %d" % k for k in rows.to_pylist()]
                cols = [pa.concat_arrays([rows, rows.take(take)])]
                for c in range(1, batch.num_columns - 1):
                    cols.append(pa.concat_arrays([batch.column(c), none(batch.column(c).type)]))
                for values, kind in ((n_tokens, pa.int64()), (n_known, pa.int64()), (base, pa.float64()), (model, pa.float64())):
                    cols.append(pa.concat_arrays([pa.array(values, kind), none(kind)]))
                cols += [pa.array(keys + words, pa.binary()), pa.array([0] * docs_ + tfs, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["row", *names, *extra])

    # rows get their numbers where they are read, before they may be dealt anew
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`") for c in names], text)
    partial = spread(numbered).mapInArrow(run, schema)
    rare = counts.filter(~is_common(vocab.classes, least)).filter(F.length("word") > 0)
    met = partial.join(rare, "word", "left")
    weight = F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    sums = [F.max(f"`{c}`").alias(c) for c in [*names, "n_tokens"]]
    out = met.groupBy("row").agg(
        *sums,
        (F.max("n_known") + F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0))).alias("n_known"),
        (F.max("base_score") + F.sum(weight)).alias("base_score"),
        (F.max("score") + F.sum(weight)).alias("score"),
    )
    return out.select(*[F.col(f"`{c}`") for c in names], "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")
