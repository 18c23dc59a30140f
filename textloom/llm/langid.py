"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, runs of anything else count as one blank, and the
1- to 3-grams of that are hashed into a fixed number of buckets. Counts by
language come from labelled rows; the log-probability matrix (languages times
buckets) is broadcast. Texts are counted slice by slice into sparse rows of
(bucket, count), and batches of such rows are multiplied with the matrix in numpy,
so memory follows neither the length of a text nor the number of labels.

The classifier is fitted on a bounded sample of the labelled rows: about
``train_rows`` whole texts, dealt evenly over the languages that occur, chosen
by a hash of the row's key and text. Prediction covers all rows.

Defined cases: a text that is null or has no letter is ``und`` with score 1;
ties go to the language first in order; with no labelled rows every text is
``und`` with score 0; repeated rows are predicted alike; other columns of the
input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import spread

BUCKET_BITS = 15
ORDERS = 3
#: About how many labelled rows the fit reads.
TRAIN_ROWS = 24_000
#: The matrix is broadcast: more labels than this are refused.
MAX_LABELS = 256
SLICE = 1 << 20
#: Texts that are read at once, and about the entries of a sparse batch times the labels.
TEXTS, CELLS = 256, 1 << 21
UNDETERMINED = "und"
_LEAST = -(1 << 63)

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: the lower-cased letter, or a blank."""
    if not _LETTERS:
        table = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            if not 0xD800 <= cp < 0xE000:
                c = chr(cp)
                if c.isalpha():
                    table[cp] = ord(c.lower()[0])
        _LETTERS.append(table)
    return _LETTERS[0]


def grams(text: str) -> Iterator[list[np.ndarray]]:
    """Bucket numbers of the 1-, 2- and 3-grams, for each slice of the text."""
    table, shift = letters(), np.uint32(32 - BUCKET_BITS)
    tail = np.array([32], np.uint32)
    for at in range(0, len(text), SLICE):
        codes = table[np.frombuffer(text[at : at + SLICE].encode("utf-32-le"), "<u4")]
        last = at + SLICE >= len(text)
        codes = np.concatenate([tail, codes, np.array([32], np.uint32)] if last else [tail, codes])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        kept = len(tail) if at else 1  # what the slice before has already counted
        found, h = [], codes * np.uint32(0x9E3779B1)
        for order in range(1, ORDERS + 1):
            if order > 1:
                h = (h[:-1] ^ codes[order - 1 :]) * np.uint32(0x85EBCA77 + 2 * order)
            new = max(0, kept - order + 1) if at or order == 1 else 0
            found.append(((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D + 2 * order) >> shift)[new:])
        yield found
        tail = codes[-(ORDERS - 1) :]


def row_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text and how often each occurs: one sparse row."""
    sums = np.zeros(1 << BUCKET_BITS, np.int64)
    for found in grams(text):
        sums += np.bincount(np.concatenate(found), minlength=1 << BUCKET_BITS)
    full = np.flatnonzero(sums)
    return full, sums[full]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # buckets x labels: log probabilities
    prior: np.ndarray

    def scored(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Label, posterior probability and excess of each text, by sparse batches.

        The excess is how far the mean log probability of a text's grams lies
        below what the label's own texts have on average, in nats; unlike the
        posterior it doesn't saturate as texts grow. It is less by four standard
        errors, so that short texts aren't judged on a few grams.
        """
        labels, scores, excess = [UNDETERMINED] * len(texts), [1.0] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if has_letter(t)]
        if not self.labels:
            for i in some:
                scores[i] = 0.0
            return labels, scores, excess
        p = np.exp(self.weights)
        usual = (p * self.weights).sum(axis=0)
        sd = np.sqrt(np.maximum(0.0, (p * self.weights**2).sum(axis=0) - usual**2))
        most = max(1 << BUCKET_BITS, CELLS // len(self.labels))
        at = 0
        while at < len(some):
            rows, held = [], 0
            while at + len(rows) < len(some) and held <= most:
                rows.append(row_of(texts[some[at + len(rows)]]))
                held += len(rows[-1][0])
            starts = np.cumsum([0, *(len(b) for b, _ in rows[:-1])])
            n = np.concatenate([n for _, n in rows])
            sums = np.add.reduceat(self.weights[np.concatenate([b for b, _ in rows])] * n[:, None], starts)
            sizes = np.add.reduceat(n, starts)
            total = sums + self.prior
            best = total.argmax(axis=1)
            post = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            over = usual[best] - sums[np.arange(len(rows)), best] / sizes - 4 * sd[best] / np.sqrt(sizes)
            for k in range(len(rows)):
                i = some[at + k]
                labels[i], scores[i], excess[i] = self.labels[best[k]], float(post[k]), float(max(0.0, over[k]))
            at += len(rows)
        return labels, scores, excess


def fit(docs: DataFrame, training: Column, label_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled rows for which ``training`` holds."""
    rows = docs.filter(training & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(label_col)).agg(F.count("*")).limit(MAX_LABELS + 1).collect()}
    if len(sizes) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels: the matrix would be too large to broadcast")
    if not sizes:
        return Model([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0))
    names = sorted(sizes)
    # rows below a bound on the whole range of 64-bit hashes, so a label of any size gives its share
    below = F.lit(_LEAST)
    for name in names:
        part = min(1.0, train_rows / len(names) / sizes[name])
        below = F.when(F.col(label_col) == name, F.lit(min(-_LEAST - 1, _LEAST + int(part * 2**64)))).otherwise(below)
    sample = rows.filter(F.xxhash64(F.col(key_col), F.lit("langid"), F.col(text_col)) <= below)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                into = sums.setdefault(label, np.zeros(1 << BUCKET_BITS, np.int64))
                buckets, n = row_of(text.as_py())
                into[buckets] += n
        for label, into in sums.items():
            full = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(into[full])], ["label", "bucket", "n"])

    counted = sample.select(F.col(label_col), F.col(text_col)).mapInArrow(count, "label string, bucket int, n long")
    counts = np.zeros((1 << BUCKET_BITS, len(names)))
    at = {name: i for i, name in enumerate(names)}
    for label, buckets, ns in counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).groupBy("label").agg(F.collect_list("bucket"), F.collect_list("n")).collect():
        counts[np.array(buckets), at[label]] = ns
    alpha = 0.5
    weights = np.log(counts + alpha) - np.log(counts.sum(axis=0) + alpha * len(counts))
    prior = np.log(np.array([sizes[n] for n in names], float)) - np.log(sum(sizes.values()))
    return Model(names, weights, prior)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, label_as: str = "lang_pred", score_as: str = "score", excess_as: str | None = None) -> DataFrame:
    """Add the prediction to the columns ``keep`` (default: all but clashing names).

    Only texts go to Python and only predictions come back.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = {"label": label_as, "score": score_as} | ({"excess": excess_as} if excess_as else {})
    keep = [c for c in docs.columns if c not in added.values()] if keep is None else keep

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [sent.value.scored(batch.slice(at, TEXTS).to_pylist()) for at in range(0, len(batch), TEXTS)]
            cols = [[x for p in parts for x in p[k]] for k in range(3)]
            yield pa.StructArray.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], ["label", "score", "excess"])

    # not deterministic to the optimizer, so that a filter on the result doesn't predict once more
    found = F.arrow_udf(run, "label string, score double, excess double").asNondeterministic()
    rows = spread(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text_col}`").alias("text")))
    rows = rows.select("kept", found("text").alias("found"))
    return rows.select(*[F.col(f"kept.`{c}`") for c in keep], *[F.col(f"found.{k}").alias(v) for k, v in added.items()])
