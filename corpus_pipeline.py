"""The corpus pipeline: language ID, quality rules, near-dedup, PII, packing.

Each stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns a
DataFrame; all but the last return the columns of ``documents``. `run` writes
each stage's result to the shared folder before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import langid, packing, pii, quality, simhash
from textloom.session import stored, table

#: Near duplicates: shingles of five words, three words of fingerprint. At a similarity (Jaccard)
#: of 0.8 the expected number of differing bits is 29 of 192 (pi * bits / 192 is the angle whose
#: cosine is 2 * 0.8 / 1.8) with a standard deviation of 5, so pairs within 40 are candidates; a
#: group is linked by pairs whose sets of shingles are that similar.
SHINGLE, WIDTH, TOTAL_BITS, SIMILARITY = 5, 3, 40, 0.8
#: A document whose language is less likely than not is rejected, and one whose letters are by so
#: many nats a gram less likely in it than the labelled texts (they stay below 1.7 on sf0.1).
MIN_LANGUAGE_SCORE, MAX_EXCESS = 0.5, 2.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predict each language; documents without a letter or a likely language go."""
    model = langid.fit(docs, F.lit(True))
    found = langid.predict(docs, model, label_as="__lang", score_as="__score", excess_as="__excess")
    sure = (F.col("__lang") != langid.UNDETERMINED) & (F.col("__score") >= MIN_LANGUAGE_SCORE) & (F.col("__excess") <= MAX_EXCESS)
    return found.filter(sure).withColumn("lang", F.col("__lang")).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines above the limits; failed and depleted documents go."""
    return _counted(quality.cleaned(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    # repeated rows share a key, so one of them stays too
    keyed = docs.withColumn("__h", F.xxhash64("doc_id", "text")).withColumn("__k", F.xxhash64("text", F.lit("second"), "doc_id"))
    key = F.struct("doc_id", "__h", "__k")
    groups = simhash.near_duplicates(keyed.select(key.alias("key"), "text"), "key", "text", SHINGLE, WIDTH, total_bits=TOTAL_BITS, similarity=SIMILARITY)
    first = groups.filter(F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key.__h").alias("__h"), F.col("key.__k").alias("__k")).distinct()
    return keyed.join(first, ["__h", "__k"], "left_semi").dropDuplicates(["__h", "__k"]).select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [("language ID", language), ("quality rules", rules), ("near-dedup", near_dedup), ("PII", private), ("packing", pack)]

#: Language ID, SimHash and the tokenizer have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
