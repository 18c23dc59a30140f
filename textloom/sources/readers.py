"""Sources. Every reader takes a path that Spark reads and an explicit schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import first_truthy
from textloom.sources import schemas

CORRUPT = "_corrupt_record"
#: How a stub of a large-file store begins.
STUB = "version https://git-lfs.github.com/spec/"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line, gzipped or not; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same; a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str, renames: dict[str, list[str]] | None = None, required: tuple[str, ...] = (), watch: Observation | None = None) -> DataFrame:
    """Malformed lines are skipped, columns fall back to others, and rows without a required value go.

    ``watch`` counts lines, malformed ones and rows that lack a value, while the first action on the result runs.
    """
    fields = T._parse_datatype_string(schema)
    kept = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    df = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    for name, others in (renames or {}).items():
        df = df.withColumn(name, first_truthy(*[F.col(c) for c in [name, *others] if c in df.columns]))
    good, whole = F.col(CORRUPT).isNull(), F.lit(True)
    for name in required:
        whole = whole & F.coalesce(F.trim(F.col(name).cast("string")) != "", F.lit(False))
    if watch is not None:
        df = df.observe(watch, F.count(F.lit(1)).alias("lines"), F.count_if(~good).alias("malformed"), F.count_if(good & ~whole).alias("incomplete"))
    return df.filter(good & whole).drop(CORRUPT)


def rejected(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The malformed lines that the tolerant reader skips."""
    kept = T.StructType([*T._parse_datatype_string(schema), T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return raw.select("value", parsed[CORRUPT].alias("bad")).filter("bad is not null").select("value")


def without_bom(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, with or without a byte-order mark."""
    text = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return text.select("path", F.from_json(F.regexp_replace("value", "^﻿", ""), schema).alias("doc"))


def without_stubs(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files that are no stubs of a large-file store."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.filter(~F.startswith(F.col("value"), F.lit(STUB))).select("path")


def page_docs(spark: SparkSession, path: str, schema: str = schemas.PAGE) -> DataFrame:
    """Entries of page documents ``page_NNN.json`` with a headword; the page number is in the file's name."""
    docs = without_bom(spark, path, schema)
    page = F.regexp_extract("path", r"page_(\d+)", 1).cast("int")
    rows = docs.select(page.alias("page"), F.posexplode("doc.entries").alias("pos", "e")).filter(F.trim("e.headword") != "")
    return rows.select("page", "pos", "e.*")


def page_meta(spark: SparkSession, path: str, schema: str = schemas.PAGE) -> DataFrame:
    """Entries with the page and image of the document's metadata; missing ids are made of both numbers."""
    docs = without_bom(spark, path, schema)
    rows = docs.select(F.col("doc.metadata.page_number").alias("meta_page"), F.col("doc.metadata.image_path").alias("meta_image"), F.posexplode("doc.entries").alias("pos", "e"))
    made = F.format_string("page_%s_entry_%03d", F.col("meta_page"), F.col("pos") + 1)
    rest = [f"e.{f.name}" for f in rows.schema["e"].dataType if f.name != "entry_id"]
    return rows.select("meta_page", "meta_image", "pos", first_truthy(F.col("e.entry_id"), made).alias("entry_id"), *rest)


def rules_json(spark: SparkSession, path: str, schema: str = schemas.RULE) -> DataFrame:
    """Rules of documents that hold them in ``rules``."""
    inner = T._parse_datatype_string(schema).simpleString()
    return without_bom(spark, path, f"rules array<{inner}>").select(F.posexplode("doc.rules").alias("rule_index", "r")).select("rule_index", "r.*")


def metrics_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def first_source(candidates: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first of some sources that can be read and has a row."""
    last: Exception | None = None
    for make in candidates:
        try:
            df = make()
            if not df.isEmpty():
                return df
        except Exception as e:  # a missing path raises one of several kinds
            last = e
    raise ValueError("no source has rows") from last


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def scalar_or_list(c: Column) -> Column:
    """A string that holds one value or a JSON list, as an array."""
    one = F.when(F.trim(c) != "", F.array(F.trim(c))).otherwise(F.array().cast("array<string>"))
    return F.when(F.startswith(F.ltrim(c), F.lit("[")), F.coalesce(F.from_json(c, "array<string>"), one)).otherwise(F.coalesce(one, F.array().cast("array<string>")))


def facets(rows: DataFrame, top: str, nested: str, default: str, allowed: list[str]) -> DataFrame:
    """Rows whose facet, from the top, the info or a default, is allowed in any case."""
    value = F.lower(F.coalesce(F.nullif(F.col(top), F.lit("")), F.nullif(F.col(nested), F.lit("")), F.lit(default)))
    return rows.filter(value.isin([a.lower() for a in allowed]))


def strict_kinds(asked: list[str], known: list[str]) -> list[str]:
    """The kinds asked for; an unknown one raises."""
    if bad := sorted(set(asked) - set(known)):
        raise ValueError(f"unknown task types: {', '.join(bad)}")
    return asked
