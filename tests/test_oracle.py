"""Every query runs, and equals its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pytest
from places import SF

from textloom.plans import registry
from textloom.session import BATCH_ROWS


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    """Sorted rows as text, columns by name."""

    def shown(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return "null"
        if isinstance(v, (list, tuple, np.ndarray)):
            return str([shown(x) for x in v])
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.number)):
            return f"{float(v):.6f}"
        return str(v)

    cols = sorted(df.columns)
    return cols, sorted(tuple(shown(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    (a, x), (b, y) = rows(got), rows(want)
    assert a == b
    assert x == y


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_normal_forms_of_any_first_word(spark, tmp_path):
    """The query hides what its rows name, whatever letters the first word of a text has."""
    docs = [(i, t, "en", "src1", len(t)) for i, t in enumerate(["Pizza is hot", "Pizza is hot", "zz", "zz top", "", "blizzards en route"])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").filter("text <> ''").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["normal_forms"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(got) == rows(con.execute(registry.ORACLE_SQL["normal_forms"]).df())


def test_normal_forms_of_texts_without_words(spark, tmp_path):
    """Texts that are empty, blank or null, and missing sources and languages, are rows like others."""
    texts = ["", " ", " \n\t", "\u2028", "\x0bab \x0b", None, "one", " one two\n", "abcd x abcde "]
    docs = [(i, t, lang, source, 0) for i, (t, lang, source) in enumerate((t, *x) for t in texts for x in [("en", "src1"), ("en", "src1"), (None, "src1"), ("en", None)])]
    docs += [(i + len(docs), *x) for i, (_, *x) in enumerate(docs[1:])]  # each with an odd and an even number
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["normal_forms"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(got) == rows(con.execute(registry.ORACLE_SQL["normal_forms"]).df())


def test_normal_forms_in_small_batches(spark, tmp_path):
    """What a task holds of whole texts is bounded, however many rows it has."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        registry.QUERIES["normal_forms"](spark, SF)
        assert int(spark.conf.get(name)) <= BATCH_ROWS
    finally:
        spark.conf.set(name, before)
