from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from textloom.sources import readers, sinks


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"question": "q1", "answer": "a1"}\n\nnot json\n{"prompt": "q2", "answer": "a2"}\n{"prompt": "q3", "answer": " "}\n', encoding="utf-8")
    schema = "prompt string, question string, answer string"
    got = readers.jsonl_tolerant(spark, str(p), schema, {"prompt": ["question"]}, ("prompt", "answer"))
    assert sorted(r["prompt"] for r in got.collect()) == ["q1", "q2"]
    watch = Observation("warnings")
    assert readers.jsonl_tolerant(spark, str(p), schema, {"prompt": ["question"]}, ("prompt", "answer"), watch).count() == 2
    assert watch.get == {"lines": 4, "malformed": 1, "incomplete": 1}
    assert [r[0] for r in readers.rejected(spark, str(p), schema).collect()] == ["not json"]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl_strict(spark, str(p), schema).collect()
    z = tmp_path / "b.jsonl.gz"
    z.write_bytes(gzip.compress(b'{"answer": "z"}\n'))
    assert readers.jsonl(spark, str(z), schema).first()["answer"] == "z"


def test_pages(spark, tmp_path):
    doc = {"entries": [{"headword": "šuŋka", "confidence": 0.9}, {"headword": " "}, {"entry_id": "e", "headword": "kin"}], "metadata": {"page_number": 7, "image_path": "i.png"}}
    (tmp_path / "page_007.json").write_text("﻿" + json.dumps(doc), encoding="utf-8")
    (tmp_path / "page_008.json").write_text(readers.STUB + "v1\n", encoding="utf-8")
    assert [(r["page"], r["headword"]) for r in readers.page_docs(spark, str(tmp_path / "page_007.json")).orderBy("pos").collect()] == [(7, "šuŋka"), (7, "kin")]
    assert [r["entry_id"] for r in readers.page_meta(spark, str(tmp_path / "page_007.json")).orderBy("pos").collect()] == ["page_7_entry_001", "page_7_entry_002", "e"]
    assert readers.without_stubs(spark, str(tmp_path)).count() == 1
    assert len(readers.fingerprints(spark, str(tmp_path)).first()["sha256"]) == 64


def test_rules_csv_and_chain(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"rules": [{"rule_id": "a"}, {"rule_id": "b"}]}), encoding="utf-8")
    assert [r["rule_id"] for r in readers.rules_json(spark, str(tmp_path / "r.json")).orderBy("rule_index").collect()] == ["a", "b"]
    sinks.csv(spark.range(3), str(tmp_path / "c"))
    assert readers.metrics_csv(spark, str(tmp_path / "c"), "id long").count() == 3
    chain = [lambda: readers.parquet(spark, str(tmp_path / "none")), lambda: spark.range(0), lambda: spark.range(2)]
    assert readers.first_source(chain).count() == 2
    with pytest.raises(ValueError, match="no source"):
        readers.first_source(chain[:2])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    sinks.by_value(df, str(tmp_path / "p"), ["k"])
    assert {x.name for x in (tmp_path / "p").iterdir() if x.is_dir()} == {"k=a", "k=b"}
    sinks.append(df, str(tmp_path / "q"))
    sinks.append(df, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).count() == 6
    assert sinks.report(df, n=F.count("*"), s=F.sum("v")).first().asDict() == {"n": 3, "s": 6}
    assert sinks.markdown(df.limit(1)).splitlines()[0] == "| k | v |"


def test_values(spark):
    df = spark.createDataFrame([("x",), ('["a", "b"]',), (None,), ("",)], "c string")
    assert [r[0] for r in df.select(readers.scalar_or_list(F.col("c"))).collect()] == [["x"], ["a", "b"], [], []]
    with pytest.raises(ValueError, match="unknown"):
        readers.strict_kinds(["a", "z"], ["a"])


def test_stream_equals_batch(spark):
    from places import SF

    from textloom.plans import registry

    stream, batch = (registry.QUERIES[n](spark, SF).toPandas() for n in ("lookup_session_stream", "lookup_session"))
    key = lambda d: sorted(map(tuple, d[sorted(d.columns)].itertuples(index=False)))
    assert key(stream) == key(batch)
