from __future__ import annotations

import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from helpers import DOCS, ODD, docs

from textloom.llm import chat, queries, sharding

SF = "/root/testdata/sf0.001"


def test_shards(spark):
    rng = random.Random(1)
    texts = ODD[:3] + ODD[5:] + ["x" * rng.randint(0, 900) for _ in range(1500)] + ["same"] * 200
    placed, where = sharding.shard(docs(spark, texts))
    rows = placed.collect()
    by = defaultdict(list)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
        by[r["shard"]].append(r)
    assert set(by) == set(range(8)) and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    loads = [sum(r["size"] for r in v) for v in by.values()]
    assert max(loads) - min(loads) < 0.02 * sum(loads) / 8
    assert len({r["shard"] for r in rows if texts[r["doc_id"]] == "same"}) == 1
    assert where.version == 1


def test_groups_are_cut_only_where_no_shard_holds_them(spark):
    texts = ["y" * 50] * 1000 + ["z" * 50] * 120 + [str(i) * 9 for i in range(500)]
    placed, where = sharding.shard(docs(spark, texts))
    rows, loads, of = placed.collect(), defaultdict(int), defaultdict(set)
    for r in rows:
        loads[r["shard"]] += r["size"]
        of[texts[r["doc_id"]]].add(r["shard"])
    assert max(loads.values()) < 1.1 * sum(loads.values()) / 8
    share = 51 * 1000 * 8 / sum(loads.values())
    assert [p for _, _, p in where.cut] == [-(-share // 1)] and len(of["y" * 50]) <= where.cut[0][2] and len(of["z" * 50]) == 1
    assert all(len(s) == 1 for t, s in of.items() if t[0] != "y")


def test_stored_maps(spark, tmp_path):
    """A second run edits the stored map; records keep their slots; saving twice leaves one copy."""
    at = str(tmp_path / "map")
    texts = ["same" * 9] * 400 + [f"text {i}" * (i % 7) for i in range(300)]
    first, one = sharding.shard(docs(spark, texts), path=at)
    one.save(spark, at)
    assert sharding.SlotMap.load(spark, at) == one and one.cut
    second, two = sharding.shard(docs(spark, [*texts, *("new" * 40 for _ in range(90))]), path=at)
    assert (one.version, two.version) == (1, 2) and {r["map_version"] for r in second.collect()} == {2}
    slot = {r["doc_id"]: r["vslot"] for r in first.collect()}
    assert all(slot[r["doc_id"]] == r["vslot"] for r in second.collect() if r["doc_id"] in slot)
    spark.range(5).selectExpr("cast(id as int) slot", "0 shard", "8 shards", "cast(null as long) text_hash", "cast(null as int) pieces").write.mode("append").parquet(f"{at}/version=2")
    with pytest.raises(ValueError, match="not whole"):
        sharding.SlotMap.load(spark, at)


def test_parts_of_a_slot(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 1)
    rows = sharding.shard(docs(spark, ["a"] * 70 + ["b"] * 50 + ["c"]), slots=32)[0].collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == 121 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_beside_clashing_columns(spark):
    df = docs(spark, ["a", "b"]).withColumnRenamed("lang", "vslot").withColumnRenamed("source", "size").withColumnRenamed("n_chars", "__g")
    assert sharding.shard(df)[0].count() == 2
    conv = spark.createDataFrame([(1, 0, "user", "x", 5)], "conv_id long, turn long, role string, text string, block int")
    assert [r["text"] for r in chat.render(conv).collect()] == ["<|user|>\nx<|end|>\n"]


def test_map_edits(spark, tmp_path):
    rng = random.Random(2)
    sizes = [rng.randint(0, 1000) for _ in range(1024)]
    one = sharding.SlotMap.balanced(sizes, 8)
    two = one.grown(sizes)
    moved = [s for s in range(1024) if one.of[s] != two.of[s]]
    assert moved and all(two.of[s] == 8 for s in moved) and two.version == 2
    loads = two.loads(sizes)
    assert max(loads) < 1.1 * sum(loads) / 9 and min(loads) > 0.9 * sum(loads) / 9
    changed = [x * (3 if i % 8 == 0 else 1) for i, x in enumerate(sizes)]
    three = two.edited(changed)
    assert three.version == 3 and max(three.loads(changed)) <= 1.02 * sum(changed) / 9
    for m in (one, two, three):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == three
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == one


def test_shard_edges(spark):
    assert sharding.shard(spark.createDataFrame([], DOCS))[0].count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    assert sharding.shard(twice)[0].count() == 3


CONV = "conv_id long, turn long, role string, text string"


def plain_maximal(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    said = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    return {c: s for c, s in said.items() if not any((d != c and len(o) > len(s) and o[: len(s)] == s) or (o == s and d < c) for d, o in said.items())}


@pytest.mark.parametrize("block", [3, 1024])
def test_snapshots(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rng, rows = random.Random(3), []
    for c in range(0, 300, 3):
        seed = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None])) for _ in range(rng.randint(1, 9))]
        for k in range(3):
            for t, (r, x) in enumerate(seed[: max(1, len(seed) - k)]):
                rows.append((c + k, t, r, x))
    rows += [(900, None, "user", "n"), (900, 1, "user", "m"), (901, None, "user", "n"), (None, 0, "user", "x"), (902, 5, "user", "q"), (902, 5, "user", "q")]
    df = spark.createDataFrame(rows, CONV).repartition(4)
    want = plain_maximal(rows)
    got = defaultdict(dict)
    for r in chat.render(df).collect():
        assert r["n_turns"] == len(want[r["conv_id"]])
        got[r["conv_id"]][r["segment"]] = r["text"]
    shown = {c: "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in s) for c, s in want.items()}
    assert {c: "".join(s[k] for k in sorted(s)) for c, s in got.items()} == shown
    assert all(sorted(s) == list(range(len(s))) for s in got.values())
    assert chat.render(df.limit(0)).count() == 0


def test_chat_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op9_chat"]).fetchall()
    assert sorted(map(tuple, queries.op9_chat(spark, SF).collect())) == sorted(want)


def test_names():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    base = [say(80) for _ in range(12)]
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[0], "en", "s", 1), (101, base[0] + " tail", "en", "s", 1), (102, None, None, None, None), (103, "12 34", "en", "s", 5), (104, "short one", "en", "s", 9), (105, say(70) + " mail a@b.co", "en", None, 3), (None, say(60), "en", "s", 3), (7, base[7], "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    out = df
    kept = []
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == df.columns
        kept.append({r["doc_id"] for r in out.collect()})
    assert {102, 103}.isdisjoint(kept[0]) and 104 in kept[0]
    assert 104 not in kept[1] and None in kept[1]
    assert set(range(12)) | {105, None} == kept[2]
    final = {r["doc_id"]: r for r in out.collect()}
    assert final[105]["text"].endswith("mail [EMAIL]") and final[105]["n_chars"] == len(final[105]["text"])
    packed = cp.STAGES[-1][1](spark, out, SF).collect()
    assert {r["doc_id"] for r in packed} == kept[3]
    assert out.count() == len(kept[3])


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
