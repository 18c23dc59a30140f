"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into a fixed number of slots; bytes are summed per slot; a
map of slots to shards, kept with a version, is all that decides where a record
lives. Slots are placed longest first on the least loaded shard. Rebalancing
edits the map and nothing else: slots move, records don't get new slots.

A slot is chosen by the text, so equal texts share a slot and a shard, unless
they can't: a group with more bytes than a shard's share is cut, by id, into the
fewest pieces that fit, each with a slot of its own at the end of the slots. Such
groups, fewer than there are shards, are part of the map, so a record's slot
depends on its text, its id and the map alone.

Maps are stored by version: saving a version again leaves one copy of it, and
loading checks that it has every slot once.

Defined cases: a null text has no bytes and crc 0 and counts as one more equal
text; null ids are ids like any other; repeated rows each take a place; an empty
table gives no rows and an all-zero map; other columns don't matter.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.session import shared_dir, stored

SLOTS = 4096
SHARDS = 8
#: Rows of a part of a slot, about, within which places are counted.
PART_ROWS = 2_000


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot; ``version`` counts the edits.

    ``cut`` has (hash of the text, first slot, pieces) of each group that fits no shard.
    """

    version: int
    shards: int
    of: tuple[int, ...]
    cut: tuple[tuple[int, int, int], ...] = ()

    @staticmethod
    def balanced(slot_bytes: list[int], shards: int = SHARDS, cut: tuple[tuple[int, int, int], ...] = ()) -> SlotMap:
        """Longest slot first, to the shard with the fewest bytes."""
        loads = [(0, s) for s in range(shards)]
        of = [0] * len(slot_bytes)
        for slot in sorted(range(len(slot_bytes)), key=lambda s: (-slot_bytes[s], s)):
            load, shard = heapq.heappop(loads)
            of[slot] = shard
            heapq.heappush(loads, (load + slot_bytes[slot], shard))
        return SlotMap(1, shards, tuple(of), cut)

    def loads(self, slot_bytes: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.of):
            out[shard] += slot_bytes[slot]
        return out

    def grown(self, slot_bytes: list[int]) -> SlotMap:
        """One more shard: the heaviest shards give it slots until it has its share."""
        of, new = list(self.of), self.shards
        loads = [*self.loads(slot_bytes), 0]
        share = sum(loads) / (new + 1)
        held: list[list[int]] = [[] for _ in range(new)]
        for slot in sorted(range(len(of)), key=lambda s: slot_bytes[s]):
            held[of[slot]].append(slot)
        while True:
            giver = max(range(new), key=lambda s: loads[s])
            fitting = [s for s in held[giver][-64:] if loads[new] + slot_bytes[s] <= share and loads[giver] - slot_bytes[s] >= 0.98 * share]
            if not fitting:
                return SlotMap(self.version + 1, new + 1, tuple(of), self.cut)
            slot = fitting[-1]
            held[giver].remove(slot)
            loads[giver] -= slot_bytes[slot]
            loads[new] += slot_bytes[slot]
            of[slot] = new

    def edited(self, slot_bytes: list[int], tolerance: float = 0.01) -> SlotMap:
        """Same shards, new sizes: the fewest moves from heavy to light shards that even them out."""
        of, loads = list(self.of), self.loads(slot_bytes)
        mean = sum(loads) / self.shards
        for _ in range(len(of)):
            giver, taker = max(range(self.shards), key=loads.__getitem__), min(range(self.shards), key=loads.__getitem__)
            gap = (loads[giver] - loads[taker]) / 2
            own = [s for s, shard in enumerate(of) if shard == giver and 0 < slot_bytes[s] <= gap]
            if loads[giver] - mean <= tolerance * mean or not own:
                break
            slot = max(own, key=lambda s: (slot_bytes[s], -s))
            of[slot] = taker
            loads[giver] -= slot_bytes[slot]
            loads[taker] += slot_bytes[slot]
        return SlotMap(self.version + 1, self.shards, tuple(of), self.cut)

    def column(self, slot: Column) -> Column:
        """The shard of a slot column; the map folds into a literal array."""
        return F.element_at(F.split(F.lit(",".join(map(str, self.of))), ","), slot + 1).cast("int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write this version to its own folder of a Parquet table (version, slot, shard, shards, text_hash, pieces)."""
        rows = spark.range(len(self.of)).select(F.col("id").cast("int").alias("slot")).withColumn("shard", self.column(F.col("slot"))).withColumn("shards", F.lit(self.shards))
        marks = {first: (group, pieces) for group, first, pieces in self.cut}
        mark = lambda k, kind: reduce(lambda rest, at: F.when(F.col("slot") == at, F.lit(marks[at][k])).otherwise(rest), marks, F.lit(None)).cast(kind)
        rows = rows.withColumn("text_hash", mark(0, "long")).withColumn("pieces", mark(1, "int"))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the newest by default; raises if a slot is missing or there twice."""
        rows = spark.read.parquet(path)
        version = rows.agg(F.max("version")).first()[0] if version is None else version
        got = sorted(tuple(r) for r in rows.filter(F.col("version") == version).select("slot", "shard", "shards", F.coalesce("text_hash", F.lit(0)), F.coalesce("pieces", F.lit(0))).collect())
        if not got or [r[0] for r in got] != list(range(len(got))) or len({r[2] for r in got}) != 1:
            raise ValueError(f"version {version} of the map is not whole")
        return SlotMap(version, got[0][2], tuple(r[1] for r in got), tuple((r[3], r[0], r[4]) for r in got if r[4]))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored narrow table: ``id_col``, size, text_crc32 and the hash of the text."""
    text = F.col(f"`{text_col}`")
    return stored(
        docs.select(
            F.col(f"`{id_col}`"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.xxhash64(text, F.lit("text")), F.lit(0)).alias("__g"),
        )
    )


def cut_groups(narrow: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> tuple[tuple[int, int, int], ...]:
    """Groups of equal texts with more bytes than a shard's share, and the slots of their pieces: fewer than ``2 * shards``."""
    total = narrow.agg(F.sum("size")).first()[0] or 0
    heavy = narrow.groupBy("__g").agg(F.sum("size").alias("b"), F.count("*").alias("n")).filter((F.col("b") * shards > total) & (F.col("n") > 1))
    out, at = [], slots - 2 * shards
    for r in heavy.orderBy("__g").collect():
        pieces = -(-r["b"] * shards // total)
        out.append((r["__g"], at, pieces))
        at += pieces
    return tuple(out)


def slotted(narrow: DataFrame, cut: tuple[tuple[int, int, int], ...], shards: int = SHARDS, id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Add the record's virtual slot ``vslot``."""
    slot = F.pmod(F.col("__g"), F.lit(slots - 2 * shards))
    for group, first, pieces in cut:
        slot = F.when(F.col("__g") == group, F.lit(first) + F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit("piece")), F.lit(pieces))).otherwise(slot)
    return narrow.withColumn("vslot", slot.cast("int")).drop("__g")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of each slot: ``slots`` numbers, whatever the number of records."""
    out = [0] * slots
    for r in records.groupBy("vslot").agg(F.sum("size").alias("b")).collect():
        out[r["vslot"]] = int(r["b"])
    return out


def placed(records: DataFrame, where: SlotMap, id_col: str = "doc_id") -> DataFrame:
    """Add ``shard`` and ``slot``, the record's place in its shard, gapless from 0.

    Places are counted within parts of virtual slots, as many as a slot's records
    need, and shifted by the sizes of the parts before, so no task holds more than
    a part of a slot.
    """
    # a row for each virtual slot, whatever the number of records
    held = F.broadcast(records.groupBy("vslot").agg((1 + F.floor(F.count("*") / PART_ROWS)).alias("__parts")))
    dealt = records.join(held, "vslot").withColumn("__part", F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit("part")), F.col("__parts"))).drop("__parts")
    sizes = dealt.groupBy("vslot", "__part").agg(F.count("*").alias("__n")).withColumn("shard", where.column(F.col("vslot")))
    before = Window.partitionBy("shard").orderBy("vslot", "__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("vslot", "__part", "shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("vslot", "__part").orderBy(F.col(f"`{id_col}`"), "text_crc32", "size")
    ranked = dealt.withColumn("__rank", F.row_number().over(within)).join(sizes, ["vslot", "__part"])
    return ranked.withColumn("slot", F.col("__before") + F.col("__rank") - 1).drop("__part", "__rank", "__before")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Place every record by the stored map at ``path`` (default: a new one in the shared folder).

    Without a map there, a balanced one is stored as version 1; with one, its edit
    is stored as the next version. Either way records are placed by what is loaded.
    """
    spark = docs.sparkSession
    narrow = measured(docs, id_col, text_col)
    old = None
    if path is None:
        path = f"{shared_dir(spark)}/textloom-slotmap-{uuid.uuid4().hex}"
    else:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        if found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found):
            old = SlotMap.load(spark, path)
    if old is None:
        cut = cut_groups(narrow, shards, slots)
        records = slotted(narrow, cut, shards, id_col, slots)
        SlotMap.balanced(slot_bytes(records, slots), shards, cut).save(spark, path)
    else:
        # slots past the plain ones were set aside for as many shards as the first map had
        first = SlotMap.load(spark, path, 1)
        records = slotted(narrow, old.cut, first.shards, id_col, len(old.of))
        old.edited(slot_bytes(records, len(old.of))).save(spark, path)
    where = SlotMap.load(spark, path)
    return placed(records, where, id_col).withColumn("map_version", F.lit(where.version)), where
