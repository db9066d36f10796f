"""Sharding by fixed virtual slots.

A record's hash picks one of `slots` virtual slots, for good. Bytes are summed by slot, and a versioned map says which shard owns
which slot. Rebalancing edits the map: it moves few slots, never re-hashes a record. The map has `slots` entries whatever the
number of records, so it is what the driver works on and what every task gets. Maps are kept as a table, a folder a version; a run
reads the newest, edits it where shards were added, went or outgrew the others by over `SLACK`, and keeps the edit as the next version.

Places in a shard are counts of earlier slots, of the slot's rows in earlier input partitions, and a place among the rows that share
slot and input partition: records that repeat an id, or have none, are no group that a single task must read.

Defined results: the hash is that of the id; a record without an id takes the hash of its text, so that many of them spread. Null
text has no bytes and the checksum 0; a text of any length is only measured. Repeated rows share a slot and get places of their own. An empty table gives no rows.
Only the id and the text are read.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.plans.scratch import materialize

SLOTS, SHARDS, OVERHEAD, SLACK = 8192, 24, 8, 0.01


@dataclass(frozen=True)
class SlotMap:
    """owner[s]: the shard of virtual slot s. version grows by one with each edit."""

    version: int
    shards: int
    owner: tuple[int, ...]

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "shards": self.shards, "owner": list(self.owner)})

    @staticmethod
    def from_json(text: str) -> SlotMap:
        d = json.loads(text)
        return SlotMap(d["version"], d["shards"], tuple(d["owner"]))


def fresh_map(sizes: list[int], shards: int) -> SlotMap:
    """Version 1: the largest slots first, each to the shard that has the fewest bytes so far (then the fewest slots, then the lowest number)."""
    load = [(0, 0, k) for k in range(shards)]
    owner = [0] * len(sizes)
    for s in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        b, n, k = heapq.heappop(load)
        owner[s] = k
        heapq.heappush(load, (b + sizes[s], n + 1, k))
    return SlotMap(1, shards, tuple(owner))


def rebalanced(old: SlotMap, sizes: list[int], shards: int | None = None) -> SlotMap:
    """The next version: slots of shards that are gone and slots from shards over the mean move, the largest that fit first, to the shards with the fewest bytes; every other slot stays."""
    shards = shards or old.shards
    target = sum(sizes) / shards
    owner, load, moving = list(old.owner), [0] * shards, []
    for s, k in enumerate(owner):
        if k < shards:
            load[k] += sizes[s]
        else:
            moving.append(s)
    for s in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        k = owner[s]
        if k < shards and sizes[s] and load[k] - sizes[s] >= target:
            load[k] -= sizes[s]
            moving.append(s)
    heap = [(b, k) for k, b in enumerate(load)]
    heapq.heapify(heap)
    for s in sorted(moving, key=lambda s: (-sizes[s], s)):
        b, k = heapq.heappop(heap)
        owner[s] = k
        heapq.heappush(heap, (b + sizes[s], k))
    return replace(old, version=old.version + 1, shards=shards, owner=tuple(owner))


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot (the virtual slot) of every row."""
    raw = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    own = docs.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text_crc32", "size"))
    return own.withColumn("vslot", F.pmod(key, F.lit(slots)).cast("int"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes by virtual slot; one number for each slot comes to the driver."""
    out = [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b")).collect():
        out[r["vslot"]] = r["b"]
    return out


def map_table(spark: SparkSession, m: SlotMap) -> DataFrame:
    """The map as rows (version, vslot, shard), to be kept as a table."""
    return spark.createDataFrame([(m.version, s, k) for s, k in enumerate(m.owner)], "version int, vslot int, shard int")


def keep_map(spark: SparkSession, m: SlotMap, path: str) -> None:
    """Write the map beside earlier versions; a version is written once."""
    map_table(spark, m).coalesce(1).write.mode("errorifexists").parquet(f"{path}/v{m.version}")


def kept_map(spark: SparkSession, path: str) -> SlotMap | None:
    """The newest map that was written whole."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [str(x.getPath()) for x in fs.listStatus(at)] if fs.exists(at) else []
    whole = [x for x in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{x}/_SUCCESS"))]
    if not whole:
        return None
    newest = max(whole, key=lambda x: int(x.rsplit("/v", 1)[1]))
    rows = spark.read.schema("version int, vslot int, shard int").parquet(newest).orderBy("vslot").collect()
    owner = tuple(r["shard"] for r in rows)
    return SlotMap(rows[0]["version"], max(owner) + 1, owner)


def loads(m: SlotMap, sizes: list[int]) -> list[int]:
    """Bytes by shard."""
    out = [0] * m.shards
    for size, k in zip(sizes, m.owner, strict=True):
        out[k] += size
    return out


def current_map(spark: SparkSession, path: str, sizes: list[int], shards: int = SHARDS, slack: float = SLACK) -> SlotMap:
    """The map kept at path, made, or edited if the shards are others or one has more than its share by over `slack`, and kept. An edit that makes the largest shard no smaller is not made."""
    m = kept_map(spark, path)
    if m is None or len(m.owner) != len(sizes):
        new = fresh_map(sizes, shards)
        new = replace(new, version=m.version + 1) if m else new
    elif m.shards == shards and max(loads(m, sizes)) <= (1 + slack) * sum(sizes) / shards:
        return m
    else:
        new = rebalanced(m, sizes, shards)
        if m.shards == shards and max(loads(new, sizes)) >= max(loads(m, sizes)):
            return m
    keep_map(spark, new, path)
    return new


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, slot_map: SlotMap | None = None, maps: str | None = None) -> tuple[DataFrame, SlotMap]:
    """doc_id, size, text_crc32, vslot, shard and slot (the record's place in its shard, gapless from 0) of every row, and the map used: slot_map, else that kept at `maps`, else a fresh one."""
    spark = docs.sparkSession
    rows = materialize(records(docs, slots).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "records")
    by_part = rows.groupBy("vslot", "_part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    counts = {r["vslot"]: (r["b"], r["n"]) for r in by_part.groupBy("vslot").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect()}
    sizes = [counts.get(s, (0, 0))[0] for s in range(slots)]
    slot_map = slot_map or (current_map(spark, maps, sizes, shards) if maps else fresh_map(sizes, shards))
    # a place is the count of the shard's earlier slots plus the place in the slot: no task gets a whole shard, nor a whole slot
    before, total = [], [0] * slot_map.shards
    for s, k in enumerate(slot_map.owner):
        before.append((s, k, total[k]))
        total[k] += counts.get(s, (0, 0))[1]
    of = spark.createDataFrame(before, "vslot int, shard int, _before long")
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("vslot").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = by_part.withColumn("_earlier", earlier).join(F.broadcast(of), "vslot").select("vslot", "_part", "shard", (F.col("_before") + F.col("_earlier")).alias("_head"))
    within = F.row_number().over(W.partitionBy("vslot", "_part").orderBy("_at"))
    placed = rows.withColumn("_nth", within).join(heads, ["vslot", "_part"])
    return placed.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("_head") + F.col("_nth") - 1).cast("long").alias("slot")), slot_map
