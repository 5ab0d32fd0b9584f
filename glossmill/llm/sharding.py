"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record hashes to one of thousands of virtual slots by its content, so equal texts
share a slot.  Bytes are summed per slot and a map from slot to shard is stored as a
versioned table; rebalancing edits the map and moves whole slots, never re-hashes
records.  A group of equal texts that outweighs a shard's fair share is salted over
several slots, as one shard couldn't hold it evenly.

The main path is DataFrame expressions only.  What reaches the driver is the slot
table, whose size is the fixed number of slots.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.llm.common import each_copy, scratch_path, settle

SLOTS = 4096
#: A slot's rows are numbered in parts of about this many, or more where that makes more than PARTS parts in all.
PART_ROWS = 1000
PARTS = 1 << 16


def balance(slot_bytes: dict[int, int], shards: int) -> dict[int, int]:
    """Slot to shard, the heaviest slot first, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, size in sorted(slot_bytes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def rebalance(current: dict[int, int], slot_bytes: dict[int, int], shards: int) -> dict[int, int]:
    """An edited map over `shards` shards that moves few slots.

    Slots of shards that no longer exist, and the largest fitting slots of shards above
    the fair share, go to the lightest shard; all others stay where they are.
    """
    fair = sum(slot_bytes.values()) / shards
    load = dict.fromkeys(range(shards), 0)
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    loose = []
    for slot in sorted(current):
        shard = current[slot]
        if shard in load:
            load[shard] += slot_bytes.get(slot, 0)
            held[shard].append(slot)
        else:
            loose.append(slot)
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda x: (-slot_bytes.get(x, 0), x)):
            size = slot_bytes.get(slot, 0)
            if size and load[shard] - size >= fair:
                load[shard] -= size
                loose.append(slot)
    out = {k: v for k, v in current.items() if k not in set(loose)}
    heap = sorted((v, k) for k, v in load.items())
    for slot in sorted(loose, key=lambda x: (-slot_bytes.get(x, 0), x)):
        size, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (size + slot_bytes.get(slot, 0), shard))
    return out


def map_frame(spark: SparkSession, slot_shard: dict[int, int], version: int) -> DataFrame:
    """The map as a DataFrame (version, virtual_slot, shard)."""
    body = json.dumps([{"virtual_slot": k, "shard": v} for k, v in sorted(slot_shard.items())])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(body), "array<struct<virtual_slot:int,shard:int>>")).alias("m"))
    return rows.select(F.lit(version).alias("version"), "m.virtual_slot", "m.shard")


def store_map(spark: SparkSession, path: str, slot_shard: dict[int, int], version: int) -> DataFrame:
    """Write one version of the map below `path`; earlier versions stay."""
    map_frame(spark, slot_shard, version).drop("version").coalesce(1).write.parquet(f"{path}/version={version}")
    return load_map(spark, path, version)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    rows = spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")
    return rows.select(F.lit(version).alias("version"), "virtual_slot", "shard")


def map_versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(version, whether its rows are there) of the maps below `path`, oldest first; a broken-off write leaves no rows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = []
    for entry in files.listStatus(folder):
        name, _, number = entry.getPath().getName().partition("=")
        if name == "version" and number.isdigit():
            found.append((int(number), any(f.getPath().getName().endswith(".parquet") for f in files.listStatus(entry.getPath()))))
    return sorted(found)


def next_map(spark: SparkSession, path: str | None, slot_bytes: dict[int, int], shards: int) -> tuple[dict[int, int], int]:
    """The map to store next and its version: the latest one below `path`, edited, or else a balanced one."""
    versions = map_versions(spark, path) if path else []
    version = versions[-1][0] + 1 if versions else 1
    stored = [v for v, there in versions if there]
    if not stored:
        return balance(slot_bytes, shards), version
    current = {r["virtual_slot"]: r["shard"] for r in load_map(spark, path, stored[-1]).collect()}  # at most `slots` rows
    # Slots the map doesn't have yet are of no shard, so they are dealt like those of a shard that is gone.
    return rebalance(dict.fromkeys(slot_bytes, -1) | current, slot_bytes, shards), version


def slotted(docs: DataFrame, shards: int, slots: int) -> DataFrame:
    """(doc_id, size, text_crc32, copy, virtual_slot); rows alike in all are counted, written as a compact table, and numbered."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    each = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data) + F.lit(1)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("content"),
    )
    rows = settle(each.groupBy(*each.columns).agg(F.count("*").alias("n")), "sizes")
    bytes_ = F.col("size") * F.col("n")
    fair = (rows.agg(F.sum(bytes_).alias("total")).first()["total"] or 0) / shards
    # Fewer than `shards` groups can each outweigh a fair share, so this is at most a handful of rows.
    heavy = rows.groupBy("content").agg(F.sum(bytes_).alias("bytes")).where(F.col("bytes") > F.lit(float(fair)))
    heavy_ids = [r["content"] for r in heavy.select("content").limit(shards).collect()] if fair else []
    home = F.pmod(F.col("content"), F.lit(slots))
    if heavy_ids:
        spread = F.pmod(F.xxhash64("content", "doc_id", "copy"), F.lit(slots))
        home = F.when(F.col("content").isin(heavy_ids), spread).otherwise(home)
    return each_copy(rows, "n", "copy").select("doc_id", "size", "text_crc32", "copy", home.cast("int").alias("virtual_slot"))


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    The law is `bytes`: the shards' summed sizes are near equal.  Size is the text's
    UTF-8 bytes plus 1 (null: 1).  `slot` numbers the rows of a shard from 0 without
    gaps, by virtual slot, then a part of it, then doc_id.  Equal texts share a shard
    unless together they exceed a fair share.  Rows alike in id and text are numbered and
    placed one by one, ties too, a null doc_id sorts first, very long texts count whole, other columns are
    ignored, whatever their names, and an empty table gives an empty result and an empty
    map.

    Where `map_path` holds maps already, the latest is edited by `rebalance` and stored as
    the next version; `slots` must be what it was.
    """
    spark = docs.sparkSession
    rows = slotted(docs, shards, slots)
    stats = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # at most `slots` rows
    slot_shard, version = next_map(spark, map_path, {r["virtual_slot"]: r["bytes"] for r in stats}, shards)
    stored = store_map(spark, map_path or scratch_path(spark, "slot_map"), slot_shard, version)
    part_rows = max(PART_ROWS, -(-sum(r["n"] for r in stats) // PARTS))
    parts = {r["virtual_slot"]: -(-r["n"] // part_rows) for r in stats}
    many = {k: v for k, v in parts.items() if v > 1}
    n_parts = F.lit(1)
    if many:
        n_parts = F.coalesce(F.from_json(F.lit(json.dumps({str(k): v for k, v in many.items()})), "map<string,int>")[F.col("virtual_slot").cast("string")], F.lit(1))
    placed = rows.join(F.broadcast(stored.select("virtual_slot", "shard")), "virtual_slot")  # `slots` rows of two ints
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "copy"), n_parts).cast("int") if many else F.lit(0))
    # One row per part of a slot: at most PARTS + slots, however many documents there are.
    offsets = placed.groupBy("shard", "virtual_slot", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("virtual_slot", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "size", "text_crc32", "copy")
    numbered = placed.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["virtual_slot", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(version).alias("map_version"),
    )
