"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

Every record hashes into one of `SLOTS` virtual slots, for good. Bytes and rows are summed by slot (so many rows
reach the driver, whatever the corpus), and a map from slot to shard is packed so that the shards' bytes are near
equal. The map is a table with a version; rebalancing writes the next version, in which only the slots that had to
move have another shard.

A shard's rows are numbered without gaps: a slot's first number follows from the counts of the shard's slots before
it, and numbers within a slot need a window over that slot alone, never over a whole shard.

Records hash by key, text and number among equal ones. So a record's slot depends neither on other records nor on the table's size or partitions, and the records of a hot key, or of
none, fill all slots: no slot grows with one key.

Nulls: a null text has size 1 and the crc32 of no bytes. Tied keys are numbered by their text's crc32 and size; equal rows are interchangeable. Only a very long
text's size counts. An empty table gives an empty result and a map of empty slots. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common as C

SLOTS = 4096
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long, base long"


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of every record. A record is its key, its text's crc32 and size, and its number among the records equal in these; numbers
    1, 2, .. keep their slots whatever is added."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = C.staged(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("uid"),  # only parts a run of equal records, which are interchangeable
    ), "sized")
    record = ["doc_id", "text_crc32", "size"]
    numbered = C.numbered(rows, [*map(F.col, record), F.col("uid")], record, "copy")
    return C.staged(numbered.select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64(*record, "copy"), F.lit(slots)).cast("int").alias("vslot")), "slotted")


def slot_weights(rows: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) by slot."""
    out = [(0, 0)] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        out[r["vslot"]] = (r["b"], r["n"])
    return out


def packed(weights: list[tuple[int, int]], shards: int) -> list[int]:
    """Shard of each slot: the heaviest slots first, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(weights)
    for slot in sorted(range(len(weights)), key=lambda s: (-weights[s][0], s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights[slot][0], shard))
    return out


def rebalanced(shard_of: list[int], weights: list[tuple[int, int]], shards: int, tolerance: float = 0.01) -> list[int]:
    """An edited map over `shards` shards: slots of the heaviest shard move to the lightest one, the largest that narrow
    their gap first, until the heaviest is within `tolerance` of the mean. Slots of removed shards always move."""
    out = list(shard_of)
    load, owned = [0] * shards, [set() for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(out):
        if shard < shards:
            load[shard] += weights[slot][0]
            owned[shard].add(slot)
        else:
            homeless.append(slot)

    def give(slot: int, shard: int) -> None:
        out[slot] = shard
        load[shard] += weights[slot][0]
        owned[shard].add(slot)

    for slot in sorted(homeless, key=lambda s: (-weights[s][0], s)):
        give(slot, load.index(min(load)))
    mean = sum(load) / shards
    while True:
        high, low = load.index(max(load)), load.index(min(load))
        gap = load[high] - load[low]
        fit = [s for s in owned[high] if 0 < weights[s][0] < gap]
        if load[high] <= mean * (1 + tolerance) or not fit:
            return out
        slot = max(fit, key=lambda s: (weights[s][0] <= gap / 2, weights[s][0] if weights[s][0] <= gap / 2 else -weights[s][0], -s))
        owned[high].remove(slot)
        load[high] -= weights[slot][0]
        give(slot, low)


def map_rows(version: int, shard_of: list[int], weights: list[tuple[int, int]], shards: int) -> list[tuple]:
    base, out = [0] * shards, []
    for slot, shard in enumerate(shard_of):
        out.append((version, slot, shard, weights[slot][0], weights[slot][1], base[shard]))
        base[shard] += weights[slot][1]
    return out


def store_map(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Append a version to the map's table."""
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest unless told; `SLOTS` rows."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def assigned(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """`rows` with their shard and their number in it. The map has one row a slot, so it is broadcast."""
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    of = slot_map.select(F.col("slot").alias("vslot"), "shard", "base", F.col("version").alias("map_version"))
    return rows.withColumn("place", F.row_number().over(within)).join(F.broadcast(of), "vslot").select(
        *rows.columns, "shard", (F.col("base") + F.col("place") - 1).alias("slot"), "map_version"
    )


def shard(docs: DataFrame, path: str, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """Lay out `docs` over `shards` shards of near equal bytes; the map is stored as version 1 at `path`."""
    rows = slotted(docs, slots)
    weights = slot_weights(rows, slots)
    store_map(docs.sparkSession, path, map_rows(1, packed(weights, shards), weights, shards))
    return assigned(rows, load_map(docs.sparkSession, path, 1))


def grow(spark: SparkSession, path: str, shards: int, slots: int = SLOTS) -> DataFrame:
    """Write the map's next version, for `shards` shards: the newest one, edited. Returns it."""
    newest = sorted(load_map(spark, path).collect(), key=lambda r: r["slot"])
    weights = [(r["bytes"], r["rows"]) for r in newest]
    version = newest[0]["version"] + 1
    store_map(spark, path, map_rows(version, rebalanced([r["shard"] for r in newest], weights, shards), weights, shards))
    return load_map(spark, path, version)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes` over 16 shards. `next_shard` is the shard under the map's second version, which has one shard more."""
    path = f"{C.work_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = shard(C.table(spark, sf_dir, "documents"), path)
    edited = grow(spark, path, 17).select(F.col("slot").alias("vslot"), F.col("shard").alias("next_shard"))
    return rows.join(F.broadcast(edited), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version", "next_shard"
    )
