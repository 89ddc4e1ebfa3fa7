"""Sharding over fixed virtual slots.

A record's key is hashed into one of thousands of virtual slots, for ever.  Bytes are summed per slot, and a versioned
map says which shard a slot lies in.  Rebalancing edits the map: it moves slots, and never rehashes records.  The map has
one entry per slot, so it is bounded whatever the data.  Each version is stored as a Parquet folder of its own, and never
changed after that.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cut import shared_dir
from .common import materialize

#: Rows that are numbered in one go; a slot with more is numbered in parts.
RANK_ROWS = 1000
#: Rows that repeat are made again from their count, so many at a time.
COPIES = 10_000


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] is the slot's shard."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "n_shards": self.n_shards, "shard_of": list(self.shard_of)})

    @staticmethod
    def from_json(text: str) -> SlotMap:
        d = json.loads(text)
        return SlotMap(d["version"], d["n_shards"], tuple(d["shard_of"]))


def uniform_map(n_slots: int, n_shards: int) -> SlotMap:
    """Version 1, before anything is known of the data: as many slots in every shard."""
    return SlotMap(1, n_shards, tuple(slot % n_shards for slot in range(n_slots)))


def store_map(spark: SparkSession, slots: SlotMap, path: str) -> None:
    """Write a version beside the others; one that is there is an error."""
    rows = [(slot, shard, slots.n_shards) for slot, shard in enumerate(slots.shard_of)]
    spark.createDataFrame(rows, "virtual_slot int, shard int, n_shards int").coalesce(1).write.parquet(f"{path}/version={slots.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
    """A stored version, or the latest; None where nothing is stored."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    wanted = version or stored.agg(F.max("version")).first()[0]
    rows = stored.where(F.col("version") == wanted).orderBy("virtual_slot").collect()  # a row per slot
    return SlotMap(wanted, rows[0].n_shards, tuple(r.shard for r in rows)) if rows else None


def rebalanced(old: SlotMap, slot_bytes: dict[int, int], n_shards: int, tolerance: float = 0.001) -> SlotMap:
    """The next version: slots move one at a time, from the fullest shard to the emptiest, while this levels them.

    Slots of shards that no longer exist move first.  What stays in its shard is untouched.
    """
    shard_of = list(old.shard_of)
    size = [0] * n_shards
    homeless = []
    for slot, shard in enumerate(shard_of):
        if shard < n_shards:
            size[shard] += slot_bytes.get(slot, 0)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda k: (-slot_bytes.get(k, 0), k)):
        shard_of[slot] = min(range(n_shards), key=lambda s: (size[s], s))
        size[shard_of[slot]] += slot_bytes.get(slot, 0)
    mean = sum(size) / n_shards
    own: list[list[int]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(shard_of):
        own[shard].append(slot)
    for _ in range(len(shard_of)):
        low, high = (f(range(n_shards), key=lambda s: (size[s], s)) for f in (min, max))
        gap = size[high] - size[low]
        if gap <= tolerance * mean:
            break
        movable = [k for k in own[high] if 0 < slot_bytes.get(k, 0) < gap]
        if not movable:
            break
        slot = min(movable, key=lambda k: (abs(gap / 2 - slot_bytes[k]), k))
        own[high].remove(slot)
        own[low].append(slot)
        shard_of[slot] = low
        size[high] -= slot_bytes[slot]
        size[low] += slot_bytes[slot]
    return SlotMap(old.version + 1, n_shards, tuple(shard_of))


def slot_bytes(sized: DataFrame) -> dict[int, int]:
    """Bytes per virtual slot of rows with virtual_slot and size; at most one row per slot comes to the driver."""
    rows = sized.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect()
    return {r["virtual_slot"]: r["b"] for r in rows}


def with_slots(docs: DataFrame, n_slots: int = 4096) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 (0 for null, as for the empty text) and virtual_slot.

    The key is the text's MD5, so equal texts share a slot; null text counts as empty.
    """
    text = F.coalesce("text", F.lit(""))
    slot = F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(n_slots)).cast("int")
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        slot.alias("virtual_slot"),
    )


def shard(docs: DataFrame, n_shards: int = 8, n_slots: int = 4096, path: str | None = None) -> DataFrame:
    """docs: doc_id, text.  Returns doc_id, size, text_crc32, virtual_slot, shard, slot, map_version; a row per row.

    path: folder of the stored map; by default one of our own in the shared folder.  Where it is empty, a map that knows
    nothing of the data is stored as version 1.  The latest version is edited until shards hold nearly equal bytes, and what
    comes out, if slots moved, is stored as the next.  slot numbers the rows of a shard from 0 without gaps, by virtual slot,
    part and doc_id.  Equal texts share a shard, so a group of copies that outweighs a shard's share makes that shard larger.
    Null texts count as empty, null doc_ids come first, rows that repeat have numbers that follow one another.  Empty tables
    give an empty result.  Other columns are ignored.

    Numbers come in steps, so that no slot's rows meet in one task: each virtual slot, in parts of about RANK_ROWS rows by
    the hash of doc_id, size and checksum, is numbered on its own; parts are summed per slot, and slots, which are few, on the
    driver.  Rows that repeat are one row with a count until the end.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    sized = materialize(with_slots(docs, n_slots), "sized")
    stats = sized.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    slots = load_map(spark, path)
    if slots is None:
        slots = uniform_map(n_slots, n_shards)
        store_map(spark, slots, path)
    edited = rebalanced(slots, {r["virtual_slot"]: r["b"] for r in stats}, n_shards)
    if edited.shard_of != slots.shard_of or edited.n_shards != slots.n_shards:
        store_map(spark, edited, path)
        slots = edited
    begins, rows = [0] * n_shards, []
    for r in sorted(stats, key=lambda r: r["virtual_slot"]):
        at = slots.shard_of[r["virtual_slot"]]
        rows.append((r["virtual_slot"], at, 1 + r["n"] // RANK_ROWS, begins[at]))
        begins[at] += r["n"]
    plan = F.broadcast(spark.createDataFrame(rows, "virtual_slot int, shard int, parts long, slot_begin long"))  # a row per slot
    part = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.col("parts"))
    same = sized.groupBy("doc_id", "size", "text_crc32", "virtual_slot").agg(F.count("*").alias("n"))
    placed = same.join(plan, "virtual_slot").withColumn("part", part)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("virtual_slot", "part").agg(F.sum("n").alias("rows"))
    upto = before(Window.partitionBy("virtual_slot").orderBy("part"))
    parts = sums.select("virtual_slot", "part", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("part_begin"))
    within = before(Window.partitionBy("virtual_slot", "part").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32"))
    numbered = placed.withColumn("row_begin", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, ["virtual_slot", "part"])
    tens = numbered.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    first = F.col("chunk") * COPIES
    copies = tens.withColumn("copy", F.explode(F.sequence(first, F.least(first + (COPIES - 1), F.col("n") - 1))))
    return copies.select(
        "doc_id",
        "size",
        "text_crc32",
        "virtual_slot",
        "shard",
        (F.col("slot_begin") + F.col("part_begin") + F.col("row_begin") + F.col("copy")).cast("long").alias("slot"),
        F.lit(slots.version).alias("map_version"),
    )
