"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots, bytes are summed per slot, and a versioned table maps slots to shards.
Rebalancing edits that table; the hash of a record never changes.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.common import shared_folder, small, written

SLOTS = 4096
#: Lanes that a slot is dealt over once it holds more than 1/(HOT_SHARE * shards) of all bytes.
LANES, HOT_SHARE = 64, 8
#: Bytes of a run of one shard's rows, about.
PART_BYTES = 128 << 20
#: Shards are near equal once the fullest has this share of the mean more than the emptiest.
TOLERANCE = 0.001

MAP_SCHEMA = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("vslot", T.IntegerType()),
        T.StructField("lane", T.IntegerType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("shard", T.IntegerType()),
    ]
)


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a record key; a null key has the slot of the empty hash."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, shards: int) -> list[tuple[int, int, int]]:
    """(slot, lane, bytes) of every slot in use: at most SLOTS + HOT_SHARE * shards * LANES rows come to the driver.

    Lane -1 stands for a whole slot.  A hot slot, for which one key or one group of copies is enough, has a row for
    each lane instead.
    """
    whole = {r.vslot: r.b for r in records.groupBy("vslot").agg(F.sum("size").alias("b")).collect()}
    total = sum(whole.values())
    hot = sorted(s for s, b in whole.items() if b * HOT_SHARE * shards > total)
    found = [(s, -1, b) for s, b in whole.items() if s not in set(hot)]
    if hot:
        lanes = records.where(F.col("vslot").isin(hot)).groupBy("vslot", "lane").agg(F.sum("size").alias("b"))
        found += [(r.vslot, r.lane, r.b) for r in lanes.collect()]
    return sorted(found)


def first_map(sizes: list[tuple[int, int, int]], shards: int) -> list[tuple]:
    """Version 1: largest slots first, each to the shard with the fewest bytes so far."""
    load = [(0, s) for s in range(shards)]
    rows = []
    for slot, lane, size in sorted(sizes, key=lambda x: (-x[2], x[0], x[1])):
        held, shard = heapq.heappop(load)
        heapq.heappush(load, (held + size, shard))
        rows.append((1, slot, lane, size, shard))
    return sorted(rows)


def rebalanced(rows: list[tuple], shards: int, tolerance: float = 0.02) -> list[tuple]:
    """The next version of a map: moves slots from the fullest to the emptiest shard until they are near equal.

    ``shards`` may be larger (new shards start empty) or smaller (slots of dropped shards go first).  Every other slot
    stays where it is.
    """
    at = {(s, lane): [b, shard] for _, s, lane, b, shard in rows}
    load = dict.fromkeys(range(shards), 0)
    for b, shard in at.values():
        if shard < shards:
            load[shard] += b
    for k in sorted((k for k, v in at.items() if v[1] >= shards), key=lambda k: (-at[k][0], k)):
        to = min(load, key=lambda s: (load[s], s))
        at[k][1] = to
        load[to] += at[k][0]
    mean = sum(load.values()) / shards
    of = {s: sorted((at[k][0], k) for k in at if at[k][1] == s) for s in load}
    for _ in range(len(at)):
        full, low = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[full] - load[low]
        if gap <= tolerance * mean:
            break
        fits = [x for x in of[full] if 0 < x[0] < gap]
        if not fits:
            break
        size, k = best = min(fits, key=lambda x: (abs(gap / 2 - x[0]), x[1]))
        of[full].remove(best)
        of[low] = sorted([*of[low], best])
        at[k][1] = low
        load[full] -= size
        load[low] += size
    version = max((r[0] for r in rows), default=0) + 1
    return sorted((version, s, lane, b, shard) for (s, lane), (b, shard) in at.items())


def even_map(sizes: list[tuple[int, int, int]], shards: int) -> list[tuple]:
    """Version 1 of a map that knows no bytes yet: slots dealt to shards in turn, a hot slot's lanes likewise."""
    return [(1, slot, lane, size, (slot + max(lane, 0)) % shards) for slot, lane, size in sizes]


def updated(rows: list[tuple], sizes: list[tuple[int, int, int]], shards: int) -> list[tuple]:
    """A stored map with new bytes: known slots stay where they are, lanes of a slot that has become hot start where the
    slot was, and slots that it lacks are dealt in turn."""
    version = max((r[0] for r in rows), default=0)
    at = {(slot, lane): shard for _, slot, lane, _, shard in rows}
    place = lambda slot, lane: at.get((slot, lane), at.get((slot, -1), (slot + max(lane, 0)) % shards))
    return [(version, slot, lane, size, place(slot, lane)) for slot, lane, size in sizes]


def store_map(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Adds one version of the map (bounded by the number of slots and lanes) under ``path``, as a partition of its own."""
    table = spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1)
    table.drop("version").write.mode("overwrite").parquet(f"{path}/version={rows[0][0]}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple]:
    """The rows of the latest version under ``path``, or of the named one; none if nothing is stored there."""
    try:
        table = spark.read.schema(MAP_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    wanted = version if version is not None else table.agg(F.max("version")).first()[0]
    return sorted(tuple(r) for r in table.where(F.col("version") == F.lit(wanted)).select(*MAP_SCHEMA.names).collect())


def _edited_map(records: DataFrame, shards: int, map_path: str | None) -> DataFrame:
    """The latest slot map with the new bytes, edited until shards are near equal and stored if that moved a slot."""
    spark = records.sparkSession
    path = map_path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    sizes, stored = slot_bytes(records, shards), load_map(spark, path)
    known = updated(stored, sizes, shards) if stored else even_map(sizes, shards)
    edited = rebalanced(known, shards, TOLERANCE)
    if not stored and known:
        store_map(spark, known, path)
    moved = [r[1:3] + r[4:] for r in known] != [r[1:3] + r[4:] for r in edited]
    rows = edited if moved else known
    if moved:
        store_map(spark, rows, path)
    return F.broadcast(  # SLOTS + HOT_SHARE * shards * LANES rows at most
        spark.createDataFrame(rows, MAP_SCHEMA).select("vslot", F.col("lane").alias("in_lane"), "shard", F.col("version").alias("map_version"))
    )


def _on_map(records: DataFrame, table: DataFrame) -> DataFrame:
    return records.join(table, (records.vslot == table.vslot) & (table.in_lane.isin(-1) | (table.in_lane == records.lane))).drop(table.vslot)


def shard_records(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", map_path: str | None = None) -> DataFrame:
    """Puts every row into one of ``shards`` shards of near equal bytes.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version``; ``slot`` is the
    place in the shard, gapless from 0.  A null text has size 1 and a null CRC-32; a null key is hashed like any other;
    repeated rows are kept, each with a place of its own; an empty table gives no rows; other columns are ignored.
    Reruns on the same files agree.

    The slot map is read from ``map_path`` (one under the shared folder by default): its latest version, or a first one
    that deals slots in turn.  It gets the new bytes of each slot and is edited (``rebalanced``) until the shards are near
    equal; if that moves a slot, the result is stored as the next version.

    Only the key, size and CRC-32 of a record are shuffled, never the text.  Places come from counts by (scan
    partition, shard), so that no window holds more than the rows of one scan partition in one shard.
    """
    spark = docs.sparkSession
    records = written(
        docs.select(
            F.col(key).alias("doc_id"),
            record_size(F.col(text)).alias("size"),
            F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
            virtual_slot(F.col(key)).alias("vslot"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("row"),
        ).withColumn("lane", F.pmod(F.xxhash64("row"), F.lit(LANES)).cast("int")),
        "shard-records",
    )
    placed = _on_map(records, _edited_map(records, shards, map_path))
    counts = placed.groupBy("shard", "part").count()
    before = counts.select(
        "shard",
        "part",
        (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"),
    )
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    return (
        placed.withColumn("place", place)
        .join(before, ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            F.col("vslot").alias("virtual_slot"),
            "map_version",
        )
    )


def sharded_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", map_path: str | None = None) -> DataFrame:
    """The rows themselves with their place: all columns of ``docs`` and ``size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version``.

    Rows come out in runs of one shard in the order of their slots, PART_BYTES each, as they are to be written.  A row is
    known by its file and its place there, so that equal rows and the rows of one hot key are dealt like any others; a
    table that isn't read from files is written first.  Texts are shuffled once, to their run.  A column of ``docs`` whose
    name is among the new ones is kept with ``doc_`` before it.  Nulls, repeats, empty tables and the slot map are treated
    as in ``shard_records``.
    """
    try:
        docs.select("_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        docs = written(docs, "shard-docs")
    identity = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    own = [docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(
        F.struct(*own).alias("d"), record_size(docs[text]).alias("size"), F.crc32(docs[text].cast("binary")).alias("text_crc32"), virtual_slot(docs[key]).alias("vslot"), identity.alias("row")
    ).withColumn("lane", F.pmod("row", F.lit(LANES)).cast("int"))
    records = written(rows.select("size", "vslot", "row", "lane"), "shard-records")
    total = records.agg(F.sum("size")).first()[0] or 0
    part = F.pmod(F.shiftright("row", 8), F.lit(1 + total // (shards * PART_BYTES))).alias("part")
    table = _edited_map(records, shards, map_path)
    counts = _on_map(records, table).groupBy("shard", part).count()
    before = written(counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before")), "shard-runs")
    runs = _on_map(rows, table).withColumn("part", part).repartition("shard", "part")
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version"]
    placed = runs.withColumn("place", place).join(small(before), ["shard", "part"])
    placed = placed.withColumn("slot", (F.col("before") + F.col("place")).cast("long")).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
    kept = [F.col(f"d.c{i}").alias(f"doc_{c}" if c in new else c) for i, c in enumerate(docs.columns)]
    return placed.withColumnRenamed("vslot", "virtual_slot").select(*kept, *new)
