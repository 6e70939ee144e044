"""Sharding through fixed virtual slots (DataFrame operations only).

A record's virtual slot is a hash of its text modulo ``SLOTS``, so equal texts
share a slot. Bytes and rows are summed per slot, and a versioned table maps
slots to shards. Version 1 deals slots out round robin; ``rebalance`` edits a
map into the next version by moving slots from the fullest to the emptiest
shard until shard sizes are near equal (law ``bytes``).

A slot with more than half a shard's even share of all bytes (a group of
copies that holds much of the corpus) is split: its records go to ``SPLIT``
further slots by a hash of doc_id. There can be at most ``2 * shards`` such
slots, so the map never has more than ``SLOTS + 2 * shards * SPLIT`` rows
whatever the size of the corpus; that is the bound for collecting and
broadcasting it. Positions inside a slot with many rows are counted in ``PIECES``
pieces by a hash of doc_id, so no slot is numbered by one task; at most a
quarter of the slots can have four times the mean. Where copies of one text also
share a doc_id, or have none, and hold more rows or bytes than an average slot, those
hashes take in the number of the row as read, so such copies spread as well; there are
at most ``2 * SLOTS`` such groups. No text is shuffled: records are (doc_id, size,
crc, slot, row number).

Defined results: a null text has size 1 and the checksum of no bytes; rows
that repeat a doc_id are separate records; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import local_table, stored, text_or_empty

SLOTS = 4096
SPLIT = 256
PIECES = 64
SHARDS = 8
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long, first long"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    text = text_or_empty()
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("base"),
        F.monotonically_increasing_id().alias("_row"))


def with_spread(rows: DataFrame, bases: list[int], slots: int = SLOTS) -> DataFrame:
    """Adds ``_spread``: the row number of records whose (base, doc_id) outweighs an average slot, else null."""
    if not bases:
        return rows.withColumn("_spread", F.lit(None).cast("long"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    heavy = rows.where(F.col("base").isin(bases)).groupBy("base", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).where(
        (F.col("n") > 1) & ((F.col("n") * slots > total["n"]) | (F.col("size") * slots > total["size"])))
    heavy = stored(heavy.select(F.col("base").alias("_base"), F.col("doc_id").alias("_id")), "heavy-ids")
    same = (F.col("base") == F.col("_base")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return (rows.join(F.broadcast(heavy), same, "left")  # bounded: see the module text
            .withColumn("_spread", F.when(F.col("_base").isNotNull(), F.col("_row"))).drop("_base", "_id"))


def slot_of(hot: list[int], slots: int = SLOTS, split: int = SPLIT) -> Column:
    """The slot of a record; records of the k-th hot base slot are spread over split slots."""
    slot = F.col("base")
    # a null leaves a hash as it is
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("split"), F.col("_spread")), F.lit(split))
    for k, base in enumerate(sorted(hot)):
        slot = F.when(F.col("base") == base, slots + k * split + part).otherwise(slot)
    return slot.cast("int")


def rebalance(previous: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """The next slot-to-shard map: single slots move from the fullest to the emptiest shard.

    ``previous`` may lack new slots or use fewer shards (when the cluster grows).
    Each move takes the slot that comes nearest to half the gap, so the spread
    shrinks until no slot fits. Where shards are new, only those take slots.
    Works on slot totals only, never on records.
    """
    known = set(previous.values())
    takers = [k for k in range(shards) if known and k not in known] or range(shards)
    load, members = [0] * shards, [set() for _ in range(shards)]
    for slot in sorted(sizes, key=lambda s: (not 0 <= previous.get(s, -1) < shards, -sizes[s], s)):
        shard = previous.get(slot, -1)
        if not 0 <= shard < shards:
            shard = min(range(shards), key=lambda k: (load[k], k))
        load[shard] += sizes[slot]
        members[shard].add(slot)
    while True:
        high = max(range(shards), key=lambda k: (load[k], -k))
        low = min(takers, key=lambda k: (load[k], k))
        gap = load[high] - load[low]
        slot = min((s for s in members[high] if 0 < sizes[s] < gap),
                   key=lambda s: (abs(2 * sizes[s] - gap), s), default=None)
        if slot is None:
            return {s: shard for shard in range(shards) for s in members[shard]}
        members[high].remove(slot)
        members[low].add(slot)
        load[high] -= sizes[slot]
        load[low] += sizes[slot]


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS,
                    split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(records with shard and position, the table of map versions)."""
    spark = docs.sparkSession
    rows = stored(records(docs, slots), "records")
    totals = F.sum("size").cast("long").alias("bytes"), F.count(F.lit(1)).alias("rows")
    counted = rows.groupBy("base").agg(*totals).collect()
    base = {r["base"]: r["bytes"] for r in counted}
    limit = max(1, sum(base.values()) / (2 * shards))
    hot = [b for b, size in base.items() if size > limit]
    # splitting a hot slot adds slots and so lowers the mean that makes a slot crowded
    least = 4 * sum(r["rows"] for r in counted) / max(1, len(base) + len(hot) * split)
    rows = with_spread(rows, sorted({*hot, *(r["base"] for r in counted if r["rows"] > least)}), slots)
    placed = rows.withColumn("virtual_slot", slot_of(hot, slots, split))
    stats = {r["virtual_slot"]: (r["bytes"], r["rows"])
             for r in placed.groupBy("virtual_slot").agg(*totals).collect()}
    first = {s: s % shards for s in stats}
    second = rebalance(first, {s: v[0] for s, v in stats.items()}, shards)
    versions = []
    for version, mapping in ((1, first), (2, second)):
        filled = [0] * shards
        for slot in sorted(stats):
            shard = mapping[slot]
            versions.append({"version": version, "slot": slot, "shard": shard,
                             "bytes": stats[slot][0], "rows": stats[slot][1],
                             "first": filled[shard]})
            filled[shard] += stats[slot][1]
    maps = stored(local_table(spark, versions, MAP_SCHEMA), "slot-map")
    many = 4 * sum(v[1] for v in stats.values()) / max(1, len(stats))
    crowded = [s for s, v in stats.items() if v[1] > many]
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("piece"), F.col("_spread")), F.lit(PIECES)).cast("int")
    placed = placed.withColumn("_piece", F.when(F.col("virtual_slot").isin(crowded), part).otherwise(0)
                               if crowded else F.lit(0))
    earlier = Window.partitionBy("slot").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy(F.col("virtual_slot").alias("slot"), "_piece").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
               .join(F.broadcast(maps.where("version = 2")), "slot")
               .select(F.col("slot").alias("virtual_slot"), "_piece", "shard",
                       (F.col("first") + F.col("_before")).alias("_first")))
    inside = Window.partitionBy("virtual_slot", "_piece").orderBy("doc_id", "text_crc32", "size")
    out = (placed.withColumn("_n", F.row_number().over(inside))
           .join(F.broadcast(offsets), ["virtual_slot", "_piece"])  # bounded: see the module text
           .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                   (F.col("_first") + F.col("_n") - 1).cast("long").alias("slot"),
                   F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"))
    return out, maps
