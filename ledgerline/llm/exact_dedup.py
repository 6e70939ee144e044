"""Exact deduplication with counting quotient filters and byte verification.

Every partition builds a counting quotient filter of its fingerprints
(XXH64 of the normalised text): the top bits choose a block, the next bits are
the quotient inside the block, the rest is the remainder. A block keeps one
``occupieds`` bit per quotient, one ``runends`` bit per entry, the remainders
of all runs in order, and a counter per entry. Filters hold whole
fingerprints, so merging two blocks by their sorted remainders loses nothing.
Blocks are merged per block number; copies add to a counter, so a group of
copies never makes a large group. Fingerprints with a count above one route
their rows to byte verification: an aggregate whose key is the text itself, so
that texts with equal fingerprints but different bytes stay apart.

Defined results: null counts as empty; rows tied at the largest doc_id of a
group all stay (they can't be told apart); a null doc_id loses to any other;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ascii_lower, group_arrow, map_arrow, stored, text_or_empty

#: Blocks are at least this power of two, and of about ``BLOCK_ROWS`` rows each.
BLOCK_BITS = 10
BLOCK_ROWS = 1 << 20
QUOTIENT_BITS = 8
#: Fingerprints are broadcast up to this many (8 bytes each); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 500_000
BLOCK_SCHEMA = "block long, occupieds binary, runends binary, remainders binary, counts binary"


def encode(fps: np.ndarray, counts: np.ndarray, block_bits: int = BLOCK_BITS,
           quotient_bits: int = QUOTIENT_BITS) -> Iterator[dict]:
    """Quotient-filter blocks of sorted distinct fingerprints with their counts."""
    block = (fps >> np.uint64(64 - block_bits)).astype(np.int64)
    left = 64 - block_bits - quotient_bits
    quotient = ((fps >> np.uint64(left)) & np.uint64((1 << quotient_bits) - 1)).astype(np.int64)
    remainder = fps & np.uint64((1 << left) - 1)
    edges = np.flatnonzero(np.diff(block)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(fps)]):
        if hi == lo:
            continue
        q = quotient[lo:hi]
        occupieds = np.zeros(1 << quotient_bits, dtype=bool)
        occupieds[q] = True
        runends = np.append(np.diff(q) > 0, True)
        yield {"block": int(block[lo]), "occupieds": np.packbits(occupieds).tobytes(),
               "runends": np.packbits(runends).tobytes(),
               "remainders": remainder[lo:hi].tobytes(), "counts": counts[lo:hi].tobytes()}


def decode(block: int, occupieds: bytes, runends: bytes, remainders: bytes, counts: bytes,
           block_bits: int = BLOCK_BITS, quotient_bits: int = QUOTIENT_BITS):
    """The sorted fingerprints of a block and their counts."""
    rest = np.frombuffer(remainders, np.uint64)
    ends = np.unpackbits(np.frombuffer(runends, np.uint8))[:len(rest)].astype(np.int64)
    run = np.cumsum(ends) - ends
    quotients = np.flatnonzero(np.unpackbits(np.frombuffer(occupieds, np.uint8)))
    left = 64 - block_bits - quotient_bits
    fps = (np.uint64(block) << np.uint64(64 - block_bits)) \
        | (quotients[run].astype(np.uint64) << np.uint64(left)) | rest
    return fps, np.frombuffer(counts, np.int64)


def merge_sorted(fps: np.ndarray, counts: np.ndarray):
    """Adds up the counters of equal fingerprints (runs of sorted filters, one after another)."""
    order = np.argsort(fps, kind="stable")
    fps, counts = fps[order], counts[order]
    first = np.flatnonzero(np.append(True, fps[1:] != fps[:-1])) if len(fps) else np.empty(0, int)
    return fps[first], np.add.reduceat(counts, first) if len(first) else counts


def block_bits(rows: int) -> int:
    """The power of two of the blocks for so many rows: their number follows the table, their size doesn't."""
    return min(40, max(BLOCK_BITS, (rows // BLOCK_ROWS).bit_length()))


def partition_filters(bits: int):
    """The filters of a partition's fingerprints, block by block."""
    def build(batches):
        parts = []  # (fingerprints, counts), each at least twice as large as the next
        for batch in batches:
            new = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            parts.append(merge_sorted(new, np.ones(len(new), np.int64)))
            while len(parts) > 1 and len(parts[-2][0]) < 2 * len(parts[-1][0]):
                parts[-2:] = [merge_sorted(*(np.concatenate(c) for c in zip(*parts[-2:])))]
        if parts:
            fps, counts = merge_sorted(*(np.concatenate(c) for c in zip(*parts)))
            blocks = list(encode(fps, counts, bits))
            for at in range(0, len(blocks), 4096):
                yield pa.RecordBatch.from_pylist(blocks[at:at + 4096], schema=pa.schema(
                    [("block", pa.int64())] + [(c, pa.binary()) for c in (
                        "occupieds", "runends", "remainders", "counts")]))

    return build


def block_merge(bits: int):
    def merge(table: pa.Table) -> pa.Table:
        parts = [decode(**row, block_bits=bits) for row in table.to_pylist()]
        fps, counts = merge_sorted(*(np.concatenate(c) for c in zip(*parts)))
        more = counts > 1
        return pa.table({"fp": fps[more].view(np.int64), "n": counts[more]})

    return merge


def repeated_fingerprints(fps: DataFrame) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once in column ``fp``."""
    bits = block_bits(fps.count())
    blocks = map_arrow(fps.select("fp"), partition_filters(bits), BLOCK_SCHEMA)
    return group_arrow(blocks, "block", block_merge(bits), "fp long, n long")


def dedup(docs: DataFrame, fingerprint=F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    ``fingerprint`` makes a long from the normalised text; any will do, since texts are compared.
    """
    texts = docs.select("doc_id", ascii_lower(text_or_empty()).alias("norm")) \
        .withColumn("fp", fingerprint("norm"))
    rows = stored(texts.select("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256")),
                  "fingerprints")
    repeated = stored(repeated_fingerprints(rows), "repeated").select("fp")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    groups = (texts.join(repeated, "fp", "left_semi")
              .groupBy("fp", "norm")
              .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .select("fp", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    out = rows.join(groups, ["fp", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"),
                      F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
