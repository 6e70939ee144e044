"""SimHash near-duplicates through pivot distance tables.

``fingerprints`` computes 64-bit SimHash values inside Arrow batches. Equal
fingerprints collapse to one node, named by the fingerprint. For every node the
pivot table holds its Hamming distances to ``PIVOTS`` fixed reference
fingerprints. Two fingerprints within ``max_bits`` of each other have
coordinates that differ by at most ``max_bits`` for every pivot, so a pair with
a larger coordinate difference is discarded; survivors are verified by their
exact Hamming distance.

Pairs come from blocks, never from a cross join: the 64 bits are cut into
``max_bits + 2`` bands, and fingerprints within ``max_bits`` agree on at least
two whole bands, so each pair of bands is a block key. A block of up to
``BLOCK_ROWS`` nodes gives its pairs (linear work per node). The nodes of larger
blocks are linked exactly without pairs: two fingerprints are within 2 bits
if and only if some 64-bit value lies within 1 bit of both, so each node is
listed under its 65 such values and every value links its nodes in a star.

Connected components use alternating large-star and small-star rounds with a
written table each, so no link or component ever reaches the driver.

Defined results: null text has no words and fingerprint zero, as empty text;
zero links like any other value; rows that repeat a doc_id, or have none, are
separate documents that only their fingerprints can link; null doc_ids count as
larger than all others, and a component without any doc_id has a null
component_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ledgerline.llm.common import ascii_lower, map_arrow, stored, text_or_empty, whole_row

SHINGLE = 3
MAX_BITS = 2
PIVOTS = 16
BLOCK_ROWS = 16
#: Shingles turned into bits at a time, which bounds memory for very long texts.
CHUNK = 1 << 16


def simhash(words: list[bytes], shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a word sequence; bit i stands for value 2**i."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(
            starts[lo:min(lo + CHUNK, n)].tolist(), last[lo:lo + CHUNK].tolist())], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    on = np.packbits(counts * 2 > n, bitorder="little")
    return int(on.view(np.uint64)[0])


def pivots(n: int = PIVOTS) -> list[int]:
    """The reference fingerprints: the XXH64 values of 0 to n - 1 (signed)."""
    raw = [xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(n)]
    return [v - (1 << 64) if v >> 63 else v for v in raw]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple = ()) -> DataFrame:
    """(doc_id, the columns of ``keep``, fp): fp is the signed form of the 64-bit fingerprint."""
    def values(batches):
        for batch in batches:
            fps = [simhash(t.split(), shingle) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.array(fps, np.uint64).view(np.int64))],
                names=[*batch.schema.names[:-1], "fp"])

    # bytes.split() splits on \x20 and \x09-\x0D only
    rows = docs.select(F.col("doc_id").cast("long"), *keep,
                       ascii_lower(text_or_empty()).cast("binary").alias("norm"))
    return map_arrow(rows, values, StructType([*rows.schema.fields[:-1]]).add("fp", LongType()))


def bands(max_bits: int) -> list[int]:
    """Bit masks of max_bits + 2 bands that cut the 64 bits."""
    edges = np.linspace(0, 64, max_bits + 3).astype(int).tolist()
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst) between nodes (id, fp): within ``max_bits``, or joined by such steps."""
    if max_bits != 2:
        raise ValueError("the exact rule for large blocks is for 2 bits")
    masks = [F.lit(a) if b is None else F.lit(a | b) for a, b in combinations(bands(max_bits), 2)]
    keyed = nodes.select("id", "fp", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(m) for m in masks])).alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = stored(keyed.join(sizes, ["band", "key"]), "blocks")
    # small blocks: pairs, pruned by the pivot table, verified exactly
    coordinates = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).alias(f"p{i}")
                   for i, p in enumerate(pivots(n_pivots))]
    table = blocks.where(F.col("n") <= block_rows).select("band", "key", "id", "fp", *coordinates)
    a, b = table.alias("a"), table.alias("b")
    apart = F.greatest(*[F.abs(F.col(f"a.p{i}") - F.col(f"b.p{i}")) for i in range(n_pivots)])
    pairs = (a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key"))
                    & (F.col("a.id") < F.col("b.id")))
             .where(apart <= max_bits)
             .where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)
             .select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")))
    # large blocks: stars around the values within one bit
    one_bit = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(v)) for v in one_bit])
    crowded = blocks.where(F.col("n") > block_rows).select("id", "fp").distinct()
    around = crowded.select("id", F.explode(near).alias("value"))
    least = around.groupBy("value").agg(F.min("id").alias("dst"), F.count(F.lit(1)).alias("n"))
    stars = (around.join(least.where("n > 1"), "value").where("id != dst")
             .select(F.col("id").alias("src"), "dst"))
    return pairs.union(stars).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) of the nodes with an edge; root is the smallest id that can be reached."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large \
            else e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select(
            "src", F.least("src", "m").alias("m"))
        joined = both.join(least, "src")
        if large:
            moved = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        else:
            moved = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(
                least.select("src", F.col("m").alias("dst")))
        return moved.where("src != dst").distinct()

    edges, before = stored(edges.select("src", "dst"), "edges"), None
    for _ in range(rounds):
        edges = stored(star(star(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("src").alias("id"), F.col("dst").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def classes(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of (doc_id, fp) rows.

    ``root`` names a component by its smallest fingerprint, ``component_id`` is its smallest doc_id.
    """
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select(F.col("fp").alias("id"), "fp"), max_bits))
    nodes = nodes.join(roots, nodes["fp"] == roots["id"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    return nodes.join(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "root") \
        .select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per document."""
    rows = stored(fingerprints(docs, shingle), "simhash")
    return rows.join(classes(rows, max_bits), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (null last).

    Rows of a component that share that doc_id are told apart by a 128-bit hash
    of all their columns, the smallest of which stays; of rows equal in every
    column one stays.
    """
    flags = F.concat(*[F.col(f"`{c}`").isNull().cast("string") for c in docs.columns])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(whole_row(docs), "doc_id", "text", F.xxhash64(flags, *columns).alias("_h1"),
                         F.xxhash64(F.lit(7), flags, *columns).alias("_h2"))
    rows = stored(fingerprints(marked, shingle, ("_h1", "_h2")), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h1", "_h2")
    first = rows.join(classes(rows, max_bits), "fp").groupBy("root").agg(F.min(order).alias("one")) \
        .select(F.col("one._h1").alias("_a"), F.col("one._h2").alias("_b"))
    equal = Window.partitionBy("_h1", "_h2").orderBy("doc_id")
    kept = marked.join(first, (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b")), "left_semi")
    return kept.withColumn("_n", F.row_number().over(equal)).where("_n = 1").select("_row.*")
