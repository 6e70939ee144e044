"""Mixing sources to target weights along a time-varying curriculum (DataFrame operations only).

Each source has a target number of words (``source_targets``). Its weight over
training time t in [0, 1] follows a linear ramp, ``1 + slope * (2t - 1)``; the
integral of the schedule, ``D(t) = target * ((1 - slope) t + slope t^2)``, is
the source's cumulative token demand. A source's documents form a stream in
hash order, repeated in passes; a document copy whose first word is number c
of the stream is trained at ``D^-1(c)``, and the stream ends at the target (the
last copy may be cut). Documents are range-sorted by that position.

Running totals inside a source never use one task per source: documents are
cut by hash into buckets per source (their number follows the table), bucket totals give offsets,
and only a bucket is ordered at a time. Only the table of sources (one row
each) is ordered as a whole.

Defined results: a null text has size 0; a source without words has target 0 and its
documents come first; null is a source of its own; rows that
repeat a doc_id are separate documents; no rows give no rows; documents that
are not taken get ``taken`` 0 and a position of 1 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD, stored, text_or_empty, whole_row
from ledgerline.operators.joins import dim

WEIGHTS = (5, 2, 1)
#: Curriculum slope of the weight classes: the first fades, the last grows.
SLOPES = (-0.5, 0.0, 0.5)
PASSES = 3
#: Hex digits of a bucket, at least: 4096 buckets a source; more, so that one has about ``BUCKET_ROWS`` rows.
BUCKET_DIGITS = 3
BUCKET_ROWS = 50_000


def sized_documents(docs: DataFrame, seed: int = 0, whole: bool = False) -> DataFrame:
    """(doc_id, source, size, _source, _hash, _text); ``_source`` is never null.

    Documents are in the order of ``_hash`` (of the doc_id), then ``_text`` (a hash of the text,
    for rows that share a doc_id or have none). With ``whole``, ``_row`` carries all columns.
    """
    text = text_or_empty()
    return docs.select(
        *([whole_row(docs)] if whole else []),
        "doc_id", F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.lower(F.lpad(F.hex(F.xxhash64(text)), 16, "0")).alias("_text"),
    ).withColumns({
        "_source": F.when(F.col("source").isNull(), F.lit("n")).otherwise(
            F.concat(F.lit("s"), F.col("source"))),
        "_hash": F.substring(F.md5(F.concat(F.lit(f"mix{seed}:"), F.coalesce(
            F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 16)})


def bucketed(rows: DataFrame, digits: int, repeated: DataFrame | None) -> DataFrame:
    """Adds ``_bucket``, the beginning of the hash. In rows of a ``repeated`` hash (of a doc_id that
    occurs again, or none) it ends with the text's hash, so that many of them have many buckets."""
    prefix = F.substring("_hash", 1, digits)
    if repeated is None:
        return rows.withColumn("_bucket", prefix)
    shared = F.concat(F.col("_hash"), F.substring("_text", 1, digits))
    return rows.join(dim(repeated), "_hash", "left").withColumn(
        "_bucket", F.when(F.col("_many"), shared).otherwise(prefix)).drop("_many")


def bucket_digits(rows: int) -> int:
    digits = BUCKET_DIGITS
    while rows > BUCKET_ROWS * 16 ** digits and digits < 12:
        digits += 1
    return digits


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES,
                   passes: int = PASSES) -> DataFrame:
    """(_source, source_size, target, _slope) from (_source, source, source_size), one row a source.

    Sources in code point order (null last) take the weights in turn. Targets
    share the total by weight, at most ``passes`` times a source's size; what is
    cut off is shared again by weight. With sources in the order of limit /
    weight the capped ones come first, so one running sum solves it: the common
    level of the others is (total - limits before) / (weights from here on).
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = (number - 1) % len(weights) + 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), turn)
    s = sizes.withColumns({"_w": pick(weights), "_slope": pick(slopes),
                           "_limit": (F.col("source_size") * passes).cast("double")})
    s = s.withColumn("_ratio", F.col("_limit") / F.col("_w"))
    whole = Window.partitionBy()
    up = Window.orderBy("_ratio", "_source")
    s = s.withColumns({
        "_before": F.coalesce(F.sum("_limit").over(
            up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_rest": F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing)),
        "_total": F.sum("source_size").over(whole).cast("double")})
    s = s.withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_rest"))
    s = s.withColumn("_capped", F.col("_level") >= F.col("_ratio"))
    s = s.withColumn("_common", F.max(F.when(~F.col("_capped"), F.col("_level"))).over(whole))
    return s.select("_source", "source_size", "_slope", F.when(
        F.col("_capped"), F.col("_limit")).otherwise(F.col("_common") * F.col("_w")).alias("target"))


def mixture(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, passes: int = PASSES,
            seed: int = 0, whole: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position, _start, _goal), unsorted."""
    sized = stored(sized_documents(docs, seed), "sized")
    digits = bucket_digits(sized.count())
    repeated = stored(sized.groupBy("_hash").count().where("count > 1")
                      .select("_hash", F.lit(True).alias("_many")), "repeated-ids")
    repeated = None if repeated.isEmpty() else repeated
    sized = bucketed(sized, digits, repeated)
    rows = bucketed(sized_documents(docs, seed, whole=True), digits, repeated) if whole else sized
    buckets = stored(sized.groupBy("_source", "_bucket").agg(
        F.first("source").alias("source"), F.sum("size").alias("_size")), "buckets")
    targets = source_targets(
        buckets.groupBy("_source").agg(F.first("source").alias("source"),
                                       F.sum("_size").alias("source_size")),
        weights, slopes, passes)
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    # every bucket carries its source's numbers, so documents join on (source, bucket): no hot key
    offsets = (buckets.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
               .join(targets, "_source")
               .select("_source", "_bucket", "_offset", "source_size", "target", "_slope"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id", "_text", "size")
    rows = rows.withColumn("_c", F.sum("size").over(
        inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(offsets, ["_source", "_bucket"])
    rows = rows.withColumns({"_start": F.col("_offset") + F.col("_c"),
                             "_goal": F.round("target").cast("long")})
    taken = sum((copy_taken(k) for k in range(passes)), F.lit(0))
    rows = rows.withColumn("taken", taken.cast("long"))
    u = F.col("_start") / F.col("target")
    late = 1 + F.conv(F.substring("_hash", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return rows.withColumn("position", F.when(F.col("taken") > 0, demand_inverse(
        u, F.col("_slope"))).otherwise(late)).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "position",
        "_start", "_goal", "_slope", *(["_row"] if whole else []))


def copy_taken(k: int):
    """Words taken from a document's k-th copy."""
    room = F.col("_goal") - (F.col("_start") + k * F.col("source_size"))
    return F.greatest(F.lit(0), F.least(F.col("size"), room))


def demand_inverse(u, slope):
    """t with (1 - slope) t + slope t^2 = u, for u in [0, 1] and slope in (-1, 1)."""
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - slope) * (1 - slope) + 4 * slope * u))
    return 2 * u / ((1 - slope) + root)


def mix(docs: DataFrame, **options) -> DataFrame:
    """Documents with their share of the mix, range-sorted by training position."""
    out = mixture(docs, **options).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "position")
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mixed_texts(docs: DataFrame, passes: int = PASSES, **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy, in training order.

    A copy that the target cuts keeps its first ``taken`` words (and the white
    space before them). A document without words takes part once, unchanged.
    """
    plan = mixture(docs, passes=passes, whole=True, **options)
    copies = F.array(*[F.struct(F.lit(k).alias("k"), copy_taken(k).alias("w"))
                       for k in range(passes)])
    part = F.filter(copies, lambda c: (c.w > 0) | ((F.col("size") == 0) & (c.k == 0)))
    copies = plan.withColumn("_copy", F.explode(part))
    # a source without words has the target 0
    u = F.try_divide(F.col("_start") + F.col("_copy.k") * F.col("source_size"), F.col("target"))
    copies = copies.withColumn("_at", demand_inverse(F.coalesce(u, F.lit(0.0)), F.col("_slope")))
    pieces = F.regexp_extract_all(F.col("_row.text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_copy.w").cast("int")), "")
    text = F.when(F.col("_copy.w") < F.col("size"), cut).otherwise(F.col("_row.text"))
    columns = [text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return (copies.repartitionByRange("_at", "doc_id").sortWithinPartitions("_at", "doc_id")
            .select(*columns))
