"""Gap-free 1-based numbering without a single-task window.

``row_number() OVER (PARTITION BY g ORDER BY k)`` puts every row of group
``g`` into one task; with no partition it puts the whole table into one task.
Here the keys are range-partitioned and sorted by (g, k) instead, so a large
group spans many tasks. Each key's position is its index inside its task plus
the count of keys of the same group in earlier tasks; those per-task counts
form a small table (groups x tasks at most).

What is sorted is written (to the shared folder of the run, so both uses see the
same order even if a task is re-run after an executor loss): the keys alone in
:func:`key_numbers`, the rows in :func:`row_numbers`, which so need no join back to
their numbers. Groups that fit in a task are numbered by a window instead, after a
count of rows by a hash of the group has shown that they do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.joins import dim
from ledgerline.session import written

_G = "_seq_group"


def key_numbers(keys: DataFrame, group_cols: list[str], order_cols: list[str], out: str = "row_id") -> DataFrame:
    """``keys`` with ``out``, the position in ``order_cols`` order within ``group_cols``.

    Every column of ``keys`` is written, so it should hold the keys only.
    """
    groups = list(group_cols)
    if not groups:
        keys, groups = keys.withColumn(_G, F.lit(0)), [_G]
    ordered = written(
        keys.repartitionByRange(*groups, *order_cols).sortWithinPartitions(*groups, *order_cols)
        .withColumn("_seq_task", F.spark_partition_id()).withColumn("_seq_mono", F.monotonically_increasing_id()),
        "sequence")
    per_task = (ordered.groupBy(*groups, "_seq_task")
                .agg(F.count(F.lit(1)).alias("_seq_n"), F.min("_seq_mono").alias("_seq_first")))
    # keys of the same group in earlier tasks (small table: one row per group x task)
    earlier = Window.partitionBy(*groups).orderBy("_seq_task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = per_task.withColumn("_seq_offset", F.coalesce(F.sum("_seq_n").over(earlier), F.lit(0)))
    if groups == [_G]:  # one row per task: bounded by the number of tasks
        per_task = F.broadcast(per_task)
    per_task = per_task.select(*[F.col(g).alias(f"_seq_{i}") for i, g in enumerate(groups)],
                               F.col("_seq_task").alias("_seq_own"), "_seq_offset", "_seq_first")
    same = F.col("_seq_task") == F.col("_seq_own")
    for i, g in enumerate(groups):  # NULL is a group of its own
        same = same & F.col(g).eqNullSafe(F.col(f"_seq_{i}"))
    numbered = ordered.join(per_task, same).withColumn(
        out, (F.col("_seq_offset") + F.col("_seq_mono") - F.col("_seq_first") + 1).cast("long"))
    return numbered.select(*[c for c in keys.columns if c != _G], out)


#: Rows of one group that a single task may number, and the buckets in which groups are counted.
HOT_ROWS, BUCKETS = 1 << 20, 1 << 16
_TIE, _TIES, _AT = "_seq_tie", "_seq_ties", "_seq_at"


def _ties(keys: list[str]) -> dict:
    """Number of the rows that share all keys, and the row's place among them."""
    same = Window.partitionBy(*keys)
    return {_TIES: F.count(F.lit(1)).over(same), _TIE: F.row_number().over(same.orderBy(keys[-1]))}


def _numbered(rows: DataFrame, columns: list[str], out: str) -> DataFrame:
    """A row per number of the row's keys: one, unless rows share their keys."""
    first = F.col(_AT) - F.col(_TIE) + 1
    return rows.select(*columns, F.explode(F.sequence(first, first + F.col(_TIES) - 1)).alias(out))


def _in_groups(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """Numbers rows whose groups fit in a task: one shuffle by group."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("long")
    # the ties share the sort order, so both windows read one sorted exchange
    rows = df.repartition(*groups).withColumn(_AT, place).withColumns(_ties([*groups, *order]))
    return _numbered(rows, df.columns, out)


def _in_ranges(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """Numbers rows of groups of any size: whole rows are range-partitioned, sorted and written once."""
    # ranges of exactly the keys that the ties are counted by: with a constant among them (a group
    # of its own, say) Spark would hash the rows again for the count, and lose their order
    keys, by = [*groups, *order], list(groups) or [_G]
    rows = df.repartitionByRange(*keys).withColumns(_ties(keys))
    ordered = written(rows.withColumns({"_seq_task": F.spark_partition_id(),
                                        "_seq_mono": F.monotonically_increasing_id()}), "sequence")
    if not groups:
        ordered = ordered.withColumn(_G, F.lit(0))
    per_task = (ordered.groupBy(*by, "_seq_task")
                .agg(F.count(F.lit(1)).alias("_seq_n"), F.min("_seq_mono").alias("_seq_first")))
    # rows of the same group in earlier tasks
    earlier = Window.partitionBy(*by).orderBy("_seq_task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = per_task.select(*[F.col(g).alias(f"_seq_{i}") for i, g in enumerate(by)],
                               F.col("_seq_task").alias("_seq_own"), "_seq_first",
                               F.coalesce(F.sum("_seq_n").over(earlier), F.lit(0)).alias("_seq_offset"))
    same = F.col("_seq_task") == F.col("_seq_own")
    for i, g in enumerate(by):  # NULL is a group of its own
        same = same & F.col(g).eqNullSafe(F.col(f"_seq_{i}"))
    # one row per task and group: written, so that its size is known
    rows = ordered.join(dim(written(per_task, "sequence-tasks")), same)
    return _numbered(rows.withColumn(_AT, F.col("_seq_offset") + F.col("_seq_mono") - F.col("_seq_first") + 1),
                     df.columns, out)


def row_numbers(df: DataFrame, group_cols: list[str], order_cols: list[str], out: str = "row_id",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``out`` = 1-based position in ``order_cols`` order within ``group_cols``.

    Groups and order together must name a row (add a key column); rows that share them
    get each of their numbers. Rows are written once and counted by a hash of their group:
    groups in buckets of at most ``hot_rows`` rows are numbered by a window, after one
    shuffle; the others, and a numbering without groups, by ranges (:func:`_in_ranges`).
    """
    groups, order = list(group_cols), list(order_cols)
    if not groups:
        return _in_ranges(df, groups, order, out)
    rows = written(df, "rows")
    bucket = F.pmod(F.xxhash64(*groups), F.lit(BUCKETS))
    # at most BUCKETS numbers, and at most one per hot_rows rows
    hot = [r[0] for r in rows.groupBy(bucket.alias("b")).count().where(F.col("count") > hot_rows).select("b").collect()]
    if not hot:
        return _in_groups(rows, groups, order, out)
    is_hot = bucket.isin(hot)
    return _in_groups(rows.where(~is_hot), groups, order, out).unionByName(
        _in_ranges(rows.where(is_hot), groups, order, out))
