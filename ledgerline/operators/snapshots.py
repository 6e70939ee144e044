"""Changes of an invoice table by month partitions.

A change (update, void, purge) touches a few invoices; rewriting the whole table
for it doesn't scale. The table is stored by the month of its ``created_date``
(``created_month``), and a change reads and replaces only the months that hold a
requested invoice. The new content of those months is written to the run's folder
first and then put in place by dynamic partition overwrite, so a failed or repeated
call starts from whole data; files of other months are never touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import mutations
from ledgerline.session import written
from ledgerline.sources.layout import MONTHLY, month_number
from ledgerline.sources.tables import Tables

MONTH = MONTHLY["purchase_invoices"][0]


def by_month(table: DataFrame) -> DataFrame:
    return table.withColumn(MONTH, month_number(F.col("created_date")))


def write_by_month(table: DataFrame, path: str) -> None:
    """Writes a table in month partitions; a month's rows meet in few files, a large month in several."""
    by_month(table).repartition(MONTH, F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy(MONTH).parquet(path)


def read_by_month(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def touched_months(table: DataFrame, ids: DataFrame) -> list:
    """The months with a requested id (None: no creation date); at most one value a month of the table's history."""
    wanted = ids.select(F.col(ids.columns[0]).alias("id"))
    rows = table.select("id", MONTH).join(wanted, "id", "left_semi").select(MONTH).distinct().collect()
    return sorted((r[MONTH] for r in rows), key=lambda m: m or 0)


def change_months(spark: SparkSession, path: str, ids: DataFrame,
                  change: Callable[[DataFrame], DataFrame]) -> list:
    """Replaces the months that hold one of ``ids`` by ``change`` of their rows; returns those months."""
    table = read_by_month(spark, path)
    months = touched_months(table, ids)
    if not months:
        return []
    known = [m for m in months if m is not None]
    inside = F.col(MONTH).isin(known) if known else F.lit(False)
    if len(known) < len(months):
        inside = inside | F.col(MONTH).isNull()
    old = table.where(inside)  # a partition filter
    new = written(by_month(change(old.drop(MONTH))), "months")
    new.repartition(MONTH, F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    left = {r[MONTH] for r in new.select(MONTH).distinct().collect()}
    for month in set(months) - left:  # a month without rows has no partition to overwrite the old one
        _remove(spark, f"{path}/{MONTH}={month if month is not None else '__HIVE_DEFAULT_PARTITION__'}")
    return months


def _remove(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def update_in_place(t: Tables, path: str, updates: DataFrame, as_of) -> list:
    """:func:`mutations.update_invoices` on the stored table at ``path``."""
    return change_months(t.spark, path, updates.select("invoice_id"), lambda old: mutations.update_invoices(
        t.with_table("purchase_invoices", old), updates, as_of)[0])


def void_in_place(t: Tables, path: str, ids: DataFrame, as_of) -> list:
    """:func:`mutations.void_invoices` on the stored table at ``path``."""
    return change_months(t.spark, path, ids, lambda old: mutations.void_invoices(
        t.with_table("purchase_invoices", old), ids, as_of)[0])


def purge_in_place(t: Tables, path: str, ids: DataFrame) -> list:
    """:func:`mutations.purge_invoices` on the stored table at ``path``."""
    return change_months(t.spark, path, ids, lambda old: mutations.purge_invoices(
        t.with_table("purchase_invoices", old), ids)[0])


def remove_links_in_place(t: Tables, path: str, link_ids: DataFrame, as_of) -> list:
    """:func:`mutations.remove_attachment_links` on the stored link table at ``path``."""
    return change_months(t.spark, path, link_ids, lambda old: mutations.remove_attachment_links(
        t.with_table("purchase_invoice_medias", old), link_ids, as_of)[0])
