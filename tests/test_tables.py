"""Appends, snapshots, stand-in multiplicity and money at full precision."""

import datetime as dt
import decimal
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.money import format_rate
from ledgerline.operators import attachments, invoicing, mutations, selections
from ledgerline.plans.queries import QUERIES, sample_selections, tables
from ledgerline.sources.tables import Tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_append_keeps_old_rows_readable(spark):
    t = tables(spark, SF)
    root = tempfile.mkdtemp(prefix="ledgerline-append-")
    for name in ("purchase_invoices", "purchase_invoice_details"):
        t.table(name).write.parquet(f"{root}/{name}")
    headers, lines = QUERIES["new_invoice_headers"](spark, SF), QUERIES["new_invoice_lines"](spark, SF)
    invoicing.append_invoices(headers, lines, root)
    new = Tables.from_parquet(spark, root)
    for name, rows in (("purchase_invoices", headers), ("purchase_invoice_details", lines)):
        assert new.table(name).count() == t.table(name).count() + rows.count() > t.table(name).count()
        assert new.table(name).schema == t.table(name).schema
        assert new.table(name).select("id").distinct().count() == new.table(name).count()


def test_one_snapshot_row_per_invoice(spark):
    t = tables(spark, SF)
    ids = [r["id"] for r in t.purchase_invoices.where("delete_flag = 0").limit(2).collect()]
    fields = {f: None for f in mutations.UPDATABLE_FIELDS}
    rows = [(ids[0], 1, "first"), (ids[0], 2, "second"), (ids[1], 1, "other"), (-5, 1, "none")]
    updates = spark.createDataFrame([(i, n, c) for i, n, c in rows],
                                    "invoice_id long, request_no int, commercial_invoice_no string")
    for f in fields:
        updates = updates.withColumn(f"has_{f}", F.lit(f == "commercial_invoice_no"))
        if f not in updates.columns:
            updates = updates.withColumn(f, F.lit(None))
    snapshot, report = mutations.update_invoices(t, updates, dt.date(2001, 7, 31))
    assert snapshot.count() == t.purchase_invoices.count()
    got = {r["id"]: r["commercial_invoice_no"] for r in snapshot.where(F.col("id").isin(ids)).collect()}
    assert got == {ids[0]: "second", ids[1]: "other"}
    assert sorted(r["updated"] for r in report.collect()) == [False, False, True, True]


def test_replaced_table_drops_derived_inputs(spark):
    t = tables(spark, SF)
    assert sample_selections(t).count() > 0
    assert sample_selections(t.with_table("arrival_details", t.arrival_details.limit(0))).count() == 0


def test_conversion_keeps_every_digit(spark):
    t = tables(spark, SF)
    rates = spark.createDataFrame(
        [(1, "USD", "VND", decimal.Decimal("25400"), dt.date(2001, 1, 1), dt.datetime(2001, 1, 1), 0)],
        "id long, from_currency_code string, to_currency_code string, rate_value decimal(18,6), rate_date date, "
        "created_date timestamp, delete_flag int")
    sel = spark.createDataFrame(
        [(1, 1, "1000000000.00 VND", decimal.Decimal(1), decimal.Decimal("7.5")),
         (2, 1, "50000000.00 USD", decimal.Decimal(1), decimal.Decimal("0"))],
        "selection_id long, line_no long, buying_unit_cost string, uninvoiced_quantity decimal(15,2), "
        "vat_percent decimal(4,1)")
    target = spark.createDataFrame([(1, "USD"), (2, "VND")], "selection_id long, invoice_currency string")
    got = {r["selection_id"]: r for r in selections.amounts_in_currency(
        t.with_table("exchange_rates", rates), sel, target).collect()}
    assert got[1]["subtotal"] == decimal.Decimal("39370.08")
    assert got[1]["total_vat"] == decimal.Decimal("2952.76")
    assert got[2]["subtotal"] == decimal.Decimal("1270000000000.00")


def test_format_rate_has_no_digit_limit(spark):
    df = spark.createDataFrame([(1.23e-30,), (0.9999,), (0.00394,), (None,)], "r double")
    got = [r[0] for r in df.select(format_rate("r")).collect()]
    assert got[0].startswith("0.000") and got[0].rstrip("0").endswith("123") and got[1:] == ["1.000", "0.00394", "N/A"]


def test_listing_keys_are_relative(spark):
    root = tempfile.mkdtemp(prefix="ledgerline-listing-")
    os.makedirs(f"{root}/purchase-invoice-file/sub")
    for name in ("purchase-invoice-file/a.pdf", "purchase-invoice-file/sub/b.pdf", "root.txt"):
        with open(f"{root}/{name}", "w") as fh:
            fh.write("x" * 10)
    listing = attachments.listing_from_folder(spark, root)
    assert sorted(r["key"] for r in attachments.list_files(listing, "purchase-invoice-file").collect()) == [
        "purchase-invoice-file/a.pdf", "purchase-invoice-file/sub/b.pdf"]
    sizes = {r["prefix"]: r["total_bytes"] for r in attachments.folder_sizes(listing).collect()}
    assert sizes == {"": 10, "purchase-invoice-file/": 20}


def test_stand_in_has_several_rows_per_key(spark):
    t = tables(spark, SF)
    most = lambda df, *keys: df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    d = t.purchase_invoice_details
    assert most(t.arrival_details, "product_purchase_order_id") > 1
    assert most(d, "product_purchase_order_id") > 1
    assert most(d.where("arrival_detail_id is not null"), "arrival_detail_id") > 1
    assert most(t.purchase_invoice_payments, "purchase_invoice_id") > 1
    assert most(d.select("purchase_invoice_id", "purchase_order_id").distinct(), "purchase_invoice_id") > 1
    assert most(t.purchase_invoices, "invoice_number") > 1
    both = d.groupBy("product_purchase_order_id").agg(
        F.count_if(F.col("arrival_detail_id").isNull()).alias("old"), F.count("arrival_detail_id").alias("new"))
    assert both.where("old > 0 and new > 0").count() > 1
