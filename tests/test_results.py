"""Order of ordered results, limits of numbers, NULL options, fallbacks."""

import decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import selections, terms, worklist
from ledgerline.plans import queries as Q
from ledgerline.plans.queries import QUERIES, tables

SF = "/root/testdata/sf0.001"
D = decimal.Decimal

# query -> its order, as (column, descending)
ORDERS = {
    "uninvoiced_worklist": [("arrival_date", True), ("arrival_note_number", True)],
    "uninvoiced_worklist_filtered": [("arrival_date", True), ("arrival_note_number", True)],
    "recent_invoices": [("invoiced_date", True), ("invoice_number", True), ("id", True)],
    "aging_report": [("days_overdue", True)],
    "currency_list": [("sort_rank", False), ("code", False)],
    "payment_terms": [("days", False), ("name", False)],
    "invoice_details": [("arrival_note_number", False), ("can_line_id", False)],
    "invoice_lines": [("invoice_id", False), ("pi_line_id", False)],
    "invoice_attachments": [("created_date", True)],
    "vendor_summary": [("total_amount", True)],
    "today_by_currency": [("total", True)],
    "month_by_currency": [("total", True)],
    "folder_listing": [("folder", False)],
    "filter_options": [("facet", False), ("label", False), ("code", False)],
}


def rank(value, descending):
    """Spark's default places NULL first ascending, last descending: NULL is the smallest."""
    key = (value is not None, value if value is not None else 0)
    return key if not descending else tuple(Negated(k) for k in key)


class Negated:
    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return other.value < self.value

    def __eq__(self, other):
        return other.value == self.value


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_ordered_results_come_in_order(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    keys = [tuple(rank(r[c], down) for c, down in ORDERS[name]) for r in rows]
    assert rows and all(not b < a for a, b in zip(keys, keys[1:]))
    assert name == "today_by_currency" or len({str([r[c] for c, _ in ORDERS[name]]) for r in rows}) > 1


COLUMNS = ("selection_id long, line_no long, buying_unit_cost string, uninvoiced_quantity decimal(18,2), "
           "true_remaining_qty decimal(18,2), vat_percent int, po_number string, arrival_note_number string, "
           "pt_code string, product_name string")


def picked(spark, *rows):
    """(selection, line, cost, quantity, remaining, vat) with one product and a note per line."""
    dec = lambda v: None if v is None else D(v)
    return spark.createDataFrame([(s, n, cost, dec(q), dec(r), vat, "P1", f"N{n}", "PT", "thing")
                                  for s, n, cost, q, r, vat in rows], COLUMNS)


def test_large_totals_and_their_neighbours(spark):
    """One line of a thousand million dong and 20,000 pieces doesn't stop the other selections."""
    sel = picked(spark, (1, 1, "1000000000.00 VND", "20000", "20000", 10), (1, 2, "1000000000.00 VND", "20000", "20000", 10),
                 (2, 1, "1.50 USD", "2", "2", 0))
    got = {r["selection_id"]: r for r in selections.selection_totals(sel).collect()}
    assert got[1]["subtotal"] == D("40000000000000.00") and got[1]["total_with_vat"] == D("44000000000000.00")
    assert got[2]["subtotal"] == D("3.00")
    lines = {r["selection_id"]: r for r in selections.invoice_preview(sel).collect()}
    assert lines[1]["total"] == D("44000000000000.00") and lines[1]["an_numbers"] == "N1, N2"
    assert {r["selection_id"]: r["an_count"] for r in selections.invoice_preview(sel, lists=False).collect()} == {1: 2, 2: 1}
    notes = selections.preview_notes(sel).where("selection_id = 1").orderBy("seq").collect()
    assert [(r["seq"], r["arrival_note_number"]) for r in notes] == [(1, "N1"), (2, "N2")]


def test_large_worklist_values(spark):
    from ledgerline.functions.money import estimated_value, vat_amount
    df = spark.createDataFrame([(D("20000"), D("1000000000.00"), 10)], "q decimal(18,2), c decimal(15,2), v int")
    row = df.select(estimated_value("q", "c").alias("e"), vat_amount("q", "c", "v").alias("v")).first()
    assert row["e"] == D("20000000000000.00") and row["v"] == D("2000000000000.00")


def test_strict_nulls(spark):
    sel = picked(spark, (1, 1, "2.00 USD", "3", None, 10), (1, 2, "2.00 USD", "3", "3", 10),
                 (2, 1, "2.00 USD", "3", "3", None), (3, 1, "2.00", "3", None, None), (3, 2, "1.00 EUR", "1", "1", 20))
    loose = {r["selection_id"]: r for r in selections.selection_totals(sel).collect()}
    strict = {r["selection_id"]: r for r in selections.selection_totals(sel, strict_nulls=True).collect()}
    assert loose[1]["subtotal"] == D("6.00") and strict[1]["subtotal"] is None and strict[1]["total_with_vat"] is None
    assert strict[2]["subtotal"] == D("6.00") and strict[2]["total_vat"] is None and loose[2]["total_vat"] == 0
    assert strict[3]["total_with_vat"] == D("1.20") == loose[3]["total_with_vat"]  # rows without a currency don't count


def test_bad_costs_are_counted(spark):
    df = spark.createDataFrame([("1.50 USD",), ("x USD",), (None,), ("7 EUR",), ("",)], "buying_unit_cost string")
    got = {r["cost_text"]: r["n_lines"] for r in worklist.cost_quality(df).collect()}
    assert got == {"number": 2, "bad": 2, "none": 1}


def test_value_rows_are_in_first_seen_order(spark):
    df = spark.createDataFrame(
        [(1, 5, "b", "x", "e", None, 10), (1, 2, "a", "x", "e", "t", 0), (1, 9, "b", "y", None, "s", 10),
         (2, 1, None, "x", "e", "t", None)],
        "selection_id long, line_no long, vendor_code string, vendor_type string, legal_entity_code string, "
        "payment_term string, vat_percent int")
    got = {(r["selection_id"], r["facet"], r["seq"]): r["value"] for r in selections.selection_value_rows(df).collect()}
    assert got == {(1, "vendors", 1): "a", (1, "vendors", 2): "b", (1, "types", 1): "x", (1, "types", 2): "y",
                   (1, "entities", 1): "e", (1, "terms", 1): "t", (1, "terms", 2): "s", (1, "vats", 1): "0",
                   (1, "vats", 2): "10", (2, "types", 1): "x", (2, "entities", 1): "e", (2, "terms", 1): "t"}


def test_default_terms_when_none_is_active(spark):
    t = tables(spark, SF)
    gone = t.with_table("payment_terms", t.payment_terms.withColumn("delete_flag", F.lit(1)))
    got = [(r["id"], r["name"], r["days"]) for r in terms.payment_terms_list(gone).collect()]
    assert got == [(4, "COD", 0), (1, "Net 30", 30), (2, "Net 60", 60), (3, "Net 90", 90)]
    rows = terms.invoice_terms(gone).where("payment_term_id = 2").limit(1).collect()
    assert all(r["term_name"] == "Net 60" for r in rows)


def test_sketches_merge(spark):
    rows = spark.range(0, 60_000).select((F.col("id") % 12).cast("string").alias("arrival_month"),
                                         (F.col("id") % 50_000).alias("can_line_id"))
    sketches = rows.groupBy("arrival_month").agg(F.hll_sketch_agg("can_line_id", worklist.SKETCH_BITS).alias("sketch"))
    n = worklist.sketched_count(sketches).first()[0]
    assert abs(n - 50_000) <= 4 * worklist.sketch_error() * 50_000


def test_filters_are_recognised():
    assert not worklist._any_filter(None) and not worklist._any_filter({"vendors": [], "brands": None})
    assert worklist._any_filter({"arrival_date_to": "2001-01-01"}) and worklist._any_filter(Q.PARTY_FILTERS)


def test_filtered_worklists_equal_the_filtered_view(spark):
    """Arrival lines that are invoiced under another PO line keep their quantities under a filter."""
    t = tables(spark, SF)
    d = t.purchase_invoice_details
    crossed = d.withColumn("product_purchase_order_id", F.when(
        F.col("id") % 3 == 0, F.col("product_purchase_order_id") + 100).otherwise(F.col("product_purchase_order_id")))
    t = t.with_table("purchase_invoice_details", crossed)
    whole = worklist.uninvoiced_worklist(t, ordered=False)
    for filters in (Q.SAMPLE_FILTERS, Q.PARTY_FILTERS, {"brands": ["Brand#13"]}):
        got = worklist.uninvoiced_worklist(t, filters, ordered=False)
        named = {("consignee_code" if k == "legal_entity_code" else k): k for k in whole.columns}
        want = whole.select(*[F.col(v).alias(k) for k, v in named.items()]).where(worklist.filter_predicate(filters))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
