"""Received goods not yet invoiced: the worklist, its filters and facets."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.money import cost_amount, cost_currency, estimated_value, vat_amount
from ledgerline.operators.joins import active, dim
from ledgerline.plans.views import (ORDERS_OF_KEY, QTY, can_tracking_parts, can_tracking_view, is_staged, pending_keys,
                                    pending_parts, uninvoiced)
from ledgerline.session import written
from ledgerline.sources.tables import Tables

# Filter keys and the view column each one restricts.
LIST_FILTERS = {
    "creators": "creator",
    "vendor_types": "vendor_type",
    "vendors": "vendor_code",
    "entities": "consignee_code",
    "brands": "brand",
    "an_numbers": "arrival_note_number",
    "po_numbers": "po_number",
}
RANGE_FILTERS = {
    "arrival_date_from": ("arrival_date", ">="),
    "arrival_date_to": ("arrival_date", "<="),
    "created_date_from": ("created_date", ">="),
    "created_date_to": ("created_date", "<="),
}

WORKLIST_COLUMNS = [
    "can_line_id", "arrival_note_number", "arrival_date", "creator", "days_since_arrival",
    "created_date", "vendor", "vendor_code", "vendor_type", "vendor_location_type",
    "legal_entity", "legal_entity_code", "po_number", "po_type", "external_ref_number",
    "payment_term", "product_purchase_order_id", "product_name", "pt_code", "brand",
    "package_size", "standard_uom", "buying_uom", "uom_conversion", "arrival_quantity",
    "uninvoiced_quantity", "total_invoiced_quantity", "invoice_status", "buying_unit_cost",
    "standard_unit_cost", "landed_cost", "landed_cost_usd", "estimated_invoice_value",
    "currency", "vat_percent", "vat_amount", "po_line_status", "po_line_is_over_delivered",
    "po_line_is_over_invoiced", "po_line_arrival_completion_percent",
    "po_line_invoice_completion_percent", "po_line_pending_invoiced_qty", "po_buying_quantity",
    "po_standard_quantity", "legacy_invoice_qty", "legacy_invoice_count", "true_remaining_qty",
    "has_legacy_invoices",
]


ORDER_COLUMNS = ("purchase_order_id", ORDERS_OF_KEY)


def filter_predicate(filters: dict | None) -> Column | None:
    """AND of the optional filters; empty or missing values add nothing.

    List values become IN-lists (Catalyst pushes them into the Parquet scan
    when the column comes straight from a table). Very long lists should be
    passed to :func:`apply_filters` as a DataFrame instead.
    """
    if not filters:
        return None
    preds = []
    for key, column in LIST_FILTERS.items():
        values = filters.get(key)
        if values is not None and not _is_frame(values) and len(values) > 0:
            preds.append(F.col(column).isin(list(values)))
    for key, (column, op) in RANGE_FILTERS.items():
        value = filters.get(key)
        if value:
            c = F.col(column)
            preds.append(c >= F.lit(value) if op == ">=" else c <= F.lit(value))
    return reduce(lambda a, b: a & b, preds) if preds else None


def _is_frame(v) -> bool:
    return isinstance(v, DataFrame)


def _any_filter(filters: dict | None) -> bool:
    filters = filters or {}
    return any(_is_frame(v) or bool(v) for v in (filters.get(k) for k in (*LIST_FILTERS, *RANGE_FILTERS)))


def apply_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    pred = filter_predicate(filters)
    if pred is not None:
        df = df.where(pred)
    for key, column in LIST_FILTERS.items():
        values = (filters or {}).get(key)
        if _is_frame(values):  # large value sets: semi join instead of an IN-list
            df = df.join(values.select(F.col(values.columns[0]).alias(column)), column,
                         "left_semi")
    return df


def uninvoiced_worklist(t: Tables, filters: dict | None = None, as_of=None,
                        ordered: bool = True) -> DataFrame:
    """Arrival lines with uninvoiced quantity, with value, VAT, PO-line and legacy columns."""
    # every filter is on a column of the candidate lines: it applies before the aggregates
    narrow = (lambda lines: apply_filters(lines, filters)) if _any_filter(filters) else None
    order = [F.col("arrival_date").desc(), F.col("arrival_note_number").desc()]

    def spread(lines: DataFrame) -> DataFrame:
        # the sort's shuffle has no column that can be computed after it
        return lines.where(uninvoiced() > 0).repartitionByRange(*order)

    out = _worklist_columns(can_tracking_view(t, as_of, narrow, spread if ordered else None))
    return out.orderBy(*order) if ordered else out


@contextmanager
def worklist_parts(t: Tables, as_of=None):
    """The unordered worklist as DataFrames of a part each (one, unless the tables are large), to be used before
    the ``with`` ends; ``purchase_order_id`` and ``ORDERS_OF_KEY`` follow its columns."""
    if is_staged(t):
        with pending_parts(t, True) as parts:
            yield [_worklist_columns(can, ORDER_COLUMNS) for can in can_tracking_parts(t, parts, as_of)]
    else:
        yield [_worklist_columns(can_tracking_view(t, as_of, orders_of_key=True), ORDER_COLUMNS)]


def _worklist_columns(can: DataFrame, more: tuple = ()) -> DataFrame:
    can = can.where(F.col("uninvoiced_quantity") > 0)
    unit = cost_amount("buying_unit_cost")
    legacy_qty = F.coalesce(F.col("_legacy_invoice_qty"), F.lit(0))
    pending = F.col("po_line_pending_invoiced_qty")
    uninv = F.col("uninvoiced_quantity")
    # GREATEST(0, LEAST(uninvoiced, pending)) with MySQL NULL semantics
    true_remaining = F.when(uninv.isNotNull() & pending.isNotNull(),
                            F.greatest(F.lit(0), F.least(uninv, pending)))
    return can.select(
        *[c for c in WORKLIST_COLUMNS[:10]],
        F.col("consignee").alias("legal_entity"),
        F.col("consignee_code").alias("legal_entity_code"),
        *WORKLIST_COLUMNS[12:32],
        estimated_value(uninv, unit).alias("estimated_invoice_value"),
        cost_currency("buying_unit_cost").alias("currency"),
        F.coalesce(F.col("_ppo_vat_gst"), F.lit(0)).alias("vat_percent"),
        vat_amount(uninv, unit, F.col("_ppo_vat_gst")).alias("vat_amount"),
        *WORKLIST_COLUMNS[36:42],
        F.col("_ppo_purchase_quantity").cast(QTY).alias("po_buying_quantity"),
        F.col("_ppo_quantity").cast(QTY).alias("po_standard_quantity"),
        legacy_qty.cast(QTY).alias("legacy_invoice_qty"),
        F.coalesce(F.col("_legacy_invoice_count"), F.lit(0)).alias("legacy_invoice_count"),
        true_remaining.cast(QTY).alias("true_remaining_qty"),
        F.when(legacy_qty > 0, "Y").otherwise("N").alias("has_legacy_invoices"),
        *more,
    )


# Facet name -> (code column, label column) of the filter lists, by the table that has them.
PO_FACETS = [
    ("creators", "creator", "creator"),
    ("vendor_types", "vendor_type", "vendor_type"),
    ("vendors", "vendor_code", "vendor"),
    ("entities", "consignee_code", "consignee"),
    ("po_numbers", "po_number", "po_number"),
]
PRODUCT_FACETS = [("brands", "brand", "brand")]
LINE_FACETS = [
    ("an_numbers", "arrival_note_number", "arrival_note_number"),
    ("po_line_statuses", "po_line_status", "po_line_status"),
]


def _entries(rows: DataFrame, facets) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("code"),
                               F.col(lbl).cast("string").alias("label")) for f, c, lbl in facets])
    return rows.select(F.explode(pairs).alias("e")).select("e.*").where(F.col("code").isNotNull())


def filter_options(t: Tables, as_of=None) -> DataFrame:
    """Distinct filter values of the worklist as (facet, code, label) rows, sorted in each facet.

    The worklist's rows are reduced to their keys and written once. Facets of the
    purchase order and of the product come from those tables, semi-joined with the
    keys, so their values aren't copied to every line; only the note number and the
    status are read from the lines. Entries are de-duplicated before the shuffle, so
    a facet with few values never hot-spots one task.
    """
    keys = written(pending_keys(t).groupBy("arrival_note_number", "purchase_order_id", "product_id",
                                           "po_line_status").count(), "pending-keys")
    companies = t.companies
    seller = dim(companies.select(F.col("id").alias("seller_company_id"), F.col("english_name").alias("vendor"),
                                  F.col("company_code").alias("vendor_code"),
                                  F.col("company_type").alias("vendor_type")))
    buyer = dim(companies.select(F.col("id").alias("buyer_company_id"), F.col("english_name").alias("consignee"),
                                 F.col("company_code").alias("consignee_code")))
    orders = (active(t.purchase_orders).select(F.col("id").alias("purchase_order_id"), "po_number", "creator",
                                               "seller_company_id", "buyer_company_id")
              .join(keys.select("purchase_order_id").distinct(), "purchase_order_id", "left_semi")
              .join(seller, "seller_company_id").join(buyer, "buyer_company_id"))
    products = t.products.select(F.col("id").alias("product_id"), "brand").join(
        keys.select("product_id").distinct(), "product_id", "left_semi")
    return (_entries(orders, PO_FACETS).unionByName(_entries(products, PRODUCT_FACETS))
            .unionByName(_entries(keys, LINE_FACETS)).distinct().orderBy("facet", "label", "code"))


def pending_count(t: Tables, as_of=None) -> DataFrame:
    """COUNT(DISTINCT can_line_id) of arrival lines still uninvoiced."""
    return pending_keys(t).agg(F.count_distinct("can_line_id").alias("pending_count"))


#: log2 of the registers of a sketch: a relative error of about 0.83 / sqrt(2^12) = 1.3 %.
SKETCH_BITS = 12


def pending_sketches(t: Tables) -> DataFrame:
    """(arrival_month, sketch): an HLL sketch of the pending arrival lines of each month.

    Sketches are a few kB each, can be stored, and merge (:func:`sketched_count`) without the
    lines: a new month adds its sketch, and any range of months is counted from theirs.
    """
    month = F.date_format("arrival_date", "yyyy-MM").alias("arrival_month")
    return (pending_keys(t).select("can_line_id", month)
            .groupBy("arrival_month").agg(F.hll_sketch_agg("can_line_id", SKETCH_BITS).alias("sketch")))


def sketched_count(sketches: DataFrame) -> DataFrame:
    """(pending_estimate) of the union of stored sketches."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("pending_estimate"))


def sketch_error(bits: int = SKETCH_BITS) -> float:
    """The relative standard error of a merged sketch."""
    return 1.04 / (1 << bits) ** 0.5


def cost_quality(rows: DataFrame) -> DataFrame:
    """(cost_text, n_lines): how many rows have a cost whose first token is a number (``number``),
    isn't one (``bad``: read as NULL, where the source's cast reads 0), or no cost text (``none``)."""
    kind = (F.when(F.col("buying_unit_cost").isNull(), "none")
            .when(cost_amount("buying_unit_cost").isNull(), "bad").otherwise("number"))
    kinds = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("number", "bad", "none"))))
                                              .alias("cost_text"))
    n = rows.groupBy(kind.alias("cost_text")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(F.broadcast(n), "cost_text", "left").select(  # at most three rows
        "cost_text", F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"))
