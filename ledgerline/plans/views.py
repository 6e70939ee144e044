"""The two denormalised views the application reads.

Neither view is defined in the source application (only their output columns
are known), so the formulas here are our own reading of the column names:

* arrival-line view (``can_tracking_full_view``): one row per active arrival
  line with invoiced / uninvoiced quantities and PO-line status.
* invoice views (``purchase_invoice_full_view``): one row per active invoice
  line with header, payment and ageing columns; plus a header-level view that
  holds the same header columns once per invoice, which the reports use so
  they never de-duplicate line rows.

Joins are grouped by key so that consecutive joins on the same key reuse one
hash partitioning; dimension tables are broadcast only after a size check.
"""

from __future__ import annotations

import datetime as _dt
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.money import CONVERTED, MONEY, cost_text
from ledgerline.operators.joins import active, dim, is_bounded, plan_bytes
from ledgerline.session import discard, written
from ledgerline.sources.tables import Tables

DEFAULT_AS_OF = _dt.date(2001, 7, 31)

QTY = "decimal(18,2)"


def _date(as_of) -> Column:
    return F.lit(as_of if as_of is not None else DEFAULT_AS_OF).cast("date")


def _pct(num: Column, den: Column) -> Column:
    """100 * num / den rounded to 2 places; NULL when den is 0 or NULL."""
    return F.when(den != 0, F.round(num * 100 / den, 2)).cast("decimal(24,2)")


def active_invoice_details(t: Tables, reduce=None) -> DataFrame:
    """Active invoice lines whose invoice header is active too (of those that ``reduce`` leaves)."""
    headers = active(t.purchase_invoices).select(F.col("id").alias("purchase_invoice_id"))
    details = active(t.purchase_invoice_details)
    return (reduce(details) if reduce else details).join(headers, "purchase_invoice_id", "left_semi")


#: Stands for "no arrival line" (a legacy invoice line), or for no PO line, in the fact aggregate.
NO_KEY = -(1 << 63)
_SUM = "decimal(25,2)"


def invoiced_facts(t: Tables, reduce=None) -> DataFrame:
    """The fact aggregate: invoiced quantity per (PO line, arrival line, invoice).

    Rolled up by PO line and by arrival line. Both roll-ups read one exchange below
    this aggregate, so the invoice lines are scanned, filtered and shuffled once
    (physically: one scan, one ReusedExchange). For that the keys are never NULL:
    an inferred IS NOT NULL filter in one of the two would tell them apart.
    """
    return (active_invoice_details(t, reduce)
            .groupBy(F.coalesce("product_purchase_order_id", F.lit(NO_KEY)).alias("po_line_key"),
                     F.coalesce("arrival_detail_id", F.lit(NO_KEY)).alias("arrival_key"),
                     "purchase_invoice_id")
            .agg(F.sum("purchased_invoice_quantity").cast(_SUM).alias("invoiced_qty")))


def po_line_invoicing(t: Tables, facts: DataFrame | None = None) -> DataFrame:
    """Per PO line: all / legacy / new invoiced quantity and legacy invoice count
    (one more row, of ``NO_KEY``, joins nothing).

    A legacy line is one with no arrival line. Rows of the fact aggregate are
    unique per invoice, so the legacy invoices are counted without a distinct.
    """
    legacy = F.col("arrival_key") == NO_KEY
    q = F.col("invoiced_qty")
    return ((facts if facts is not None else invoiced_facts(t))
            .groupBy(F.col("po_line_key").alias("product_purchase_order_id"))
            .agg(F.sum(q).cast(_SUM).alias("po_line_invoiced_qty"),
                 F.sum(F.when(legacy, q)).cast(_SUM).alias("legacy_invoice_qty"),
                 F.count(F.when(legacy, F.col("purchase_invoice_id"))).alias("legacy_invoice_count"),
                 F.sum(F.when(~legacy, q)).cast(_SUM).alias("new_invoice_qty")))


def arrival_line_invoicing(facts: DataFrame) -> DataFrame:
    """Per arrival line: invoiced quantity (one more row, of ``NO_KEY``, joins nothing)."""
    return facts.groupBy(F.col("arrival_key").alias("can_line_id")).agg(
        F.sum("invoiced_qty").cast(_SUM).alias("total_invoiced_quantity"))


def active_arrival_lines(t: Tables) -> DataFrame:
    ad = active(t.arrival_details).select(
        F.col("id").alias("can_line_id"), "arrival_id", "product_purchase_order_id",
        "arrival_quantity")
    ar = active(t.arrivals).select(F.col("id").alias("arrival_id"), "arrival_note_number",
                                   "arrival_date", "created_date")
    return ad.join(ar, "arrival_id")


#: The orders of all PO lines of the line's PO-line key: one, unless that key repeats.
ORDERS_OF_KEY = "_orders_of_key"


def _po_lines(t: Tables, part=None, orders_of_key: bool = False) -> DataFrame:
    """PO lines under their key (those of a ``part`` of the keys)."""
    ppo = t.product_purchase_orders
    if orders_of_key:
        own, same = F.struct("purchase_order_id"), Window.partitionBy("id")
        ppo = ppo.withColumn(ORDERS_OF_KEY, F.when(F.count(F.lit(1)).over(same) > 1, F.collect_list(own).over(same)))
    return (part(ppo, "id") if part else ppo).select(
        F.col("id").alias("product_purchase_order_id"), "purchase_order_id", "product_id",
        "purchase_quantity", "quantity", "purchase_unit_cost", "purchaseuom",
        "uom_conversion", "vat_gst", *([ORDERS_OF_KEY] if orders_of_key else []))


def _with_orders(t: Tables, lines: DataFrame, ppo: DataFrame | None = None) -> DataFrame:
    """Arrival lines with their PO line (one of ``ppo``), PO and product."""
    ppo = ppo if ppo is not None else _po_lines(t)
    po = active(t.purchase_orders).select(
        F.col("id").alias("purchase_order_id"), "po_number", "currency_id", "seller_company_id",
        "buyer_company_id", "payment_term_id", "creator", "po_type", "external_ref_number")
    products = t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"),
                                 "pt_code", "brand", "package_size", "standard_uom")
    lines = lines.join(ppo, "product_purchase_order_id")
    if is_bounded(products):
        return lines.join(po, "purchase_order_id").join(products, "product_id")
    # the columns of the order come last: lines of one order then lie together
    return lines.join(products, "product_id").join(po, "purchase_order_id")


def _with_parties(t: Tables, lines: DataFrame) -> DataFrame:
    """Lines of :func:`_with_orders` with their companies, currency and term."""
    comp = t.companies
    seller = dim(comp.select(F.col("id").alias("seller_company_id"),
                             F.col("english_name").alias("vendor"),
                             F.col("company_code").alias("vendor_code"),
                             F.col("company_type").alias("vendor_type"),
                             F.col("location_type").alias("vendor_location_type")))
    buyer = dim(comp.select(F.col("id").alias("buyer_company_id"),
                            F.col("english_name").alias("consignee"),
                            F.col("company_code").alias("consignee_code")))
    cur = dim(t.currencies.select(F.col("id").alias("currency_id"),
                                  F.col("code").alias("currency_code")))
    terms = dim(t.payment_terms.select(F.col("id").alias("payment_term_id"),
                                       F.col("name").alias("payment_term")))
    return (lines.join(seller, "seller_company_id")
            .join(buyer, "buyer_company_id")
            .join(cur, "currency_id")
            .join(terms, "payment_term_id", "left"))


def described(t: Tables, lines: DataFrame) -> DataFrame:
    """Arrival lines with their PO line, PO, product, companies, currency and term.

    All columns that the worklist can be filtered by are here or in the lines,
    under the names of the view, so filters can apply before any aggregate.
    """
    return _with_parties(t, _with_orders(t, lines))


def with_quantities(t: Tables, lines: DataFrame, restricted: bool = False) -> DataFrame:
    """Lines with invoiced and arrived quantities of their arrival line and PO line.

    ``restricted``: the lines are a part of the table, so invoice lines and
    arrivals are reduced to theirs before they are aggregated. Arrival lines may
    be invoiced under another PO line than their own, so an invoice line stays if
    either of its keys is wanted.
    """
    arrivals, reduce = active_arrival_lines(t), None
    if restricted:
        po_lines = lines.select("product_purchase_order_id").distinct()
        arrivals = arrivals.join(po_lines, "product_purchase_order_id", "left_semi")

        def reduce(details: DataFrame) -> DataFrame:
            own = lines.select(F.col("can_line_id").alias("arrival_detail_id"), F.lit(True).alias("_own"))
            return (details.join(po_lines.withColumn("_line", F.lit(True)), "product_purchase_order_id", "left")
                    .join(own, "arrival_detail_id", "left")
                    .where(F.col("_line").isNotNull() | F.col("_own").isNotNull()).drop("_line", "_own"))

    facts = invoiced_facts(t, reduce)
    arrived = (arrivals.groupBy("product_purchase_order_id")
               .agg(F.sum("arrival_quantity").alias("po_line_arrived_qty")))
    return (lines.join(arrival_line_invoicing(facts), "can_line_id", "left")
            # everything keyed by the PO line: one partitioning
            .join(po_line_invoicing(t, facts), "product_purchase_order_id", "left")
            .join(arrived, "product_purchase_order_id", "left"))


#: Arrival lines in files of more bytes than this are worked on in stages; the bytes of lines in a part.
STAGED_BYTES, PART_BYTES = 256 << 20, 1 << 30


def is_staged(t: Tables, table: str = "arrival_details") -> bool:
    """True when the shuffles of a whole view of this table's lines would crowd the disk."""
    return not is_bounded(t.table(table), STAGED_BYTES)


def cut(rows: DataFrame, *spent: DataFrame) -> DataFrame:
    """Ends a stage: writes its rows, which releases its shuffles, and deletes what only it read."""
    out = written(rows, "stage", delta=True)
    discard(*spent)
    return out


def _own_quantities(t: Tables, facts: DataFrame) -> DataFrame:
    """Active arrival lines with their invoiced quantity; notes and dates of those with uninvoiced quantity only,
    since the others count just as arrived."""
    ad = active(t.arrival_details).where(F.col("product_purchase_order_id").isNotNull()).select(
        F.col("id").alias("can_line_id"), "arrival_id", "product_purchase_order_id", "arrival_quantity")
    ar = active(t.arrivals).select(F.col("id").alias("arrival_id"), "arrival_note_number", "arrival_date", "created_date")
    lines = ad.join(arrival_line_invoicing(facts), "can_line_id", "left").join(ar, "arrival_id")
    described = ["can_line_id", "arrival_note_number", "arrival_date", "created_date"]
    return lines.select("product_purchase_order_id", "arrival_quantity", "total_invoiced_quantity",
                        *[F.when(uninvoiced() > 0, F.col(c)).alias(c) for c in described])


@contextmanager
def pending_parts(t: Tables, orders_of_key: bool = False):
    """The lines with uninvoiced quantity with their quantities, PO line, PO and product, in parts by the PO-line key.

    For tables of any size: facts and lines are written in stages, so the shuffles of one stage, or of
    one part, are on the disk at a time. What was written is deleted at the end of the ``with``.
    """
    facts = written(invoiced_facts(t), "facts", delta=True)
    own = written(_own_quantities(t, facts), "arrived", delta=True)
    n = 1 + plan_bytes(own) // PART_BYTES

    def build(k: int) -> DataFrame:
        def part(rows: DataFrame, key: str) -> DataFrame:
            return rows.where(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(n)) == k) if n > 1 else rows

        lines = part(own, "product_purchase_order_id")
        arrived = lines.groupBy("product_purchase_order_id").agg(F.sum("arrival_quantity").alias("po_line_arrived_qty"))
        quantities = (lines.where(uninvoiced() > 0)
                      .join(po_line_invoicing(t, part(facts, "po_line_key")), "product_purchase_order_id", "left")
                      .join(arrived, "product_purchase_order_id", "left"))
        return _with_orders(t, quantities, _po_lines(t, part, orders_of_key))

    try:
        yield [build(k) for k in range(n)]
    finally:
        discard(own, facts)


def uninvoiced() -> Column:
    return F.greatest(F.lit(0), F.col("arrival_quantity") - F.coalesce(F.col("total_invoiced_quantity"), F.lit(0)))


def _po_line_status(ordered: Column) -> Column:
    arrived = F.coalesce(F.col("po_line_arrived_qty"), F.lit(0))
    pending = ordered - F.coalesce(F.col("po_line_invoiced_qty"), F.lit(0))
    return (F.when(pending <= 0, "Fully Invoiced").when(arrived >= ordered, "Fully Arrived")
            .when(arrived > 0, "Partially Arrived").otherwise("Pending"))


def pending_keys(t: Tables) -> DataFrame:
    """The keys and status of the view's rows with uninvoiced quantity, without any of their descriptions:
    (can_line_id, arrival_note_number, arrival_date, purchase_order_id, product_id, po_line_status)."""
    exists = lambda df, key: df.select(F.col("id").alias(key))
    ppo = t.product_purchase_orders.select(F.col("id").alias("product_purchase_order_id"), "purchase_order_id",
                                           "product_id", "purchase_quantity")
    po = (active(t.purchase_orders).select(F.col("id").alias("purchase_order_id"), "seller_company_id",
                                           "buyer_company_id", "currency_id")
          .join(dim(exists(t.companies, "seller_company_id")), "seller_company_id", "left_semi")
          .join(dim(exists(t.companies, "buyer_company_id")), "buyer_company_id", "left_semi")
          .join(dim(exists(t.currencies, "currency_id")), "currency_id", "left_semi"))
    lines = with_quantities(t, active_arrival_lines(t)).where(uninvoiced() > 0)
    return (lines.join(ppo, "product_purchase_order_id")
            .join(po, "purchase_order_id", "left_semi")
            .join(exists(t.products, "product_id"), "product_id", "left_semi")
            .select("can_line_id", "arrival_note_number", "arrival_date", "purchase_order_id", "product_id",
                    _po_line_status(F.col("purchase_quantity")).alias("po_line_status")))


def can_tracking_parts(t: Tables, parts: list[DataFrame], as_of=None) -> list[DataFrame]:
    """The view's rows with uninvoiced quantity, of :func:`pending_parts`."""
    return [_view_columns(_with_parties(t, part), as_of) for part in parts]


def can_tracking_view(t: Tables, as_of=None, reduce=None, spread=None, orders_of_key: bool = False) -> DataFrame:
    """Arrival-line view (plus ``_ppo_*`` columns the worklist reuses).

    ``reduce`` (a function of the described lines) restricts them before the
    quantities are aggregated; what it leaves is written once, since four joins read it.
    ``spread`` (a function of lines with quantities) filters and distributes them before the
    names of parties, if those are broadcast, and the view's other columns are added. Then
    a large table's lines with uninvoiced quantity, all that ``spread`` leaves, are written first.
    """
    staged = spread is not None and reduce is None and is_staged(t)
    spread = spread or (lambda lines: lines)
    ppo = _po_lines(t, orders_of_key=orders_of_key)
    if reduce is not None:
        v = spread(with_quantities(t, written(reduce(described(t, active_arrival_lines(t))), "lines"), True))
    elif staged:
        with pending_parts(t) as parts:
            lines = written(parts, "pending-lines")
        v = _with_parties(t, spread(lines)) if _parties_bounded(t) else spread(_with_parties(t, lines))
    elif _parties_bounded(t):
        v = _with_parties(t, spread(_with_orders(t, with_quantities(t, active_arrival_lines(t)), ppo)))
    else:
        v = spread(_with_parties(t, _with_orders(t, with_quantities(t, active_arrival_lines(t)), ppo)))
    return _view_columns(v, as_of)


def _parties_bounded(t: Tables) -> bool:
    return all(map(is_bounded, (t.companies, t.payment_terms, t.currencies)))


def _view_columns(v: DataFrame, as_of) -> DataFrame:
    invoiced = F.coalesce(F.col("total_invoiced_quantity"), F.lit(0))
    open_qty = uninvoiced()
    pq = F.col("purchase_quantity")
    po_invoiced = F.coalesce(F.col("po_line_invoiced_qty"), F.lit(0))
    arrived_q = F.coalesce(F.col("po_line_arrived_qty"), F.lit(0))
    pending = pq - po_invoiced
    std_cost = F.when(F.col("uom_conversion") != 0,
                      F.round(F.col("purchase_unit_cost") / F.col("uom_conversion"), 4)
                      ).cast("decimal(18,4)")
    landed = F.round(std_cost * F.lit(1.05).cast("decimal(3,2)"), 4).cast("decimal(18,4)")
    return v.select(
        "can_line_id", "arrival_note_number", "arrival_date", "creator",
        F.datediff(_date(as_of), F.col("arrival_date")).alias("days_since_arrival"),
        "created_date", "vendor", "vendor_code", "vendor_type", "vendor_location_type",
        "consignee", "consignee_code", "po_number", "po_type", "external_ref_number",
        "payment_term", "product_purchase_order_id", "product_name", "pt_code", "brand",
        "package_size", "standard_uom", F.col("purchaseuom").alias("buying_uom"),
        "uom_conversion",
        F.col("arrival_quantity").cast(QTY).alias("arrival_quantity"),
        open_qty.cast(QTY).alias("uninvoiced_quantity"),
        invoiced.cast(QTY).alias("total_invoiced_quantity"),
        F.when(invoiced == 0, "Not Invoiced").when(open_qty > 0, "Partially Invoiced")
        .otherwise("Fully Invoiced").alias("invoice_status"),
        cost_text(F.col("purchase_unit_cost"), F.col("currency_code")).alias("buying_unit_cost"),
        std_cost.alias("standard_unit_cost"),
        landed.alias("landed_cost"),
        F.when(F.col("currency_code") == "USD", landed).alias("landed_cost_usd"),
        _po_line_status(pq).alias("po_line_status"),
        F.when(arrived_q > pq, "Y").otherwise("N").alias("po_line_is_over_delivered"),
        F.when(pending < 0, "Y").otherwise("N").alias("po_line_is_over_invoiced"),
        _pct(arrived_q, pq).alias("po_line_arrival_completion_percent"),
        _pct(po_invoiced, pq).alias("po_line_invoice_completion_percent"),
        pending.cast(QTY).alias("po_line_pending_invoiced_qty"),
        # PO-line columns the worklist joins in (JOI1): the view already holds
        # the PO line, so they ride along instead of a second join.
        F.col("vat_gst").alias("_ppo_vat_gst"),
        F.col("purchase_quantity").alias("_ppo_purchase_quantity"),
        F.col("quantity").alias("_ppo_quantity"),
        F.col("legacy_invoice_qty").alias("_legacy_invoice_qty"),
        F.col("legacy_invoice_count").alias("_legacy_invoice_count"),
        *[c for c in ("purchase_order_id", ORDERS_OF_KEY) if ORDERS_OF_KEY in v.columns],
    )


def _only(df: DataFrame, ids: DataFrame | None, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``ids`` (pi_id); all without ``ids``."""
    return df if ids is None else df.join(ids.withColumnRenamed("pi_id", key), key, "left_semi")


def payment_totals(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    p = _only(active(t.purchase_invoice_payments), ids, "purchase_invoice_id")
    return (p.groupBy(F.col("purchase_invoice_id").alias("pi_id"))
            .agg(F.sum("amount").alias("total_payment_made"),
                 F.count(F.lit(1)).alias("payment_count"),
                 F.max("payment_date").alias("last_payment_date")))


def _header_columns(t: Tables, as_of, ids: DataFrame | None = None) -> DataFrame:
    """Active invoice headers (of ``ids``) with vendor, entity, currency, term and payment columns."""
    pi = _only(active(t.purchase_invoices), ids, "id").select(
        F.col("id").alias("pi_id"), F.col("invoice_number").alias("inv_number"),
        F.col("commercial_invoice_no").alias("commercial_inv_number"),
        F.col("invoiced_date").alias("inv_date"), "due_date", "total_invoiced_amount",
        "seller_id", "buyer_id", "currency_id", "payment_term_id", "created_by",
        F.col("invoice_type").alias("inv_type"),
        F.col("advance_payment").alias("is_advance_payment"), "email_to_accountant")
    comp = t.companies
    seller = dim(comp.select(F.col("id").alias("seller_id"), F.col("english_name").alias("vendor"),
                             F.col("company_code").alias("vendor_code")))
    buyer = dim(comp.select(F.col("id").alias("buyer_id"),
                            F.col("english_name").alias("legal_entity"),
                            F.col("company_code").alias("legal_entity_code")))
    cur = dim(t.currencies.select(F.col("id").alias("currency_id"),
                                  F.col("code").alias("invoiced_currency")))
    terms = dim(t.payment_terms.select(F.col("id").alias("payment_term_id"),
                                       F.col("name").alias("payment_term")))
    h = (pi.join(payment_totals(t, ids), "pi_id", "left")
         .join(seller, "seller_id").join(buyer, "buyer_id").join(cur, "currency_id")
         .join(terms, "payment_term_id", "left"))
    total = F.col("total_invoiced_amount")
    paid = F.coalesce(F.col("total_payment_made"), F.lit(0))
    status = (F.when(paid >= total, "Fully Paid").when(paid > 0, "Partially Paid")
              .otherwise("Unpaid"))
    overdue = F.when(status != "Fully Paid",
                     F.greatest(F.lit(0), F.datediff(_date(as_of), F.col("due_date")))
                     ).otherwise(F.lit(0))
    return h.select(
        "pi_id", "inv_number", "commercial_inv_number", "inv_date", "due_date",
        F.col("total_invoiced_amount").cast(MONEY).alias("total_invoiced_amount"),
        "vendor", "vendor_code", "legal_entity", "legal_entity_code", "invoiced_currency",
        "payment_term", "created_by", "inv_type", "is_advance_payment", "email_to_accountant",
        paid.cast(CONVERTED).alias("total_payment_made"),
        F.coalesce(F.col("payment_count"), F.lit(0)).alias("payment_count"),
        "last_payment_date",
        F.when(total > 0, F.round(paid / total, 4)).otherwise(F.lit(0))
        .cast("decimal(24,4)").alias("payment_ratio"),
        status.alias("payment_status"),
        (total - paid).cast(CONVERTED).alias("total_outstanding_amount"),
        overdue.cast("int").alias("days_overdue"),
        F.when(status == "Fully Paid", "Paid").when(overdue == 0, "Current")
        .when(overdue <= 30, "1-30 Days").when(overdue <= 60, "31-60 Days")
        .when(overdue <= 90, "61-90 Days").otherwise("Over 90 Days").alias("aging_status"),
        F.when(status == "Fully Paid", "None").when(overdue > 90, "High")
        .when(overdue > 30, "Medium").otherwise("Low").alias("risk_level"),
    )


#: A products table of at most this many bytes is broadcast, after the sort's shuffle.
PRODUCT_MAX_BYTES = 8 << 20


def _line_columns(t: Tables, headers: DataFrame, ids: DataFrame | None = None, spread=None) -> DataFrame:
    """Active invoice lines (of ``ids``) with PO line, PO, product, arrival and header columns.

    Headers come first, while the lines are narrow; ``spread`` (a function of the joined lines)
    distributes them before the columns are added that need no shuffle.
    """
    staged = ids is None and spread is not None and is_staged(t, "purchase_invoice_details")
    spread = spread or (lambda lines: lines)
    d = _only(active(t.purchase_invoice_details), ids, "purchase_invoice_id").select(
        F.col("id").alias("pi_line_id"), F.col("purchase_invoice_id").alias("pi_id"),
        "purchase_order_id", "product_purchase_order_id", "arrival_detail_id",
        "invoiced_quantity", F.col("amount").alias("invoiced_amount"),
        F.col("vat_gst").alias("vat_percent"), "exchange_rate")
    ppo = t.product_purchase_orders.select(
        F.col("id").alias("product_purchase_order_id"), "product_id", "purchase_quantity",
        "purchase_unit_cost", F.col("purchaseuom").alias("buying_uom"),
        F.col("delete_flag").alias("ppo_delete_flag"))
    po = t.purchase_orders.select(F.col("id").alias("purchase_order_id"), "po_number")
    products = t.products.select(F.col("id").alias("product_id"),
                                 F.col("name").alias("product_name"), "pt_code",
                                 "vendor_product_code", "brand")
    arr = active_arrival_lines(t).select(F.col("can_line_id").alias("arrival_detail_id"),
                                         F.col("arrival_note_number").alias("can_number"),
                                         "arrival_date")
    po_inv = po_line_invoicing(t).select("product_purchase_order_id", "po_line_invoiced_qty")
    last = is_bounded(products, PRODUCT_MAX_BYTES)
    if staged:  # the same joins; each stage's shuffles go with its write, headers come to the lines last
        po_inv = cut(po_inv)
        by_line = cut(d.join(ppo, "product_purchase_order_id").join(po_inv, "product_purchase_order_id", "left"), po_inv)
        arr = cut(arr)
        lines = cut(by_line.join(po, "purchase_order_id").join(arr, "arrival_detail_id", "left")
                    .drop("arrival_detail_id", "purchase_order_id", "product_purchase_order_id"), by_line, arr)
        whole = (lines if last else lines.join(products, "product_id")).join(headers, "pi_id")
        lines = spread(cut(whole, lines))
    else:
        lines = (d.join(headers, "pi_id").join(ppo, "product_purchase_order_id")
                 .join(po_inv, "product_purchase_order_id", "left")
                 .join(po, "purchase_order_id")
                 .join(arr, "arrival_detail_id", "left").drop("arrival_detail_id", "purchase_order_id"))
        lines = spread(lines if last else lines.join(products, "product_id"))
    if last:
        lines = lines.join(F.broadcast(products), "product_id")
    original = F.col("purchase_quantity")
    cancelled = F.when(F.col("ppo_delete_flag") == 1, original).otherwise(F.lit(0))
    effective = original - cancelled
    remaining = effective - F.coalesce(F.col("po_line_invoiced_qty"), F.lit(0))
    return lines.select(
        "pi_id", "pi_line_id", "po_number", "pt_code", "product_name", "vendor_product_code",
        "brand", F.col("invoiced_quantity").cast(QTY).alias("invoiced_quantity"), "buying_uom",
        F.round(F.col("purchase_unit_cost") * F.col("exchange_rate"), 2).cast(CONVERTED)
        .alias("inv_unit_price"),
        F.col("invoiced_amount").cast(MONEY).alias("invoiced_amount"), "vat_percent",
        "can_number", "arrival_date",
        original.cast(QTY).alias("po_original_buying_quantity"),
        cancelled.cast(QTY).alias("po_cancelled_buying_quantity"),
        effective.cast(QTY).alias("buying_ordered_quantity"),
        remaining.cast(QTY).alias("remaining_buying_qty_to_invoice"),
        _pct(F.coalesce(F.col("po_line_invoiced_qty"), F.lit(0)), effective)
        .alias("invoice_completion_percent"),
        F.when(remaining <= 0, "Fully Invoiced").otherwise("Partially Invoiced")
        .alias("invoice_status"),
        F.when(cancelled == 0, "Not Cancelled").otherwise("Cancelled")
        .alias("po_cancellation_status"),
        F.when(remaining < 0, "Y").otherwise("N").alias("is_over_invoiced"),
        *[c for c in headers.columns if c != "pi_id"],
    )


def invoice_line_view(t: Tables, as_of=None, ids: DataFrame | None = None, spread=None) -> DataFrame:
    """``purchase_invoice_full_view``: one row per active invoice line (of the invoices ``ids``)."""
    return _line_columns(t, _header_columns(t, as_of), ids, spread)


def _with_lines(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """pi_id of the invoices (of ``ids``) that have a line in the line view, repeated.

    Keys only: whether a line is in the view depends on its joins, not on its amounts or arrivals.
    Whether its header is active isn't looked up: who calls this joins active headers.
    """
    products = t.products.select(F.col("id").alias("product_id"))
    ppo = t.product_purchase_orders.select(F.col("id").alias("product_purchase_order_id"), "product_id") \
        .join(products, "product_id", "left_semi")
    po = t.purchase_orders.select(F.col("id").alias("purchase_order_id"))
    return (_only(active(t.purchase_invoice_details), ids, "purchase_invoice_id")
            .select(F.col("purchase_invoice_id").alias("pi_id"), "purchase_order_id",
                    "product_purchase_order_id")
            .join(ppo, "product_purchase_order_id", "left_semi")
            .join(po, "purchase_order_id", "left_semi").select("pi_id"))


def invoice_header_view(t: Tables, as_of=None, ids: DataFrame | None = None) -> DataFrame:
    """The header columns of the line view, once per invoice.

    Equal to ``SELECT DISTINCT <header columns>`` over the line view (header
    columns depend on the invoice id only), computed without expanding to
    line rows: headers semi-joined with the invoices that have a view line.
    ``ids`` (a table with ``pi_id``) restricts headers, payments and lines at
    their scans, before anything is joined or summed.
    """
    return _header_columns(t, as_of, ids).join(_with_lines(t, ids), "pi_id", "left_semi")


def recent_ids(t: Tables, limit: int) -> DataFrame:
    """The newest ``limit`` invoices of the header view (date, number, id, descending), as (pi_id).

    Reads keys only: a header is in the view if its companies and currency exist and it has a
    line, so the payments, terms and names aren't needed to choose.
    """
    exists = lambda df, key: df.select(F.col("id").alias(key))
    heads = (active(t.purchase_invoices).select(F.col("id").alias("pi_id"), "invoiced_date", "invoice_number",
                                                "seller_id", "buyer_id", "currency_id")
             .join(dim(exists(t.companies, "seller_id")), "seller_id", "left_semi")
             .join(dim(exists(t.companies, "buyer_id")), "buyer_id", "left_semi")
             .join(dim(exists(t.currencies, "currency_id")), "currency_id", "left_semi")
             .join(_with_lines(t), "pi_id", "left_semi"))
    return heads.orderBy(F.col("invoiced_date").desc(), F.col("invoice_number").desc(),
                         F.col("pi_id").desc()).limit(limit).select("pi_id")
