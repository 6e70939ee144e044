"""Invoice reports: recent invoices, look-ups, vendor summary, ageing, dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.dedup import first_per_key
from ledgerline.operators.joins import active, dim
from ledgerline.operators.worklist import pending_count
from ledgerline.plans.views import _date, invoice_header_view, invoice_line_view, recent_ids
from ledgerline.session import written
from ledgerline.sources.layout import MONTHLY, month_number
from ledgerline.sources.tables import Tables

RECENT_COLUMNS = [
    ("pi_id", "id"), ("inv_number", "invoice_number"),
    ("commercial_inv_number", "commercial_invoice_no"), ("inv_date", "invoiced_date"),
    ("due_date", "due_date"), ("total_invoiced_amount", "total_invoiced_amount"),
    ("vendor", "vendor"), ("vendor_code", "vendor_code"), ("legal_entity", "buyer"),
    ("legal_entity_code", "buyer_code"), ("invoiced_currency", "currency"),
    ("payment_term", "payment_term"), ("created_by", "created_by"),
    ("inv_type", "invoice_type"), ("is_advance_payment", "advance_payment"),
    ("payment_status", "payment_status"),
    ("total_outstanding_amount", "total_outstanding_amount"),
    ("aging_status", "aging_status"), ("risk_level", "risk_level"),
    ("days_overdue", "days_overdue"), ("payment_count", "payment_count"),
    ("last_payment_date", "last_payment_date"),
]

BY_ID_COLUMNS = [
    ("pi_id", "id"), ("inv_number", "invoice_number"),
    ("commercial_inv_number", "commercial_invoice_no"), ("inv_date", "invoiced_date"),
    ("due_date", "due_date"), ("total_invoiced_amount", "total_invoiced_amount"),
    ("vendor_code", "vendor_code"), ("vendor", "vendor_name"),
    ("legal_entity_code", "buyer_code"), ("legal_entity", "buyer_name"),
    ("invoiced_currency", "currency_code"), ("payment_term", "payment_term_name"),
    ("created_by", "created_by"), ("inv_type", "invoice_type"),
    ("is_advance_payment", "is_advance_payment"), ("email_to_accountant", "email_to_accountant"),
    ("payment_status", "payment_status"), ("total_outstanding_amount", "total_outstanding_amount"),
    ("total_payment_made", "total_payment_made"), ("payment_ratio", "payment_ratio"),
    ("aging_status", "aging_status"), ("risk_level", "risk_level"),
]

LINE_COLUMNS = [
    ("pi_line_id", "pi_line_id"), ("po_number", "po_number"), ("pt_code", "pt_code"),
    ("product_name", "product_name"), ("vendor_product_code", "vendor_product_code"),
    ("brand", "brand"), ("invoiced_quantity", "purchased_invoice_quantity"),
    ("buying_uom", "buying_uom"), ("inv_unit_price", "inv_unit_price"),
    ("invoiced_amount", "amount"), ("vat_percent", "vat_gst"),
    ("can_number", "arrival_note_number"), ("arrival_date", "arrival_date"),
    ("po_original_buying_quantity", "po_original_buying_quantity"),
    ("po_cancelled_buying_quantity", "po_cancelled_buying_quantity"),
    ("buying_ordered_quantity", "effective_po_quantity"),
    ("remaining_buying_qty_to_invoice", "remaining_buying_qty_to_invoice"),
    ("invoice_completion_percent", "invoice_completion_percent"),
    ("invoice_status", "invoice_status"), ("po_cancellation_status", "po_cancellation_status"),
    ("is_over_invoiced", "is_over_invoiced"),
]

AGING_COLUMNS = [
    ("inv_number", "invoice_number"), ("vendor", "vendor"),
    ("total_invoiced_amount", "total_invoiced_amount"), ("invoiced_currency", "currency"),
    ("inv_date", "invoiced_date"), ("due_date", "due_date"), ("days_overdue", "days_overdue"),
    ("aging_status", "aging_status"), ("payment_status", "payment_status"),
    ("total_outstanding_amount", "total_outstanding_amount"),
    ("payment_ratio", "payment_ratio"), ("risk_level", "risk_level"),
]


def _rename(df: DataFrame, pairs) -> DataFrame:
    return df.select(*[F.col(a).alias(b) for a, b in pairs])


def recent_invoices(t: Tables, limit: int = 100, as_of=None) -> DataFrame:
    """The ``limit`` newest invoices (invoice date, number, then id, descending).

    The top-k runs on narrow key rows (a top-k per task plus one merge); payments and
    details are then read for its ``limit`` ids only, which are written so that every
    scan is reduced by the same small table.
    """
    newest = F.broadcast(written(recent_ids(t, limit), "recent"))  # at most ``limit`` rows
    return _rename(invoice_header_view(t, as_of, newest), RECENT_COLUMNS).orderBy(
        F.col("invoiced_date").desc(), F.col("invoice_number").desc(), F.col("id").desc())


def invoices_by_id(t: Tables, ids: DataFrame, as_of=None) -> DataFrame:
    """Invoice records for a set of ids (batch form of a by-id look-up), which reduce every scan."""
    ids = ids.select(F.col(ids.columns[0]).alias("pi_id")).distinct()
    return _rename(invoice_header_view(t, as_of, ids), BY_ID_COLUMNS)


def invoice_lines(t: Tables, ids: DataFrame | None = None, as_of=None) -> DataFrame:
    """Line items (21 display columns) of the given invoices, or of all invoices."""
    if ids is not None:
        ids = ids.select(F.col(ids.columns[0]).alias("pi_id"))
    # the sort's shuffle has no column that can be computed after it
    v = invoice_line_view(t, as_of, ids, lambda lines: lines.repartitionByRange("pi_id", "pi_line_id"))
    return v.select(F.col("pi_id").alias("invoice_id"),
                    *[F.col(a).alias(b) for a, b in LINE_COLUMNS]).orderBy("invoice_id",
                                                                           "pi_line_id")


def vendor_summary(t: Tables, start_date=None, end_date=None, dedup: str = "value",
                   as_of=None) -> DataFrame:
    """Per vendor and currency: invoice counts, amounts, last date, outstanding.

    ``dedup="value"`` keeps the source's SUM/AVG DISTINCT semantics (two
    invoices of equal amount count once). ``dedup="invoice"`` sums each
    invoice once instead. Either way the input is one row per invoice, so no
    line rows are expanded, and what is distinct is found by one aggregate (several
    DISTINCTs would copy each invoice once for each); averages are Σ/n in double precision.
    """
    h = invoice_header_view(t, as_of)
    if start_date:
        h = h.where(F.col("inv_date") >= F.lit(start_date).cast("date"))
    if end_date:
        h = h.where(F.col("inv_date") <= F.lit(end_date).cast("date"))
    group = ["vendor_code", F.col("vendor").alias("vendor_name"), F.col("invoiced_currency").alias("currency")]
    names = ["vendor_code", "vendor_name", "currency"]
    amounts = {"total": F.col("total_invoiced_amount"), "outstanding": F.col("total_outstanding_amount"),
               "ratio": F.col("payment_ratio")}
    adv = F.col("is_advance_payment")
    facts = [F.max("inv_date").alias("last_invoice_date"), F.max(adv == 1).alias("_advance"),
             F.max(adv == 0).alias("_commercial")]
    if dedup == "value":
        # one row per invoice and per distinct amount: what a group holds is counted in one pass
        entries = F.array(_entry(None), *[_entry(name, c) for name, c in amounts.items()])
        rows = (h.select(*group, F.explode(entries).alias("_e"), F.when(F.col("_e.kind").isNull(), F.col("inv_date"))
                         .alias("inv_date"), F.when(F.col("_e.kind").isNull(), adv).alias("is_advance_payment"))
                .groupBy(*names, "_e.kind", "_e.pi_id", "_e.amount").agg(*facts))
        sums = {k: F.sum(F.when(F.col("kind") == k, F.col("amount"))) for k in amounts}
        counts = {k: F.count(F.when(F.col("kind") == k, F.col("amount"))) for k in amounts}
    elif dedup == "invoice":
        rows = h.groupBy(*group, "pi_id").agg(*facts, *[f(c).alias(f"{n}_{k}") for k, c in amounts.items()
                                                        for n, f in (("sum", F.sum), ("n", F.count))])
        sums = {k: F.sum(f"sum_{k}") for k in amounts}
        counts = {k: F.sum(f"n_{k}") for k in amounts}
    else:
        raise ValueError(dedup)
    average = lambda k: sums[k].cast("double") / counts[k].cast("double")
    return (rows.groupBy(*names)
            .agg(F.count("pi_id").alias("invoice_count"),
                 sums["total"].cast("decimal(18,2)").alias("total_amount"),
                 average("total").alias("avg_amount"),
                 F.max("last_invoice_date").alias("last_invoice_date"),
                 F.count_if("_advance").alias("advance_payment_count"),
                 F.count_if("_commercial").alias("commercial_invoice_count"),
                 sums["outstanding"].cast("decimal(18,2)").alias("total_outstanding"),
                 average("ratio").alias("avg_payment_ratio"))
            .orderBy(F.col("total_amount").desc()))


def _entry(kind: str | None, amount=None):
    """What one invoice adds to a group: itself (no kind), or a value of one of its amounts."""
    return F.struct(F.lit(kind).cast("string").alias("kind"),
                    (F.col("pi_id") if kind is None else F.lit(None).cast("long")).alias("pi_id"),
                    (F.lit(None) if amount is None else amount).cast("decimal(26,4)").alias("amount"))


def aging_report(t: Tables, as_of=None) -> DataFrame:
    """Invoices not fully paid, one row per invoice number, most overdue first.

    Several invoices may share a number; the one that sorts first by
    ``days_overdue`` DESC is kept (ties broken by the other columns).
    """
    h = _rename(invoice_header_view(t, as_of).where(F.col("payment_status") != "Fully Paid"),
                AGING_COLUMNS)
    return (first_per_key(h, ["invoice_number"], [F.col("days_overdue")])
            .orderBy(F.col("days_overdue").desc()))


# ---------------------------------------------------------------------------
# Dashboard
# ---------------------------------------------------------------------------

def _month_invoices(t: Tables, as_of):
    """Active invoices created in the month of ``as_of`` (half-open range on the
    raw column, so the bounds reach the Parquet scan as pushed filters; a table stored
    by month is read in that month's partition only)."""
    d = _date(as_of)
    start = F.trunc(d, "MM")
    pi = active(t.purchase_invoices).where(
        (F.col("created_date") >= start) & (F.col("created_date") < F.add_months(start, 1)))
    month, _ = MONTHLY["purchase_invoices"]
    if month in pi.columns:
        pi = pi.where(F.col(month) == month_number(d))
    today = (F.col("created_date") >= d) & (F.col("created_date") < F.date_add(d, 1))
    return pi, today


def _month_sets(t: Tables, as_of) -> DataFrame:
    """The month's invoices grouped by currency and by type, in one scan (GROUPING SETS).

    ``set`` is ``currency`` or ``type``; ``has_currency`` tells invoices of a known currency
    (the only ones that count by currency) from the rest, which count by type.
    """
    pi, today = _month_invoices(t, as_of)
    cur = dim(t.currencies.select(F.col("id").alias("currency_id"), F.col("code").alias("currency"),
                                  F.lit(True).alias("has_currency")))
    amount = F.col("total_invoiced_amount")
    rows = pi.join(cur, "currency_id", "left").select(
        "currency", "has_currency", _invoice_type().alias("invoice_type"), amount, today.alias("is_today"))
    return (rows.groupingSets([[F.col("currency"), F.col("has_currency")], [F.col("invoice_type")]],
                              "currency", "has_currency", "invoice_type")
            .agg(F.when(F.grouping("invoice_type") == 1, "currency").otherwise("type").alias("set"),
                 F.count(F.lit(1)).alias("month_count"),
                 F.coalesce(F.sum(amount), F.lit(0)).alias("month_total"),
                 F.count_if("is_today").alias("today_count"),
                 F.coalesce(F.sum(F.when(F.col("is_today"), amount)), F.lit(0)).alias("today_total"))
            .where((F.col("set") == "type") | F.col("has_currency")))


def _invoice_type():
    return F.when(F.col("invoice_number").like("%-A"), "Advance Payment").otherwise("Commercial Invoice")


def _by_currency(t: Tables, as_of) -> DataFrame:
    pi, today = _month_invoices(t, as_of)
    cur = dim(t.currencies.select(F.col("id").alias("currency_id"), F.col("code").alias("currency")))
    amount = F.col("total_invoiced_amount")
    return (pi.join(cur, "currency_id")
            .groupBy("currency")
            .agg(F.count(F.lit(1)).alias("month_count"),
                 F.coalesce(F.sum(amount), F.lit(0)).alias("month_total"),
                 F.count_if(today).alias("today_count"),
                 F.coalesce(F.sum(F.when(today, amount)), F.lit(0)).alias("today_total")))


def today_by_currency(t: Tables, as_of=None) -> DataFrame:
    """COUNT and total of invoices created on ``as_of``, per currency code."""
    return (_by_currency(t, as_of).where(F.col("today_count") > 0)
            .select("currency", F.col("today_count").alias("count"),
                    F.col("today_total").cast("decimal(18,2)").alias("total"))
            .orderBy(F.col("total").desc()))


def month_by_currency(t: Tables, as_of=None) -> DataFrame:
    """COUNT and total of invoices created in the month of ``as_of``, per currency."""
    return (_by_currency(t, as_of)
            .select("currency", F.col("month_count").alias("count"),
                    F.col("month_total").cast("decimal(18,2)").alias("total"))
            .orderBy(F.col("total").desc()))


def invoice_type_breakdown(t: Tables, as_of=None) -> DataFrame:
    """Invoices of the month by number suffix: ``-A`` advance, else commercial
    (no currency join, so invoices without a currency still count)."""
    pi, _ = _month_invoices(t, as_of)
    return pi.groupBy(_invoice_type().alias("invoice_type")).agg(F.count(F.lit(1)).alias("type_count"))


def dashboard(t: Tables, as_of=None) -> DataFrame:
    """All dashboard statistics as (section, label, count, total) rows.

    Sections: ``pending`` (arrival lines to invoice), ``today`` / ``month``
    per currency, ``type`` per invoice type, and ``today_top`` /
    ``month_top`` (total count, largest currency and its total; USD and 0
    when there is no invoice). The largest currency is the maximum of
    (total, code), so equal totals resolve to the greater code. All rows of the
    month come from one scan of its invoices.
    """
    money = "decimal(18,2)"
    row = lambda section, key, label, count, total: F.struct(
        F.lit(section).alias("section"), key.alias("key"), label.alias("label"),
        F.col(count).alias("count"), total.cast(money).alias("total"))
    none, code = F.lit(None).cast("string"), F.col("currency")
    today = F.array(row("today", code, code, "today_count", F.col("today_total")),
                    row("today_top", none, code, "today_count", F.col("today_total")))
    month = F.array(row("month", code, code, "month_count", F.col("month_total")),
                    row("month_top", none, code, "month_count", F.col("month_total")))
    kind = F.array(row("type", F.col("invoice_type"), F.col("invoice_type"), "month_count", F.lit(None)))
    shown = (F.when(F.col("set") == "type", kind)
             .when(F.col("today_count") > 0, F.concat(today, month)).otherwise(month))
    rows = _month_sets(t, as_of).select(F.explode(shown).alias("r")).select("r.*")
    # a row of its own keeps both tops when there is no invoice
    always = t.spark.range(1).select(F.explode(F.array(F.lit("today_top"), F.lit("month_top"))).alias("section"))
    rows = rows.unionByName(always, allowMissingColumns=True)
    largest = F.max(F.when(F.col("total").isNotNull(), F.struct("total", "label")))
    by_section = rows.groupBy("section", "key").agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("count"), largest.alias("_max")).select(
        "section", F.when(F.col("section").endswith("_top"), F.coalesce("_max.label", F.lit("USD")))
        .otherwise(F.col("key")).alias("label"), "count",
        F.when(F.col("section") != "type", F.coalesce("_max.total", F.lit(0))).cast(money).alias("total"))
    pending = pending_count(t, as_of).select(
        F.lit("pending").alias("section"), none.alias("label"), F.col("pending_count").alias("count"),
        F.lit(None).cast(money).alias("total"))
    return pending.unionByName(by_section)


def max_invoice_id(t: Tables) -> DataFrame:
    """MAX(id) over all invoices including deleted ones (0 when none)."""
    return t.purchase_invoices.agg(
        F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("max_id"))


def export_csv(report: DataFrame, path: str) -> None:
    """Writes a report as CSV files with a header each, quotes doubled (SNK5); fails if ``path`` exists.

    Files are in the order of the report's partitions. NULL is an empty field, an empty text is ``""``.
    """
    report.write.option("header", True).option("escape", '"').option("emptyValue", '""') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
