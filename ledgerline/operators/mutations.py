"""Updates, voids and deletions as new table snapshots.

Plain Parquet tables are never modified in place: each function returns the
table's next snapshot (to be written to a new path) plus a per-request
report. Requests are tables, so any number of them is applied in one job.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.joins import active
from ledgerline.plans.views import invoice_header_view
from ledgerline.sources.tables import Tables

# Fields an invoice update may change, and report messages.
UPDATABLE_FIELDS = ["commercial_invoice_no", "invoiced_date", "due_date",
                    "email_to_accountant", "modified_date"]
MSG_NO_FIELDS = "No valid fields to update"
MSG_NOT_FOUND = "Invoice not found or already deleted"
MSG_SUPERSEDED = "Superseded by a later request"  # ours: batches may hold several requests


def _ts(as_of) -> F.Column:
    if isinstance(as_of, _dt.date) and not isinstance(as_of, _dt.datetime):
        as_of = _dt.datetime.combine(as_of, _dt.time(12))
    return F.lit(as_of).cast("timestamp")


def update_invoices(t: Tables, updates: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Apply header updates to active invoices.

    ``updates``: invoice_id plus, per updatable field, ``has_<field>`` (the
    field was sent) and the new value (which may be NULL and then sets NULL).
    ``modified_date`` is set to ``as_of`` unless it was sent. Of several requests
    for one invoice the one with the largest ``request_no`` (a column; 0 when
    there is none) counts, ties broken by the new values; the report has every
    request, the others marked as superseded. Returns (new snapshot, report).
    """
    has = [F.coalesce(F.col(f"has_{f}"), F.lit(False)) for f in UPDATABLE_FIELDS]
    any_field = has[0]
    for h in has[1:]:
        any_field = any_field | h
    number = F.col("request_no") if "request_no" in updates.columns else F.lit(0)
    u = updates.select("invoice_id", any_field.alias("_any"), number.cast("long").alias("_no"),
                       *[F.col(f"has_{f}").alias(f"_has_{f}") for f in UPDATABLE_FIELDS],
                       *[F.col(f).alias(f"_new_{f}") for f in UPDATABLE_FIELDS])
    pi = t.purchase_invoices
    whole = F.struct("_no", *[c for c in u.columns if c.startswith(("_has_", "_new_"))])
    last = u.where("_any").groupBy("invoice_id").agg(
        F.max(whole).alias("_r"), F.max("_no").alias("_last")).select("invoice_id", "_last", "_r.*").drop("_no")
    j = pi.join(last, pi.id == last.invoice_id, "left")
    hit = F.col("invoice_id").isNotNull() & (F.col("delete_flag") == 0)
    new_cols = []
    for c in pi.columns:
        if c in UPDATABLE_FIELDS:
            v = F.when(hit & F.col(f"_has_{c}"), F.col(f"_new_{c}").cast(pi.schema[c].dataType))
            if c == "modified_date":
                v = v.when(hit, _ts(as_of).cast(pi.schema[c].dataType))
            new_cols.append(v.otherwise(F.col(c)).alias(c))
        else:
            new_cols.append(F.col(c))
    snapshot = j.select(*new_cols)
    found = active(pi).select(F.col("id").alias("invoice_id"), F.lit(True).alias("_found"))
    report = u.join(found, "invoice_id", "left").join(last.select("invoice_id", "_last"), "invoice_id", "left")
    older = F.coalesce(F.col("_no") < F.col("_last"), F.lit(False))
    report = report.select(
        "invoice_id",
        (F.col("_any") & F.col("_found").isNotNull() & ~older).alias("updated"),
        F.when(~F.col("_any"), F.lit(MSG_NO_FIELDS))
        .when(F.col("_found").isNull(), F.lit(MSG_NOT_FOUND))
        .when(older, F.lit(MSG_SUPERSEDED))
        .otherwise(F.lit("Invoice updated successfully")).alias("message"))
    return snapshot, report


def _soft_delete(table: DataFrame, ids: DataFrame, as_of, stamp_col: str,
                 done: str) -> tuple[DataFrame, DataFrame]:
    ids = ids.select(F.col(ids.columns[0]).alias("_rid")).distinct()
    j = table.join(ids, table.id == ids._rid, "left")
    hit = F.col("_rid").isNotNull() & (F.col("delete_flag") == 0)
    snapshot = j.select(*[
        (F.when(hit, F.lit(1)).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c)
         if c == "delete_flag" else
         F.when(hit, _ts(as_of).cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c)
         if c == stamp_col else F.col(c)) for c in table.columns])
    found = active(table).select(F.col("id").alias("_rid"), F.lit(True).alias("_found"))
    report = ids.join(found, "_rid", "left").select(
        F.col("_rid").alias("id"), F.col("_found").isNotNull().alias("done"),
        F.when(F.col("_found").isNotNull(), F.lit(done)).otherwise(F.lit(MSG_NOT_FOUND))
        .alias("message"))
    return snapshot, report


def void_invoices(t: Tables, ids: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Soft delete: delete_flag 1 and modified_date = ``as_of`` for active invoices in ``ids``."""
    return _soft_delete(t.purchase_invoices, ids, as_of, "modified_date",
                        "Invoice voided successfully")


def remove_attachment_links(t: Tables, link_ids: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Soft delete of attachment links."""
    snap, rep = _soft_delete(t.purchase_invoice_medias, link_ids, as_of, "modified_date",
                             "Attachment removed successfully")
    return snap, rep.withColumn("message", F.when(F.col("done"), F.col("message"))
                                .otherwise(F.lit("Attachment not found or already deleted")))


def purge_invoices(t: Tables, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hard delete of invoices that have no active line (others are refused).

    The line count per requested invoice is an aggregate joined back; the
    snapshot is the table anti-joined with the deletable ids.
    """
    ids = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    lines = (active(t.purchase_invoice_details).join(
        ids.withColumnRenamed("id", "purchase_invoice_id"), "purchase_invoice_id", "left_semi")
        .groupBy(F.col("purchase_invoice_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("detail_count")))
    exists = t.purchase_invoices.select("id", F.lit(True).alias("_exists"))
    r = ids.join(lines, "id", "left").join(exists, "id", "left")
    n = F.coalesce(F.col("detail_count"), F.lit(0))
    report = r.select(
        "id", n.alias("detail_count"),
        ((n == 0) & F.col("_exists").isNotNull()).alias("deleted"),
        F.when(n > 0, F.lit("Cannot delete invoice with line items. Void it instead."))
        .when(F.col("_exists").isNull(), F.lit(MSG_NOT_FOUND))
        .otherwise(F.lit("Invoice deleted successfully")).alias("message"))
    gone = report.where("deleted").select("id")
    return t.purchase_invoices.join(gone, "id", "left_anti"), report


def edit_check(t: Tables, edits: DataFrame, as_of) -> DataFrame:
    """Validate edits (invoice_id, invoiced_date, due_date; NULL = not sent):
    invoice exists; new date not after ``as_of``; due date not before the new
    (or stored) invoice date; invoice not fully paid. First failure wins."""
    asked = edits.select(F.col("invoice_id").alias("pi_id")).distinct()
    inv = invoice_header_view(t, as_of, asked).select(
        F.col("pi_id").alias("invoice_id"), F.col("inv_date").alias("_stored_date"),
        "payment_status", F.lit(True).alias("_found"))
    j = edits.join(inv, "invoice_id", "left")
    new_date, due = F.col("invoiced_date"), F.col("due_date")
    msg = (F.when(F.col("_found").isNull(), F.lit("Invoice not found"))
           .when(new_date.isNotNull() & (new_date > F.lit(as_of).cast("date")),
                 F.lit("Invoice date cannot be in the future"))
           .when(due.isNotNull() & (due < F.coalesce(new_date, F.col("_stored_date"))),
                 F.lit("Due date cannot be before invoice date"))
           .when(F.col("payment_status") == "Fully Paid", F.lit("Cannot edit fully paid invoice")))
    return j.select("invoice_id", msg.isNull().alias("is_valid"),
                    F.coalesce(msg, F.lit("Validation passed")).alias("message"))
