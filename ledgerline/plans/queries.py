"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query maps the test tables of ``sf_dir`` to the domain tables
(:mod:`ledgerline.sources.standin`) and runs one job over all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ledgerline.operators import worklist
from ledgerline.session import run_folder, written
from ledgerline.sources.tables import Tables

_tables: dict[tuple, Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        _tables[key] = Tables.from_testdata(spark, sf_dir)
    return _tables[key]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return register


@query("uninvoiced_worklist")
def q_uninvoiced_worklist(t: Tables) -> DataFrame:
    """FIL1: arrival lines with uninvoiced quantity, ordered by arrival date."""
    return worklist.uninvoiced_worklist(t)


# ---------------------------------------------------------------------------
# worklist, facets, look-ups
# ---------------------------------------------------------------------------
from pyspark.sql import functions as F  # noqa: E402

from ledgerline.operators import details, rates, reports, terms  # noqa: E402
from ledgerline.operators.joins import active, dim  # noqa: E402

# A filter set of the kind the worklist page sends (FIL2).
SAMPLE_FILTERS = {
    "vendor_types": ["External"],
    "creators": ["user1", "user2", "user3", "user4"],
    "arrival_date_from": "1996-01-01",
    "arrival_date_to": "1999-12-31",
    "created_date_from": "1996-06-01",
}


@query("uninvoiced_worklist_filtered")
def q_worklist_filtered(t: Tables) -> DataFrame:
    """FIL2: the worklist under an AND of optional list and date-range filters."""
    return worklist.uninvoiced_worklist(t, SAMPLE_FILTERS)


# The other filters (FIL2): lists of parties and brands, and numbers.
PARTY_FILTERS = {
    "vendors": ["S00000", "S00001", "S00002"],
    "entities": ["B1000000", "B1000002", "B1000004"],
    "brands": ["Brand#2", "Brand#13", "Brand#19", "Brand#25"],
    "created_date_to": "2000-06-30",
}
PO_NUMBERS = [f"PO{n:08d}" for n in range(1, 1001)]


@query("uninvoiced_worklist_by_party")
def q_worklist_by_party(t: Tables) -> DataFrame:
    """FIL2: the worklist of some vendors, entities and brands up to a creation date."""
    return worklist.uninvoiced_worklist(t, PARTY_FILTERS)


@query("uninvoiced_worklist_by_number")
def q_worklist_by_number(t: Tables) -> DataFrame:
    """FIL2: the worklist of a list of PO numbers and a table of arrival note numbers."""
    notes = t.arrivals.where(F.col("id") % 3 == 0).select("arrival_note_number")
    return worklist.uninvoiced_worklist(t, {"an_numbers": notes, "po_numbers": PO_NUMBERS})


@query("filter_options")
def q_filter_options(t: Tables) -> DataFrame:
    """SET1: distinct facet values of the worklist as (facet, code, label)."""
    return worklist.filter_options(t)


@query("pending_count")
def q_pending_count(t: Tables) -> DataFrame:
    """AGG3: COUNT(DISTINCT) arrival lines still to invoice."""
    return worklist.pending_count(t)


@query("invoice_details")
def q_invoice_details(t: Tables) -> DataFrame:
    """JOI3: invoice-building details for every arrival line on the worklist."""
    ids = worklist.uninvoiced_worklist(t, ordered=False).select("can_line_id")
    return details.invoice_details(t, ids)


@query("po_line_summary")
def q_po_line_summary(t: Tables) -> DataFrame:
    """JOI6/AGG1/AGG2: legacy, new and remaining quantity of every worklist PO line."""
    ids = worklist.uninvoiced_worklist(t, ordered=False).select("product_purchase_order_id")
    return details.po_line_summary(t, ids)


# ---------------------------------------------------------------------------
# reports
# ---------------------------------------------------------------------------

@query("recent_invoices")
def q_recent_invoices(t: Tables) -> DataFrame:
    """SRT2: the 100 newest invoices."""
    return reports.recent_invoices(t, 100)


@query("invoice_by_id")
def q_invoice_by_id(t: Tables) -> DataFrame:
    """FIL9: invoice records for every invoice that has an active attachment link."""
    ids = active(t.purchase_invoice_medias).select("purchase_invoice_id")
    return reports.invoices_by_id(t, ids)


@query("invoice_lines")
def q_invoice_lines(t: Tables) -> DataFrame:
    """FIL10: line items of all invoices."""
    return reports.invoice_lines(t)


@query("vendor_summary")
def q_vendor_summary(t: Tables) -> DataFrame:
    """AGG8: per vendor and currency, with SUM/AVG DISTINCT amounts."""
    return reports.vendor_summary(t)


@query("vendor_summary_by_invoice")
def q_vendor_summary_by_invoice(t: Tables) -> DataFrame:
    """AGG8 variant: each invoice counted once, inside an invoice-date range (FIL6)."""
    return reports.vendor_summary(t, "1996-01-01", "2000-12-31", dedup="invoice")


@query("aging_report")
def q_aging_report(t: Tables) -> DataFrame:
    """SRT3/FIL7/WIN2: open invoices, one per number, most overdue first."""
    return reports.aging_report(t)


@query("today_by_currency")
def q_today(t: Tables) -> DataFrame:
    """AGG4: invoices created on the as-of date per currency."""
    return reports.today_by_currency(t)


@query("month_by_currency")
def q_month(t: Tables) -> DataFrame:
    """AGG5: invoices created in the as-of month per currency."""
    return reports.month_by_currency(t)


@query("invoice_type_breakdown")
def q_types(t: Tables) -> DataFrame:
    """AGG6: invoices of the month by number suffix."""
    return reports.invoice_type_breakdown(t)


@query("dashboard")
def q_dashboard(t: Tables) -> DataFrame:
    """DOM15/AGG7: all dashboard statistics in one long table."""
    return reports.dashboard(t)


@query("max_invoice_id")
def q_max_invoice_id(t: Tables) -> DataFrame:
    """AGG14: highest invoice id, deleted rows included."""
    return reports.max_invoice_id(t)


# ---------------------------------------------------------------------------
# payment terms and rates
# ---------------------------------------------------------------------------

@query("payment_terms")
def q_payment_terms(t: Tables) -> DataFrame:
    """SRT5/SCA12/SRC7: active terms with days, ordered by days and name."""
    return terms.payment_terms_list(t)


@query("invoice_due_dates")
def q_due_dates(t: Tables) -> DataFrame:
    """DOM1/SCA8-SCA13: due date, explanation and review flag of every invoice."""
    return terms.invoice_due_dates(t)


@query("latest_rates")
def q_latest_rates(t: Tables) -> DataFrame:
    """WIN3: latest active rate per currency pair."""
    return rates.latest_rates(t)


@query("invoice_exchange_rates")
def q_invoice_rates(t: Tables) -> DataFrame:
    """DOM4/DOM5/JOI10: USD and PO-to-invoice rates (inverse fallback) per invoice."""
    return rates.invoice_exchange_rates(t)


@query("currency_list")
def q_currency_list(t: Tables) -> DataFrame:
    """SRT4/FIL12: active currencies in display order."""
    return rates.currency_list(t)


# ---------------------------------------------------------------------------
# selections (stand-in user input: rows picked from the worklist)
# ---------------------------------------------------------------------------
from ledgerline.operators import selections  # noqa: E402

SELECTION_COLUMNS = [
    "vendor_code", "vendor_type", "legal_entity_code", "po_number", "arrival_note_number",
    "payment_term", "pt_code", "product_name", "product_purchase_order_id", "buying_unit_cost",
    "uninvoiced_quantity", "true_remaining_qty", "vat_percent", "po_line_is_over_delivered",
    "po_line_is_over_invoiced", "has_legacy_invoices",
]


def sample_selections(t: Tables) -> DataFrame:
    """Stand-in selection input, built once per table set (see :func:`_build_selections`)."""
    return t.derived("sample_selections", _build_selections)


@contextmanager
def _build_selections(t: Tables):
    """Two kinds of selections over the whole worklist: every purchase order's
    pending lines (clean candidates), and every arrival month's lines (mixed
    vendors, entities and terms). ``line_no`` is the arrival-line id."""
    own = F.array(F.struct("purchase_order_id"))
    month = (F.lit(10 ** 12) + F.year("arrival_date") * 100 + F.month("arrival_date")).cast("long")
    # a line is in the selections of its PO line's orders and in that of its month
    picked = F.concat(F.coalesce(worklist.ORDERS_OF_KEY, own), F.array(F.struct(month.alias("purchase_order_id"))))
    with worklist.worklist_parts(t) as parts:
        yield [w.select(F.explode(picked).alias("_s"), F.col("can_line_id").alias("line_no"), *SELECTION_COLUMNS)
               .select(F.col("_s.purchase_order_id").alias("selection_id"), "line_no", *SELECTION_COLUMNS) for w in parts]


def _requests(t: Tables) -> DataFrame:
    """Stand-in selection requests: every purchase order, pending lines or not, and every month."""
    orders = t.purchase_orders.select(F.col("id").alias("selection_id"))
    return orders.union(sample_selections(t).select("selection_id"))


@query("selection_check")
def q_selection_check(t: Tables) -> DataFrame:
    """DOM2: one vendor / vendor type / entity per requested selection, empty ones included."""
    return selections.selection_check(sample_selections(t), _requests(t))


@query("po_level_check")
def q_po_level_check(t: Tables) -> DataFrame:
    """DOM3: PO-level verdict per requested selection, empty ones included."""
    return selections.po_level_check(t, sample_selections(t), _requests(t))[0]


@query("po_level_messages")
def q_po_level_messages(t: Tables) -> DataFrame:
    """DOM3: warning messages per selection, in order of appearance."""
    return selections.po_level_check(t, sample_selections(t))[1]


@query("selection_totals")
def q_selection_totals(t: Tables) -> DataFrame:
    """AGG9/AGG10: quantities, counts, value and VAT totals per selection."""
    return selections.selection_totals(sample_selections(t))


@query("invoice_preview")
def q_invoice_preview(t: Tables) -> DataFrame:
    """AGG11/WIN5: grouped preview lines with 1-based ids per selection."""
    return selections.invoice_preview(sample_selections(t))


@query("selection_amounts_usd")
def q_selection_amounts(t: Tables) -> DataFrame:
    """AGG12: selection totals converted to USD (NULL where no rate exists)."""
    sel = sample_selections(t)
    target = sel.select("selection_id").distinct().withColumn("invoice_currency", F.lit("USD"))
    return selections.amounts_in_currency(t, sel, target)


@query("selection_check_counts")
def q_selection_check_counts(t: Tables) -> DataFrame:
    """DOM2: the basic check with the number of vendors or entities instead of their list."""
    return selections.selection_check(sample_selections(t), lists=False)


@query("selection_values")
def q_selection_values(t: Tables) -> DataFrame:
    """DOM2/DOM3/SET3: vendors, types, entities, terms and VAT rates of each selection as numbered rows."""
    return selections.selection_value_rows(sample_selections(t))


@query("preview_notes")
def q_preview_notes(t: Tables) -> DataFrame:
    """SET3/AGG11: the arrival notes of each preview line as numbered rows."""
    return selections.preview_notes(sample_selections(t))


@query("preview_counts")
def q_preview_counts(t: Tables) -> DataFrame:
    """AGG11: preview lines with the number of their arrival notes instead of the list."""
    return selections.invoice_preview(sample_selections(t), lists=False)


# ---------------------------------------------------------------------------
# attachments and object listings
# ---------------------------------------------------------------------------
from ledgerline.functions.files import INVOICE_FILE_PREFIX  # noqa: E402
from ledgerline.operators import attachments  # noqa: E402

UPLOAD_BASE_MS = 1_700_000_000_000


def _upload_times(t: Tables) -> DataFrame:
    """Stand-in upload time per batch."""
    return t.file_manifest.select("batch_id").distinct().withColumn(
        "base_ms", F.lit(UPLOAD_BASE_MS) + F.col("batch_id") * 100_000)


@query("file_manifest_check")
def q_manifest_files(t: Tables) -> DataFrame:
    """DOM12/WIN6/SCA18/SCA19: per-file upload checks with all errors listed."""
    return attachments.manifest_check(t.file_manifest)[0]


@query("file_batch_verdicts")
def q_manifest_batches(t: Tables) -> DataFrame:
    """DOM12: per-batch verdict (too many files, file errors)."""
    return attachments.manifest_check(t.file_manifest)[1]


@query("upload_summary")
def q_upload_summary(t: Tables) -> DataFrame:
    """AGG16/SCA17: count, bytes, size text and types of the accepted files per batch."""
    return attachments.file_summary(attachments.manifest_check(t.file_manifest)[0])


@query("prepared_files")
def q_prepared_files(t: Tables) -> DataFrame:
    """DOM13/SCA20/SCA21/WIN7: sanitised names, unique keys and content types."""
    return attachments.prepare_files(t.file_manifest, _upload_times(t))


@query("new_media_rows")
def q_new_media_rows(t: Tables) -> DataFrame:
    """SNK2/WIN4: media rows (ids after the current maximum) for accepted files' keys."""
    ok = attachments.manifest_check(t.file_manifest)[0].where("is_ok").select("batch_id", "idx")
    keys = attachments.prepare_files(t.file_manifest, _upload_times(t)) \
        .join(ok, ["batch_id", "idx"], "left_semi")
    return attachments.new_media_rows(t, keys, "k0", "2001-07-31 12:00:00")


@query("invoice_attachments")
def q_invoice_attachments(t: Tables) -> DataFrame:
    """JOI8/SCA22/SRT9: active attachments with uploader names, newest first."""
    return attachments.invoice_attachments(t)


@query("object_listing")
def q_object_listing(t: Tables) -> DataFrame:
    """SRC2/SCA24: all keys under the invoice prefix, markers skipped."""
    return attachments.list_files(t.object_listing, INVOICE_FILE_PREFIX)


@query("folder_listing")
def q_folder_listing(t: Tables) -> DataFrame:
    """SRC3: sub-folders of the invoice prefix."""
    return attachments.list_folders(t.object_listing, INVOICE_FILE_PREFIX)


@query("folder_sizes")
def q_folder_sizes(t: Tables) -> DataFrame:
    """AGG15: bytes and object count per top-level folder."""
    return attachments.folder_sizes(t.object_listing, 1)


@query("invoice_file_keys")
def q_invoice_file_keys(t: Tables) -> DataFrame:
    """FIL11: keys under the invoice prefix vs the rest."""
    return attachments.invoice_file_keys(t.object_listing)


@query("orphan_objects")
def q_orphans(t: Tables) -> DataFrame:
    """DOM16: stored invoice files with no media row."""
    return attachments.orphan_objects(t)


# ---------------------------------------------------------------------------
# building invoices
# ---------------------------------------------------------------------------
import datetime as _dt  # noqa: E402

from ledgerline.operators import invoicing  # noqa: E402

AS_OF = _dt.date(2001, 7, 31)


def _build(t: Tables, lines_too: bool = True):
    """Invoice requests: every selection that passes the basic check; invoice
    currency = PO currency, or USD for every fourth selection."""
    sel = sample_selections(t)
    # a row per valid selection, read by the requests and by the lines
    ok = written(selections.selection_check(sel, lists=False).where("is_valid").select("selection_id"), "valid")
    first_cur = sel.groupBy("selection_id").agg(
        F.min_by(F.substring_index("buying_unit_cost", " ", -1), "line_no").alias("po_cur"))
    requests = ok.join(first_cur, "selection_id").select(
        "selection_id",
        F.when(F.col("selection_id") % 4 == 0, F.lit("USD")).otherwise(F.col("po_cur"))
        .alias("invoice_currency"),
        (F.col("selection_id") % 6 == 0).alias("advance_payment"))
    lines = sel.join(ok, "selection_id", "left_semi") \
        .select("selection_id", F.col("line_no").alias("can_line_id"))
    return invoicing.build_invoices(t, lines, requests, AS_OF, "k0", lines_too)


@query("new_invoice_headers")
def q_new_headers(t: Tables) -> DataFrame:
    """DOM6/AGG13/SCA7/SCA14/WIN4/DOM4: invoice headers built from valid selections."""
    return _build(t, lines_too=False)[0]


@query("new_invoice_lines")
def q_new_lines(t: Tables) -> DataFrame:
    """DOM6/JOI7: invoice lines (converted, VAT from the PO line) of the new invoices."""
    return _build(t)[1]


# ---------------------------------------------------------------------------
# mutations (stand-in requests derived from the tables)
# ---------------------------------------------------------------------------
from ledgerline.operators import mutations  # noqa: E402


def _update_requests(t: Tables) -> DataFrame:
    """Set a commercial number where it is missing and push the due date a week."""
    pi = t.purchase_invoices.where(F.col("commercial_invoice_no").isNull())
    return pi.select(
        F.col("id").alias("invoice_id"),
        F.lit(True).alias("has_commercial_invoice_no"),
        F.concat(F.lit("CI-"), F.col("id").cast("string"), F.lit("-R")).alias("commercial_invoice_no"),
        F.lit(False).alias("has_invoiced_date"), F.lit(None).cast("date").alias("invoiced_date"),
        F.lit(True).alias("has_due_date"), F.date_add("due_date", 7).alias("due_date"),
        F.lit(False).alias("has_email_to_accountant"),
        F.lit(None).cast("int").alias("email_to_accountant"),
        F.lit(False).alias("has_modified_date"),
        F.lit(None).cast("timestamp").alias("modified_date"))


def _old_invoice_ids(t: Tables) -> DataFrame:
    return t.purchase_invoices.where(F.col("invoiced_date") < F.lit("1995-03-01").cast("date")) \
        .select("id")


@query("updated_invoices")
def q_updated(t: Tables) -> DataFrame:
    """DOM7: invoice table snapshot after header updates."""
    return mutations.update_invoices(t, _update_requests(t), AS_OF)[0]


@query("update_report")
def q_update_report(t: Tables) -> DataFrame:
    """DOM7: per-request update outcome."""
    return mutations.update_invoices(t, _update_requests(t), AS_OF)[1]


@query("voided_invoices")
def q_voided(t: Tables) -> DataFrame:
    """DOM8: invoice table snapshot after voiding early-1995 invoices."""
    return mutations.void_invoices(t, _old_invoice_ids(t), AS_OF)[0]


@query("purge_report")
def q_purge(t: Tables) -> DataFrame:
    """DOM9/JOI11/AGG17: hard-delete outcome (refused while active lines exist)."""
    return mutations.purge_invoices(t, _old_invoice_ids(t))[1]


@query("edit_check")
def q_edit_check(t: Tables) -> DataFrame:
    """DOM10: edit validation for every invoice (shifted dates)."""
    pi = t.purchase_invoices
    edits = pi.select(F.col("id").alias("invoice_id"),
                      F.date_add("invoiced_date", (F.col("id") % 3).cast("int")).alias("invoiced_date"),
                      F.date_add("invoiced_date", (F.col("id") % 40 - 10).cast("int")).alias("due_date"))
    return mutations.edit_check(t, edits, AS_OF)


@query("removed_attachment_links")
def q_removed_links(t: Tables) -> DataFrame:
    """DOM11: attachment-link snapshot after removing links to every fifth media."""
    ids = t.purchase_invoice_medias.where(F.col("media_id") % 5 == 0).select("id")
    return mutations.remove_attachment_links(t, ids, AS_OF)[0]


@query("void_report")
def q_void_report(t: Tables) -> DataFrame:
    """DOM8: outcome per requested id, with ids that don't exist."""
    ids = _old_invoice_ids(t)
    return mutations.void_invoices(t, ids.union(ids.select(-F.col("id") - 1)).union(ids), AS_OF)[1]


@query("purged_invoices")
def q_purged(t: Tables) -> DataFrame:
    """DOM9: invoice table snapshot after the hard delete."""
    return mutations.purge_invoices(t, _old_invoice_ids(t))[0]


@query("link_removal_report")
def q_link_removal_report(t: Tables) -> DataFrame:
    """DOM11: outcome per requested link id, with repeated and unknown ids."""
    ids = t.purchase_invoice_medias.where(F.col("media_id") % 5 == 0).select("id")
    return mutations.remove_attachment_links(t, ids.union(ids).union(ids.select(-F.col("id") - 1)), AS_OF)[1]


@query("superseded_updates")
def q_superseded(t: Tables) -> DataFrame:
    """DOM7: the invoice snapshot when every update request comes twice, the later one changed."""
    first = _update_requests(t).withColumn("request_no", F.lit(1))
    later = first.withColumns({"request_no": F.lit(2), "due_date": F.date_add("due_date", 1)})
    return mutations.update_invoices(t, later.union(first), AS_OF)[0]


@query("new_media_links")
def q_new_media_links(t: Tables) -> DataFrame:
    """SNK3/WIN4: link rows that attach every active media of an invoice to the next invoice too."""
    links = active(t.purchase_invoice_medias)
    requests = links.groupBy((F.col("purchase_invoice_id") + 1).alias("purchase_invoice_id")).agg(
        F.collect_list("media_id").alias("media_ids"))
    return invoicing.new_media_links(t, requests, "k0", "2001-07-31 12:00:00")


@query("invoice_term_days")
def q_invoice_term_days(t: Tables) -> DataFrame:
    """DOM14: term name, days and description of each invoice through the id map."""
    return terms.invoice_terms(t)


@query("rate_texts")
def q_rate_texts(t: Tables) -> DataFrame:
    """SCA16: display text of the latest rates, direct and inverted."""
    from ledgerline.functions.money import format_rate
    r = rates.latest_rates(t)
    inverse = F.when(F.col("rate_value") > 0, F.lit(1.0) / F.col("rate_value").cast("double"))
    return r.select("from_currency_code", "to_currency_code", format_rate("rate_value").alias("rate_text"),
                    format_rate(inverse).alias("inverse_text"))


@query("monthly_amount_texts")
def q_amount_texts(t: Tables) -> DataFrame:
    """SCA15: short text of each month's invoiced amount per currency id."""
    from ledgerline.functions.money import large_number
    m = active(t.purchase_invoices).groupBy(
        F.date_format("invoiced_date", "yyyy-MM").alias("month"), "currency_id").agg(
        F.sum("total_invoiced_amount").alias("amount"))
    codes = dim(t.currencies.select(F.col("id").alias("currency_id"), "code"))
    # a currency without a code has no label
    text = F.rtrim(large_number("amount", F.coalesce("code", F.lit(""))))
    return m.join(codes, "currency_id", "left").select("month", "currency_id", text.alias("amount_text"))


@query("attachment_icons")
def q_attachment_icons(t: Tables) -> DataFrame:
    """SCA23: the icon of each media file."""
    from ledgerline.functions.files import file_icon
    return t.medias.select("id", "name", file_icon(F.col("name")).alias("icon"))


def _raw_query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


@_raw_query("event_documents")
def q_event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5/SNK4: JSON documents of the events, parsed, with the key each would be stored under."""
    from ledgerline.sources import documents as D
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    doc = D.parse_json("props")
    return ev.select("event_id", F.try_variant_get(doc, "$.k", "long").alias("k"), D.template_key(
        F.col("event_type"), F.concat(F.lit("Event "), F.col("event_id").cast("string")), "app").alias("key"))


# ---------------------------------------------------------------------------
# stored forms: layout, repeated appends, month partitions, sketches, documents, listings
# ---------------------------------------------------------------------------
import uuid  # noqa: E402

from ledgerline.operators import appends, snapshots  # noqa: E402
from ledgerline.sources import layout  # noqa: E402

_layouts: dict[int, Tables] = {}


def layout_of(t: Tables) -> Tables:
    """The tables in the bucketed layout, written once for this set of tables."""
    if id(t) not in _layouts:
        root = f"{run_folder(t.spark)}/layout-{uuid.uuid4().hex}"
        _layouts[id(t)] = layout.layout_tables(t.spark, root, layout.write_layout(t, root))
    return _layouts[id(t)]


def _copy(t: Tables, *names: str) -> str:
    """Copies of tables in a folder of their own, to append to or to change."""
    root = f"{run_folder(t.spark)}/copy-{uuid.uuid4().hex}"
    for name in names:
        t.table(name).write.parquet(f"{root}/{name}")
    return root


@query("uninvoiced_worklist_on_layout")
def q_worklist_on_layout(t: Tables) -> DataFrame:
    """SRC1/FIL1: the worklist over the bucketed tables."""
    return worklist.uninvoiced_worklist(layout_of(t))


@query("month_by_currency_on_layout")
def q_month_on_layout(t: Tables) -> DataFrame:
    """SRC1/FIL8/AGG5: the month's invoices from their month partition."""
    return reports.month_by_currency(layout_of(t))


@query("replayed_invoice_lines")
def q_replayed_lines(t: Tables) -> DataFrame:
    """SNK1: stored lines of an invoice batch that was appended twice, with their header's number."""
    root = _copy(t, "purchase_invoices", "purchase_invoice_details")
    for _ in range(2):
        headers, lines = _build(t)
        invoicing.append_invoices(headers, lines, root, "b1")
    read = lambda name: appends.stored_table(t.spark, f"{root}/{name}").where("batch_id = 'b1'")
    heads = read("purchase_invoices").select(F.col("id").alias("purchase_invoice_id"), "invoice_number")
    return read("purchase_invoice_details").join(heads, "purchase_invoice_id").select(
        "id", "purchase_invoice_id", "invoice_number", "arrival_detail_id", "purchased_invoice_quantity", "batch_id")


@query("replayed_media_rows")
def q_replayed_media(t: Tables) -> DataFrame:
    """SNK2: the stored media table after a batch of new rows was appended twice."""
    root = _copy(t, "medias")
    for _ in range(2):
        attachments.append_media(q_new_media_rows(t), root, "b1")
    return appends.stored_table(t.spark, f"{root}/medias").select("id", "name", "path", "batch_id")


@query("replayed_media_links")
def q_replayed_links(t: Tables) -> DataFrame:
    """SNK3: the stored link table after a batch of new rows was appended twice."""
    root = _copy(t, "purchase_invoice_medias")
    for _ in range(2):
        invoicing.append_media_links(q_new_media_links(t), root, "b1")
    return appends.stored_table(t.spark, f"{root}/purchase_invoice_medias").select(
        "id", "purchase_invoice_id", "media_id", "delete_flag", "batch_id")


def _months_copy(t: Tables) -> str:
    path = f"{run_folder(t.spark)}/months-{uuid.uuid4().hex}"
    snapshots.write_by_month(t.purchase_invoices, path)
    return path


def _read_months(t: Tables, path: str) -> DataFrame:
    return snapshots.read_by_month(t.spark, path).drop(snapshots.MONTH)


@query("updated_invoices_by_month")
def q_updated_by_month(t: Tables) -> DataFrame:
    """DOM7: the stored table after updates that replaced the touched months only."""
    path = _months_copy(t)
    snapshots.update_in_place(t, path, _update_requests(t), AS_OF)
    return _read_months(t, path)


@query("voided_invoices_by_month")
def q_voided_by_month(t: Tables) -> DataFrame:
    """DOM8: the stored table after voids that replaced the touched months only."""
    path = _months_copy(t)
    snapshots.void_in_place(t, path, _old_invoice_ids(t), AS_OF)
    return _read_months(t, path)


@query("purged_invoices_by_month")
def q_purged_by_month(t: Tables) -> DataFrame:
    """DOM9: the stored table after a hard delete that replaced the touched months only."""
    path = _months_copy(t)
    snapshots.purge_in_place(t, path, _old_invoice_ids(t))
    return _read_months(t, path)


@query("pending_sketch_check")
def q_pending_sketches(t: Tables) -> DataFrame:
    """AGG3: exact pending counts per arrival month and of all months (NULL), and whether the
    estimate from the stored month sketches is within four standard errors of each."""
    sketches = written(worklist.pending_sketches(t), "sketches")
    estimate = F.hll_sketch_estimate("sketch").alias("estimate")
    estimates = sketches.select("arrival_month", estimate).unionByName(
        worklist.sketched_count(sketches).select(F.lit(None).cast("string").alias("arrival_month"),
                                                 F.col("pending_estimate").alias("estimate")))
    lines = worklist.uninvoiced_worklist(t, ordered=False).select(
        F.date_format("arrival_date", "yyyy-MM").alias("arrival_month"))
    exact = lines.rollup("arrival_month").agg(F.count(F.lit(1)).alias("pending_count"),
                                              F.grouping("arrival_month").alias("is_total"))
    exact = exact.where("is_total = 1 or arrival_month is not null")
    close = F.abs(F.col("estimate") - F.col("pending_count")) <= F.greatest(
        F.lit(1.0), 4 * worklist.sketch_error() * F.col("pending_count"))
    return exact.join(estimates.withColumnRenamed("arrival_month", "m"),
                      F.col("arrival_month").eqNullSafe(F.col("m")), "left").select(
        "arrival_month", "pending_count", F.coalesce(close, F.lit(False)).alias("estimate_is_close"))


@query("bad_cost_count")
def q_bad_costs(t: Tables) -> DataFrame:
    """SRC1/N2: worklist lines by what their cost text holds: a number, no text, or no number."""
    return worklist.cost_quality(worklist.uninvoiced_worklist(t, ordered=False))


@query("listing_changes")
def q_listing_changes(t: Tables) -> DataFrame:
    """SRC2: what changed between an earlier listing (stand-in: renamed and resized keys) and the present one."""
    now = t.object_listing
    earlier = now.select(
        F.when(F.col("size") % 7 == 0, F.concat("key", F.lit(".old"))).otherwise(F.col("key")).alias("key"),
        F.when(F.col("size") % 7 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        "last_modified", "etag")
    return attachments.listing_changes(earlier, now)


@_raw_query("stored_documents")
def q_stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5/SNK4: a summary document per event type and month, saved under its key (the first save
    is replaced by the second) and read back by key."""
    from ledgerline.sources import documents as D
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    docs = ev.groupBy(F.initcap("event_type").alias("customer_code"),
                      F.concat(F.lit("Month "), F.date_format("ts", "yyyy-MM")).alias("template_name")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    path = f"{run_folder(spark)}/documents-{uuid.uuid4().hex}"
    for n in (F.lit(0), F.col("n")):
        D.save_templates(docs.select("customer_code", "template_name",
                                     F.struct(n.alias("n"), "first").alias("template")), path)
    back = D.load_templates(spark, path, "app", docs.select("customer_code", "template_name"))
    return back.select("customer", "name", "key", F.try_variant_get("document", "$.n", "long").alias("n"),
                       F.try_variant_get("document", "$.first", "long").alias("first"))
