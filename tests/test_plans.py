"""Physical plans: one scan where one is enough, no shuffle where the layout has it, pruned months."""

import re

import pytest

from ledgerline.operators import details, reports, selections, worklist
from ledgerline.plans import queries as Q
from ledgerline.plans import views
from ledgerline.sources import layout

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # whole paths in the plans
    yield Q.tables(spark, SF)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture
def static(spark):
    """Plans as they are before run time, with shuffle joins as at scale."""
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, table: str) -> int:
    return len(re.findall(rf"FileScan parquet .*?{table}[\],]", plan(df)))


def test_the_worklist_scans_the_invoice_lines_once(t, static):
    for df in (worklist.uninvoiced_worklist(t), worklist.pending_count(t), worklist.uninvoiced_worklist(t, ordered=False)):
        assert scans(df, "purchase_invoice_details") == 1
        assert "ReusedExchange" in plan(df)


def test_filters_apply_before_the_aggregates(t, static):
    df = worklist.uninvoiced_worklist(t, Q.PARTY_FILTERS)
    assert scans(df, "purchase_orders") == 0 and scans(df, "purchase_invoice_details") == 1  # lines were written


def test_the_dashboard_reads_the_month_once(t, static):
    df = reports.dashboard(t)
    # the pending count reads the headers' flags, the month their amounts
    assert plan(df).count("total_invoiced_amount#") and len(
        re.findall(r"FileScan parquet \[[^\]]*total_invoiced_amount", plan(df))) == 1
    assert "Expand" in plan(df)


def test_recent_invoices_join_a_few_rows(t):
    df = reports.recent_invoices(t, 10)
    text = plan(df)
    assert "TakeOrdered" not in text  # chosen before, on keys
    pay = text[text.index("payment_date"):]
    assert "LeftSemi" in pay  # payments are reduced by the chosen ids before they are summed
    assert scans(df, "purchase_invoice_payments") == 1


def test_worklist_is_sorted_by_one_narrow_shuffle(t):
    text = plan(worklist.uninvoiced_worklist(t))
    assert text.count("rangepartitioning") == 1
    below = under(text, "rangepartitioning")
    assert "english_name" not in below and "estimated_invoice_value" not in below  # added after the shuffle


def test_vendor_summary_copies_no_invoice_per_distinct(t, static):  # F12
    text = plan(reports.vendor_summary(t))
    assert "Expand" not in text
    assert scans(reports.vendor_summary(t), "purchase_invoices") == 1  # the lines need no headers of their own


def test_aging_report_carries_each_row_once(t, static):  # F20
    df = reports.aging_report(t)
    assert scans(df, "purchase_invoices") == 1 and "max_by" not in plan(df)


def test_invoice_lines_join_headers_while_narrow(t, static):  # F14
    text = plan(reports.invoice_lines(t))
    assert text.count("rangepartitioning") == 1
    top = text.index("SortMergeJoin [arrival_detail_id")
    assert "SortMergeJoin [pi_id" not in text[:top]  # not moved by invoice again after the other joins
    below = under(text, "rangepartitioning")
    assert "Over 90 Days" not in below and "Fully Invoiced" not in below  # computed after the sort's shuffle


def test_pending_sketches_read_the_arrivals_once(t, static):  # F16
    assert scans(worklist.pending_sketches(t), "arrivals") <= scans(worklist.pending_count(t), "arrivals")


def test_invoice_details_are_sorted_by_one_narrow_shuffle(t, static):  # F18
    text = plan(details.invoice_details(t, t.arrival_details.select("id")))
    assert text.count("rangepartitioning") == 1
    assert "english_name" not in under(text, "rangepartitioning")


def test_selections_are_read_once(spark, t, tmp_path):
    sel = Q.sample_selections(t)
    sel.limit(500).write.parquet(f"{tmp_path}/picked")
    reads = spark.read.parquet(f"{tmp_path}/picked")
    verdicts, messages = selections.po_level_check(t, reads)
    assert scans(verdicts, "picked") == 0 and scans(messages, "picked") == 0  # both read what one pass wrote
    assert scans(selections.selection_check(reads), "picked") == 1
    assert scans(selections.selection_values(reads), "picked") == 1


def test_lists_as_rows_collect_nothing(t):
    sel = Q.sample_selections(t)
    for df in (selections.selection_check(sel, lists=False), selections.selection_value_rows(sel),
               selections.invoice_preview(sel, lists=False), selections.preview_notes(sel)):
        assert "collect_list" not in plan(df)


@pytest.fixture(scope="module")
def bucketed(t):
    return Q.layout_of(t)


def under(text: str, node: str) -> str:
    """The subtree of the first line that holds ``node``."""
    lines = text.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    at = next(i for i, line in enumerate(lines) if node in line)
    out = [lines[at]]
    for line in lines[at + 1:]:
        if line.strip() and depth(line) <= depth(lines[at]):
            break
        out.append(line)
    return "\n".join(out)


def test_bucketed_joins_have_no_exchange(bucketed, static):
    for df in (views.active_arrival_lines(bucketed), views.active_invoice_details(bucketed),
               bucketed.purchase_invoices.select("id", "invoice_number").join(
                   views.payment_totals(bucketed).withColumnRenamed("pi_id", "id"), "id", "left")):
        text = plan(df)
        assert "SortMergeJoin" in text and "Exchange" not in text, text
    # in the whole worklist the two joins keep it: nothing moves below them
    text = plan(worklist.uninvoiced_worklist(bucketed))
    assert "Exchange" not in under(text, "SortMergeJoin [arrival_id")
    assert "Exchange" not in under(text, "SortMergeJoin [purchase_invoice_id")
    assert "Bucketed: true" in text


def test_the_month_is_a_partition_filter(bucketed, t):
    text = plan(reports.month_by_currency(bucketed))
    assert re.search(r"PartitionFilters: \[[^\]]*created_month#\d+ = 200107", text), text
    assert "PartitionFilters: []" in plan(reports.month_by_currency(t))


def test_bucket_count_follows_the_size(t):
    assert layout.bucket_count(t) == 8
    assert layout.bucket_count(t, bucket_bytes=1 << 10) > 64
