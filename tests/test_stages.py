"""Large tables are worked on in stages: the same rows, and a disk that holds one stage's shuffles."""

import glob
import time

import pytest
from pyspark.sql import functions as F

from ledgerline import session
from ledgerline.operators import appends, details, invoicing, reports, selections, worklist
from ledgerline.plans import queries as Q
from ledgerline.plans import views
from ledgerline.sources import layout
from ledgerline.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def shuffle_files(spark) -> set:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


@pytest.fixture(scope="module")
def t(spark):
    """The stand-in tables, with some PO-line keys that two rows share (of two orders, one without an id)."""
    t = Q.tables(spark, SF)
    ppo = t.product_purchase_orders
    again = ppo.where(F.col("id") % 7 == 0).withColumn(
        "purchase_order_id", F.when(F.col("id") % 2 == 0, F.col("purchase_order_id") + 1))
    return Tables(spark, {**{n: t.table(n) for n in t._frames}, "product_purchase_orders": ppo.union(again)})


@pytest.fixture
def staged(monkeypatch):
    monkeypatch.setattr(views, "STAGED_BYTES", 0)
    monkeypatch.setattr(views, "PART_BYTES", 4000)


def test_a_written_table_leaves_no_shuffles(spark):  # F1
    before = shuffle_files(spark)
    df = session.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "released")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert df.count() == 7 and spark.conf.get(session._CLEANUP, "false") == "false"


def test_only_written_tables_are_discarded(spark, tmp_path):
    df = session.written([spark.range(5), spark.range(5, 9)], "parts")
    folder = f"{session.run_folder(spark)}/parts-*"
    assert df.count() == 9 and glob.glob(folder)
    session.discard(df)
    assert not glob.glob(folder)
    spark.range(1).write.parquet(f"{tmp_path}/own")
    with pytest.raises(ValueError):
        session.discard(spark.read.parquet(f"{tmp_path}/own"))


def test_the_worklist_in_stages_has_the_same_rows(spark, t, monkeypatch):  # F9, F10
    whole = rows(worklist.uninvoiced_worklist(t))
    monkeypatch.setattr(views, "STAGED_BYTES", 0)
    monkeypatch.setattr(views, "PART_BYTES", 4000)
    df = worklist.uninvoiced_worklist(t)
    below = df._jdf.queryExecution().optimizedPlan().toString()
    assert "purchase_unit_cost" in below and "arrival_id" not in below  # the lines were written
    assert rows(df) == whole
    dates = [(r["arrival_date"], r["arrival_note_number"]) for r in df.collect()]
    assert dates == sorted(dates, reverse=True)


def test_selections_need_no_second_join(spark, t, staged, monkeypatch):  # F1 to F8
    with Q._build_selections(t) as parts:
        assert len(parts) > 1
        now = sorted(r for p in parts for r in rows(p))
    monkeypatch.setattr(views, "STAGED_BYTES", 1 << 40)
    with Q._build_selections(t) as parts:
        assert len(parts) == 1 and rows(parts[0]) == now
    # what the selections are: a line for each order of its PO-line key, and for its month
    w = worklist.uninvoiced_worklist(t, ordered=False).select("can_line_id", "arrival_date", *Q.SELECTION_COLUMNS)
    ppo = t.product_purchase_orders.select(F.col("id").alias("product_purchase_order_id"), "purchase_order_id")
    month = (F.lit(10 ** 12) + F.year("arrival_date") * 100 + F.month("arrival_date")).cast("long")
    named = [F.col("can_line_id").alias("line_no"), *Q.SELECTION_COLUMNS]
    assert now == rows(w.join(ppo, "product_purchase_order_id").select(F.col("purchase_order_id").alias(
        "selection_id"), *named).union(w.select(month.alias("selection_id"), *named)))


def of(spark, name, fn, monkeypatch):
    """Rows of ``fn`` whole and in stages, and the files that it left."""
    whole = rows(fn())
    monkeypatch.setattr(views, "STAGED_BYTES", 0)
    monkeypatch.setattr(views, "PART_BYTES", 4000)
    before = set(glob.glob(f"{session.run_folder(spark)}/{name}-*"))
    df = fn()
    return whole, rows(df), df, set(glob.glob(f"{session.run_folder(spark)}/{name}-*")) - before


def test_invoice_lines_in_stages_have_the_same_rows(spark, t, monkeypatch):  # F11
    whole, now, df, left = of(spark, "stage", lambda: reports.invoice_lines(t), monkeypatch)
    assert whole == now and len(left) == 1  # spent stages were deleted
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1  # products at most, after the sort's shuffle


def test_invoice_details_in_stages_have_the_same_rows(spark, t, monkeypatch):  # F17
    ids = t.arrival_details.where(F.col("id") % 3 > 0).select("id")
    whole, now, df, left = of(spark, "stage", lambda: details.invoice_details(t, ids), monkeypatch)
    assert whole == now and len(left) == 1
    assert "arrival_id" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_new_invoices_in_stages_have_the_same_rows(spark, monkeypatch):  # F3, F7, F15
    t = Q.tables(spark, SF)  # a line with two PO lines could take its invoice's header from either
    lines = t.arrival_details.where(F.col("id") % 5 < 2).select(
        (F.col("product_purchase_order_id") % 90).alias("selection_id"), F.col("id").alias("can_line_id"))
    asked = spark.range(90).select(F.col("id").alias("selection_id"), F.lit("USD").alias("invoice_currency"),
                                   (F.col("id") % 2 == 0).alias("advance_payment"))
    for k in (0, 1):
        whole, now, _, left = of(spark, "stage", lambda: invoicing.build_invoices(
            t, lines.union(lines), asked, Q.AS_OF, "k0")[k], monkeypatch)
        assert whole and whole == now and len(left) == 1  # the details' last stage; others were deleted
        monkeypatch.setattr(views, "STAGED_BYTES", 1 << 40)


def test_a_preview_is_summed_after_one_shuffle(spark, t):  # F8
    sums = selections._by_note(Q.sample_selections(t), by_line=True).groupBy(
        "selection_id", *selections.PREVIEW_KEYS).count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = sums._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("Exchange hashpartitioning") == 1


def test_the_layout_is_packed(spark, t, tmp_path):  # F9
    layout.write_layout(t, str(tmp_path), 8)
    for name in ("arrival_details", "purchase_orders", "companies"):
        files = [f for f in glob.glob(f"{tmp_path}/{name}/**/*.parquet", recursive=True)]
        assert files and all(".zstd." in f for f in files)


def test_a_staged_batch_leaves_no_shuffles(spark, tmp_path):  # F3
    spark.range(5).withColumn("n", F.col("id")).write.parquet(f"{tmp_path}/kept")
    before = shuffle_files(spark)
    new = spark.range(700).groupBy((10 + F.col("id") % 7).alias("id")).agg(F.count("id").alias("n"))
    appends.stage(new, f"{tmp_path}/_batches/b/kept")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    for added in (7, 0):
        assert appends.append_batch(str(tmp_path), {"kept": new}, "b") == {"kept": added}
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 12
