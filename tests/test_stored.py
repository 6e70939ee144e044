"""Stored forms: repeated and interrupted appends, month partitions, layout, documents, listings."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import appends, attachments, invoicing, mutations, snapshots
from ledgerline.plans import queries as Q
from ledgerline.session import clean_run, run_folder, written
from ledgerline.sources import documents as D
from ledgerline.sources import layout

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Q.tables(spark, SF)


def batch(spark, first, n=4):
    heads = spark.createDataFrame([(first + i, f"N{first + i}", 5) for i in range(n)],
                                  "id long, invoice_number string, selection_id long")
    lines = spark.createDataFrame([(10 * first + i, first + i // 2) for i in range(2 * n)],
                                  "id long, purchase_invoice_id long")
    return heads, lines


@pytest.fixture
def root(spark, tmp_path):
    heads, lines = batch(spark, 1)
    heads.drop("selection_id").withColumn("note", F.lit("old")).write.parquet(f"{tmp_path}/purchase_invoices")
    lines.write.parquet(f"{tmp_path}/purchase_invoice_details")
    return str(tmp_path)


def content(spark, root):
    return [sorted(map(str, appends.stored_table(spark, f"{root}/{n}").collect()))
            for n in ("purchase_invoices", "purchase_invoice_details")]


def test_a_repeated_append_adds_nothing(spark, root):
    heads, lines = batch(spark, 100)
    assert invoicing.append_invoices(heads, lines, root, "b") == {"purchase_invoices": 4, "purchase_invoice_details": 8}
    once = content(spark, root)
    assert len(once[0]) == 8 and len(once[1]) == 16
    assert invoicing.append_invoices(heads, lines, root, "b") == {"purchase_invoices": 0, "purchase_invoice_details": 0}
    # ids that were built again, after the maximum moved, are not used: the staged rows are
    assert invoicing.append_invoices(*batch(spark, 104), root, "b")["purchase_invoices"] == 0
    assert content(spark, root) == once
    assert invoicing.append_invoices(*batch(spark, 104), root, "c")["purchase_invoices"] == 4


@pytest.mark.parametrize("cut", ["before lines", "inside headers", "inside lines"])
def test_a_cut_append_is_completed(spark, root, tmp_path, monkeypatch, cut):
    heads, lines = batch(spark, 100)
    whole = str(tmp_path / "whole")
    for n in ("purchase_invoices", "purchase_invoice_details"):
        spark.read.parquet(f"{root}/{n}").write.parquet(f"{whole}/{n}")
    invoicing.append_invoices(heads, lines, whole, "b")
    want = content(spark, whole)

    real, calls = appends.fitted, []

    def failing(rows, table, batch_id):
        calls.append(1)
        if cut == "before lines" and len(calls) == 2:
            raise OSError("cut")
        if (cut == "inside headers" and len(calls) == 1) or (cut == "inside lines" and len(calls) == 2):
            real(rows.where("id % 2 = 0"), table, batch_id).write.mode("append").parquet(
                f"{root}/{'purchase_invoices' if cut == 'inside headers' else 'purchase_invoice_details'}")
            raise OSError("cut")
        return real(rows, table, batch_id)

    monkeypatch.setattr(appends, "fitted", failing)
    with pytest.raises(OSError):
        invoicing.append_invoices(heads, lines, root, "b")
    monkeypatch.setattr(appends, "fitted", real)
    state = appends.incomplete_batches(spark, root, "b", ["purchase_invoices", "purchase_invoice_details"]).collect()
    assert any(r["staged"] != r["stored"] for r in state)
    if cut == "before lines":
        assert appends.orphan_lines(spark, root).count() == 4
    invoicing.append_invoices(heads, lines, root, "b")
    assert content(spark, root) == want and appends.orphan_lines(spark, root).count() == 0


def test_ids_of_another_batch_are_refused(spark, root):
    invoicing.append_invoices(*batch(spark, 100), root, "b")
    with pytest.raises(appends.BatchConflict):
        invoicing.append_invoices(*batch(spark, 102), root, "late")
    with pytest.raises(appends.BatchConflict):
        invoicing.append_invoices(*batch(spark, 4), root, "over old rows")


def test_appends_without_a_batch_keep_the_table_form(spark, root):
    heads, lines = batch(spark, 100)
    invoicing.append_invoices(heads, lines, root)
    back = spark.read.parquet(f"{root}/purchase_invoices")
    assert back.columns == ["id", "invoice_number", "note"] and back.count() == 8


# --- month partitions ---

def files(path):
    return {os.path.join(d, f): (os.stat(os.path.join(d, f)).st_mtime_ns, os.stat(os.path.join(d, f)).st_ino)
            for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


AS_OF = dt.date(2001, 7, 31)


def few_ids(t):
    """Invoices of two months only."""
    months = [r[0] for r in snapshots.by_month(t.purchase_invoices).select("created_month").distinct()
              .orderBy("created_month").limit(2).collect()]
    return snapshots.by_month(t.purchase_invoices).where(F.col("created_month").isin(months)).select("id"), months


@pytest.mark.parametrize("kind", ["update", "void", "purge"])
def test_only_touched_months_are_replaced(spark, t, tmp_path, kind):
    path = str(tmp_path / "invoices")
    snapshots.write_by_month(t.purchase_invoices, path)
    ids, months = few_ids(t)
    before = files(path)
    updates = Q._update_requests(t).join(ids.withColumnRenamed("id", "invoice_id"), "invoice_id", "left_semi")
    run = {"update": lambda: snapshots.update_in_place(t, path, updates, AS_OF),
           "void": lambda: snapshots.void_in_place(t, path, ids, AS_OF),
           "purge": lambda: snapshots.purge_in_place(t, path, ids)}[kind]
    want = {"update": lambda: mutations.update_invoices(t, updates, AS_OF),
            "void": lambda: mutations.void_invoices(t, ids, AS_OF),
            "purge": lambda: mutations.purge_invoices(t, ids)}[kind]()[0]
    touched = run()
    assert set(touched) <= set(months) and touched
    inside = tuple(f"created_month={m}/" for m in touched)
    keep = lambda fs: {k: v for k, v in fs.items() if not any(m in k for m in inside)}
    assert keep(files(path)) == keep(before) and len(keep(before)) > 10  # same files, times and places
    got = snapshots.read_by_month(spark, path).drop("created_month").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_month_that_loses_all_rows_goes(spark, tmp_path):
    rows = [(1, dt.datetime(2001, 1, 5)), (2, dt.datetime(2001, 2, 5)), (3, None), (4, dt.datetime(2001, 2, 6))]
    df = spark.createDataFrame(rows, "id long, created_date timestamp")
    path = str(tmp_path / "x")
    snapshots.write_by_month(df, path)
    ids = spark.createDataFrame([(1,), (3,), (9,)], "id long")
    months = snapshots.change_months(spark, path, ids, lambda old: old.join(ids, "id", "left_anti"))
    assert months == [None, 200101]
    assert sorted(r["id"] for r in snapshots.read_by_month(spark, path).collect()) == [2, 4]
    assert snapshots.change_months(spark, path, ids, lambda old: old) == []


def test_links_change_in_place(spark, t, tmp_path):
    path = str(tmp_path / "links")
    snapshots.write_by_month(t.purchase_invoice_medias, path)
    ids = t.purchase_invoice_medias.where("media_id % 5 = 0").select("id")
    snapshots.remove_links_in_place(t, path, ids, AS_OF)
    want = mutations.remove_attachment_links(t, ids, AS_OF)[0]
    got = snapshots.read_by_month(spark, path).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


# --- layout ---

def test_layout_has_the_same_rows_in_another_session(spark, t, tmp_path):
    root = str(tmp_path)
    n = layout.write_layout(t, root)
    again = layout.layout_tables(spark.newSession(), root, n)
    for name in layout.DOMAIN_TABLES:
        a, b = t.table(name), again.table(name).select(*t.table(name).columns)
        assert a.exceptAll(spark.createDataFrame(b.collect(), a.schema)).isEmpty() and a.count() == b.count()


# --- documents ---

def test_documents_round_trip_under_their_key(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("ACME Corp", "Box Label", 1, 10), ("ACME Corp", "Box Label", 2, 20), ("ACME Corp", "7", 1, 5),
            ("12", "Box Label", 1, 6), ("b=c/d", "x%y", 1, 7), (None, "a", 1, 1), ("", "a", 1, 1), ("z", None, 1, 1)]
    df = spark.createDataFrame(rows, "customer_code string, template_name string, version int, w int")
    df = df.withColumn("template", F.struct("w"))
    D.save_templates(df, path, order_col="version")
    stored = {(r["customer"], r["name"]): r["w"] for r in D.load_templates(spark, path, "app").select(
        "customer", "name", F.variant_get("document", "$.w", "int").alias("w")).collect()}
    assert stored == {("acme_corp", "box_label"): 20, ("acme_corp", "7"): 5, ("12", "box_label"): 6, ("b=c/d", "x%y"): 7}
    # one document is replaced, the others stay; saving again changes nothing
    new = spark.createDataFrame([("acme corp", "BOX LABEL", 9)], "customer_code string, template_name string, w int") \
        .withColumn("template", F.struct("w"))
    for _ in range(2):
        D.save_templates(new, path)
    keys = spark.createDataFrame([("ACME Corp", "Box Label"), ("ACME Corp", "gone")], "c string, n string")
    got = D.load_templates(spark, path, "app", keys)
    assert [(r["key"], r["w"]) for r in got.select("key", F.variant_get("document", "$.w", "int").alias("w")).collect()] \
        == [("app/label-management/templates/acme_corp/box_label.json", 9)]
    assert D.load_templates(spark, path).count() == 4
    assert sorted(r["name"] for r in D.list_templates(spark, path, "app", "ACME Corp").collect()) == ["7", "box_label"]


def test_bad_documents_are_null(spark, tmp_path):
    path = tmp_path / "customer=a"
    for name, text in (("good", '{"k": 3}'), ("bad", "{not json"), ("odd", '{"k": "x"}'), ("blank", " ")):
        os.makedirs(path / f"name={name}")
        (path / f"name={name}" / "part-0.txt").write_text(text)
    rows = D.load_templates(spark, str(tmp_path)).select(
        "name", F.col("document").isNull().alias("none"), F.try_variant_get("document", "$.k", "long").alias("k"))
    assert {r["name"]: (r["none"], r["k"]) for r in rows.collect()} == {
        "good": (False, 3), "bad": (True, None), "odd": (False, None), "blank": (True, None)}


# --- listings ---

def test_a_store_is_listed_by_tasks(spark):
    root = tempfile.mkdtemp(prefix="ledgerline-store-")
    want = {}
    for key, size in [("top.txt", 3), ("a/one.pdf", 5), ("a/b/two.pdf", 7), ("a/b/c/.keep", 0), ("d/e/f/g/three.png", 11)] \
            + [(f"many/{i % 17}/{i}.bin", i) for i in range(300)]:
        os.makedirs(os.path.dirname(f"{root}/{key}"), exist_ok=True)
        with open(f"{root}/{key}", "w") as fh:
            fh.write("x" * size)
        want[key] = size
    os.makedirs(f"{root}/empty/deeper")
    got = attachments.list_store(spark, root)
    assert {r["key"]: r["size"] for r in got.collect()} == want and got.count() == len(want)
    same = {r["key"]: r["last_modified"] for r in attachments.listing_from_folder(spark, root).collect()}
    # the binaryFile source leaves out empty files
    assert {r["key"]: r["last_modified"].replace(microsecond=0) for r in got.where("size > 0").collect()} == {
        k: v.replace(microsecond=0) for k, v in same.items()}
    assert attachments.folder_sizes(got).where("prefix = 'many/'").first()["file_count"] == 300
    uri = attachments.list_store(spark, f"file://{root}")
    assert uri.count() == len(want) and uri.where("key = 'a/b/two.pdf'").count() == 1


def test_changes_between_listings(spark):
    row = lambda k, s, e: (k, s, dt.datetime(2001, 1, 1), e)
    schema = "key string, size long, last_modified timestamp, etag string"
    old = spark.createDataFrame([row("a", 1, "x"), row("b", 2, None), row("c", 3, "z"), row("d", 4, None)], schema)
    new = spark.createDataFrame([row("a", 1, "x"), row("b", 2, "y"), row("d", 4, None), row("e", 5, None)], schema)
    assert {(r["key"], r["change"]) for r in attachments.listing_changes(old, new).collect()} == {
        ("b", "changed"), ("c", "removed"), ("e", "added")}


def test_a_run_can_be_cleaned(spark):
    df = written(spark.range(5), "probe")
    assert df.count() == 5 and os.path.isdir(run_folder(spark))
    assert callable(clean_run)  # called by jobs at their end; other tests still read this run's tables
