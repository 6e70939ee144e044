"""Operator properties on small frames."""

import csv
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import reports, selections, worklist
from ledgerline.operators.dedup import first_per_key
from ledgerline.operators.sequence import row_numbers
from ledgerline.plans import queries


def test_row_numbers_match_window(spark):
    rnd = random.Random(7)
    # one hot group holding most rows, many small groups
    rows = [(0 if rnd.random() < 0.6 else rnd.randint(1, 50), i, rnd.randint(0, 1000))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, id long, k int").repartition(7)
    got = row_numbers(df, ["g"], ["k", "id"], out="rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    assert sorted(got.select("g", "id", "rn").collect()) == \
        sorted(want.select("g", "id", F.col("rn").cast("long")).collect())


def test_row_numbers_of_hot_and_small_groups(spark):
    """Groups over the limit go by ranges, the others by a window; NULL is a group, ties get all their numbers."""
    rows = [(None if i % 3 == 0 else i % 11, i % 400, f"v{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "g long, k int, v string").repartition(5)
    places = {}
    for g, k, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        at = places.setdefault(g, [])
        at.append(k)
    want = sorted((str(g), k, v, n + 1) for g, k, v in rows for n, x in enumerate(places[g]) if x == k)
    for hot in (10, 100, 10 ** 6):
        got = row_numbers(df, ["g"], ["k"], "rn", hot_rows=hot).collect()
        assert sorted((str(r.g), r.k, r.v, r.rn) for r in got) == want


def test_row_numbers_over_many_ranges(spark):
    """Ranges keep their order in the files they are numbered from, rows that share a key included."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(2000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"), "id")
        got = row_numbers(df, [], ["k", "id"], "rn").collect()
        assert [r.rn for r in sorted(got, key=lambda r: (r.k, r.id))] == list(range(1, 2001))
        tied = row_numbers(df, [], ["k"], "rn").collect()
        assert sorted((r.k, r.id, r.rn) for r in tied) == sorted(
            (k, i, 2 * k + n) for k in range(1000) for i in range(2000) if i * 7919 % 1000 == k for n in (1, 2))
        got = row_numbers(df, ["g"], ["k", "id"], "rn", hot_rows=1).collect()
        for g in range(3):
            mine = sorted((r.k, r.id, r.rn) for r in got if r.g == g)
            assert [rn for _, _, rn in mine] == list(range(1, len(mine) + 1))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_small_groups_are_numbered_after_one_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("g"), "id", F.lit("x").alias("v"))
    plan = row_numbers(df, ["g"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_row_numbers_global(spark):
    df = spark.range(0, 500).withColumn("k", (F.col("id") * 7919) % 500).repartition(5)
    got = row_numbers(df, [], ["k"], out="rn").select("k", "rn").collect()
    assert sorted((r.k, r.rn) for r in got) == [(k, k + 1) for k in range(500)]


def test_first_per_key_picks_latest_and_keeps_nulls_last(spark):
    df = spark.createDataFrame(
        [("a", 1, 10.0), ("a", 3, None), ("a", 2, 30.0), ("b", None, 5.0), ("b", 1, 6.0)],
        "k string, d int, v double")
    got = {r.k: (r.d, r.v) for r in first_per_key(df, ["k"], [F.col("d")]).collect()}
    # the latest row wins even with a NULL value; a NULL ordering key sorts lowest
    assert got == {"a": (3, None), "b": (1, 6.0)}


def test_queries_reach_every_worklist_filter(spark):
    used = {*queries.SAMPLE_FILTERS, *queries.PARTY_FILTERS, "an_numbers", "po_numbers"}
    assert used == {*worklist.LIST_FILTERS, *worklist.RANGE_FILTERS}
    lines = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, arrival_note_number string")
    notes = spark.createDataFrame([("a",), ("a",), (None,)], "note string")
    assert [r["id"] for r in worklist.apply_filters(lines, {"an_numbers": notes}).collect()] == [1]


def test_requested_selection_without_rows_fails(spark):
    sel = spark.createDataFrame(
        [(1, 1, "v", "External", "e"), (2, 2, "v", "External", "e"), (2, 3, "w", "External", "e")],
        "selection_id long, line_no long, vendor_code string, vendor_type string, legal_entity_code string")
    requests = spark.createDataFrame([(1,), (2,), (9,), (9,)], "selection_id long")
    got = {r["selection_id"]: (r["is_valid"], r["error"]) for r in
           selections.selection_check(sel, requests).collect()}
    assert got[1] == (True, "") and not got[2][0] and got[9] == (False, "No items selected") and len(got) == 3
    assert selections.selection_check(sel).count() == 2


def test_exported_csv_reads_back(spark, tmp_path):
    rows = [(1, 'say "hi", you', "1.10"), (2, "two\nlines\\", "0.00"), (3, None, None), (4, "", "5.00"), (5, " é ", "-7.25"),
            (6, '\\"', "1.00")]
    df = spark.createDataFrame(rows, "id int, note string, amount string").withColumn(
        "amount", F.col("amount").cast("decimal(15,2)")).repartition(3)
    reports.export_csv(df, str(tmp_path / "report"))
    files = sorted((tmp_path / "report").glob("*.csv"))
    assert files and all(f.read_text().startswith("id,note,amount\n") for f in files)
    got = [r for f in files for r in csv.reader(f.open(newline=""))]
    assert sorted(r for r in got if r[0] != "id") == [[str(i), n or "", a or ""] for i, n, a in rows]
    text = "".join(f.read_text() for f in files)
    assert '4,"",5.00\n' in text and "3,,\n" in text
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True) \
        .option("nullValue", "none").schema(df.schema).csv(str(tmp_path / "report"))
    assert sorted((r["id"], r["note"] or "", r["amount"]) for r in back.where("id != 3").collect()) == \
        [tuple(r) for r in df.where("id != 3").orderBy("id").collect()]
