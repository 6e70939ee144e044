"""Scalar column functions and NULL / rounding rules."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerline.functions import files as FL
from ledgerline.functions import money as M


def one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_cost_split(spark):
    data = [("12.50 USD",), ("7 VND",), ("abc EUR",), ("USD",), (None,)]
    amounts = one(spark, M.cost_amount("c"), data, "c string")
    assert amounts == [Decimal("12.50"), Decimal("7.00"), None, None, None]
    assert one(spark, M.cost_currency("c"), data, "c string") == ["USD", "VND", "EUR", "USD", None]
    # whitespace-token reading: rows without two tokens give NULL
    assert one(spark, M.cost_currency_tokens("c"), data, "c string") == ["USD", "VND", "EUR", None, None]


def test_strict_greatest_is_null_when_any_null(spark):
    got = one(spark, M.strict_greatest(F.lit(0), M.strict_least("a", "b")),
              [(3, None), (3, 5), (-2, 5)], "a int, b int")
    assert got == [None, 3, 0]


def test_money_rounds_half_up(spark):
    got = one(spark, M.round_money(F.col("x")), [(Decimal("2.675"),), (Decimal("0.125"),)],
              "x decimal(10,3)")
    assert got == [Decimal("2.68"), Decimal("0.13")]


def test_large_number(spark):
    got = one(spark, M.large_number("v", F.lit("USD")),
              [(1.5e9,), (2_345_678.0,), (12_345.0,), (12.5,), (-5e6,)], "v double")
    assert got == ["1.50B USD", "2.35M USD", "12.3K USD", "12.50 USD", "-5000000.00 USD"]


def test_format_rate(spark):
    got = one(spark, M.format_rate("r"), [(None,), (25000.0,), (15.5,), (1.25,), (0.05,),
                                          (0.0004,), (0.0,)], "r double")
    assert got == ["N/A", "25,000.00", "15.5000", "1.250000", "0.0500", "0.000400", "N/A"]


def test_file_helpers(spark):
    data = [("scan 1.PDF",), ("noext",), ("hóa đơn.jpg",), ("a.b.png",)]
    assert one(spark, FL.file_extension("f"), data, "f string") == ["pdf", "", "jpg", "png"]
    assert one(spark, FL.content_type("f"), data, "f string") == [
        "application/pdf", "application/octet-stream", "image/jpeg", "image/png"]
    assert one(spark, FL.valid_filename("f"), data, "f string") == [True, True, False, True]
    assert one(spark, FL.sanitize_filename("f"), data, "f string") == [
        "scan_1.pdf", "noext", "ha_n.jpg", "a.b.png"]
    long = [("x" * 120 + ".pdf",)]
    assert one(spark, FL.sanitize_filename("f"), long, "f string") == ["x" * 100 + ".pdf"]


def test_file_size_text(spark):
    got = one(spark, FL.file_size_text("s"), [(512,), (1280,), (5 * 1024 * 1024,)], "s long")
    assert got == ["512 B", "1.2 KB", "5.0 MB"]
