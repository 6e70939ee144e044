"""Money, quantity and number-format column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"
#: Sums, products and amounts converted to another currency, which may have many more units.
CONVERTED = "decimal(24,2)"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cost_amount(cost_text) -> Column:
    """Amount part of a ``"12.50 USD"`` cost text, split on the first single space.

    Bad numbers give NULL (``try_cast``) instead of MySQL's silent 0.
    """
    return _try_decimal(F.substring_index(col_(cost_text), " ", 1))


def _try_decimal(c: Column, type_: str = MONEY) -> Column:
    return c.try_cast(type_)


def cost_currency(cost_text) -> Column:
    """Currency part: text after the last single space (whole text when no space)."""
    return F.substring_index(col_(cost_text), " ", -1)


def cost_tokens(cost_text) -> Column:
    """Whitespace tokens of a cost text (the Python ``str.split()`` reading)."""
    return F.filter(F.split(F.trim(col_(cost_text)), r"\s+"), lambda t: t != "")


def cost_amount_tokens(cost_text) -> Column:
    """Amount when the text has at least two tokens, else NULL (row is skipped)."""
    toks = cost_tokens(cost_text)
    return F.when(F.size(toks) >= 2, _try_decimal(F.element_at(toks, 1)))


def cost_currency_tokens(cost_text) -> Column:
    toks = cost_tokens(cost_text)
    return F.when(F.size(toks) >= 2, F.element_at(toks, 2))


def round_money(c) -> Column:
    """Round half-up to cents, as SQL ROUND on DECIMAL does."""
    return F.round(col_(c), 2).cast(MONEY)


def round_amount(c) -> Column:
    """Round half-up to cents in the wide type: for sums and for quantity x cost."""
    return F.round(col_(c), 2).cast(CONVERTED)


def estimated_value(qty, unit_cost) -> Column:
    """ROUND(qty x unit cost, 2)."""
    return round_amount(col_(qty) * col_(unit_cost))


def vat_amount(qty, unit_cost, vat_percent) -> Column:
    """ROUND(qty x cost x COALESCE(vat, 0) / 100, 2) from the unrounded product."""
    return round_amount(col_(qty) * col_(unit_cost) * F.coalesce(col_(vat_percent), F.lit(0))
                       * F.lit(0.01).cast("decimal(3,2)"))


def cost_text(amount, code) -> Column:
    """CONCAT(ROUND(cost, 2), ' ', code); NULL if either part is NULL."""
    return F.concat(round_money(amount).cast("string"), F.lit(" "), col_(code))


def strict_greatest(*cols) -> Column:
    """GREATEST that is NULL when any argument is NULL (MySQL semantics)."""
    cs = [col_(c) for c in cols]
    any_null = cs[0].isNull()
    for c in cs[1:]:
        any_null = any_null | c.isNull()
    return F.when(~any_null, F.greatest(*cs))


def strict_least(*cols) -> Column:
    cs = [col_(c) for c in cols]
    any_null = cs[0].isNull()
    for c in cs[1:]:
        any_null = any_null | c.isNull()
    return F.when(~any_null, F.least(*cs))


def _plain_number(c: Column, digits: int) -> Column:
    # format_number groups thousands; the reference's f"{x:.2f}" does not.
    return F.regexp_replace(F.format_number(c, digits), ",", "")


def large_number(value, currency) -> Column:
    """``1.23B USD`` / ``4.56M USD`` / ``7.8K USD`` / ``9.00 USD``."""
    v = col_(value).cast("double")
    text = (F.when(v >= 1e9, F.concat(_plain_number(v / 1e9, 2), F.lit("B")))
            .when(v >= 1e6, F.concat(_plain_number(v / 1e6, 2), F.lit("M")))
            .when(v >= 1e3, F.concat(_plain_number(v / 1e3, 1), F.lit("K")))
            .otherwise(_plain_number(v, 2)))
    return F.concat(text, F.lit(" "), col_(currency))


def format_rate(rate) -> Column:
    """Exchange-rate display: more decimals for smaller rates; N/A when missing.

    Rates <= 0 (which never terminate in the reference's digit loop) give N/A.
    """
    r = col_(rate).cast("double")
    # digits after the point for rates below 1: leading zeros + 3
    small_digits = F.greatest(F.lit(0), F.ceil(-F.log10(r) - F.lit(1.0))).cast("int") + 3
    return (F.when(r.isNull() | (r <= 0), F.lit("N/A"))
            .when(r >= 1000, F.format_number(r, 2))
            .when(r >= 10, F.format_number(r, 4))
            .when(r >= 1, F.format_number(r, 6))
            .otherwise(_format_number_dyn(r, small_digits)))


def _format_number_dyn(r: Column, digits: Column) -> Column:
    """``r`` (0 < r < 1) with a digit count of its own: whole units of the last digit, zero-padded.

    The three significant digits come from the decimal text of the scaled
    value, so the count isn't limited.
    """
    scaled = F.replace(F.format_number(r * F.pow(F.lit(10.0), digits), 0), F.lit(","), F.lit(""))
    return F.when(F.length(scaled) > digits, F.concat(F.lit("1."), F.repeat(F.lit("0"), digits))) \
        .otherwise(F.concat(F.lit("0."), F.lpad(scaled, digits, F.lit("0"))))


def size_mb(size_bytes) -> Column:
    """bytes / 1024^2 rounded to 2 places."""
    return F.round(col_(size_bytes).cast("double") / F.lit(1024.0 * 1024.0), 2)
