"""Scalar expressions (X1-X15, P3, P4, P8) as Column builders.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.schemas import MONEY


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def final_price(price="price", discount="discount") -> Column:
    """ROUND(price - price*discount/100, 2) on decimals (HALF_UP); 99.99 @ 12.5 -> 87.49."""
    p, d = _c(price), _c(discount)
    return F.round(p - (p * d / 100), 2)


def you_save(price="price", discount="discount") -> Column:
    """ROUND(price*discount/100, 2)."""
    p, d = _c(price), _c(discount)
    return F.round(p * d / 100, 2)


def line_subtotal(quantity="quantity", price="price") -> Column:
    """quantity * price (exact decimal)."""
    return _c(quantity) * _c(price)


def stock_value(quantity="quantity", unit_price="unit_price") -> Column:
    return _c(quantity) * _c(unit_price)


def is_low(quantity="quantity", reorder_level="reorder_level") -> Column:
    """Low stock is inclusive: quantity <= reorder_level."""
    return _c(quantity) <= _c(reorder_level)


def to_total(c) -> Column:
    """A sum of money or stock: two decimals, wide enough for any corpus total."""
    return _c(c).cast("decimal(20,2)")


def to_money(c) -> Column:
    """Cast back to the stored DECIMAL(10,2) (ANSI: overflow raises)."""
    return _c(c).cast(MONEY)


def sum_or_zero(c) -> Column:
    """IFNULL(SUM(x), 0)."""
    return F.coalesce(F.sum(_c(c)), F.lit(0))


def day_of(ts="order_date") -> Column:
    """DATE(ts)."""
    return F.to_date(_c(ts))


def money_text(c) -> Column:
    """Thousands format with two decimals: 1234.5 -> '1,234.50'."""
    return F.format_number(_c(c), 2)


def percent_text(c) -> Column:
    """Percent without trailing zeros: 10.00 -> '10', 12.50 -> '12.5'."""
    txt = _c(c).cast("string")
    return F.when(F.instr(txt, ".") > 0,
                  F.regexp_replace(F.regexp_replace(txt, "0+$", ""), r"\.$", "")).otherwise(txt)


def tolerant_number(c, default: float = 0.0) -> Column:
    """Parse text as a number, falling back to ``default`` (never raises)."""
    return F.coalesce(F.expr(f"try_cast({_sql_name(c)} AS DOUBLE)"), F.lit(default))


def tolerant_int(c, default: int = 0) -> Column:
    """Integer cast of text like PHP (int): '3.7' -> 3, 'x' -> default."""
    return F.coalesce(F.expr(f"try_cast(try_cast({_sql_name(c)} AS DOUBLE) AS BIGINT)"),
                      F.lit(default))


def at_least_one(c) -> Column:
    """max(1, qty)."""
    return F.greatest(F.lit(1), _c(c))


def or_label(c, label: str) -> Column:
    """IFNULL(c, 'label'), e.g. a NULL customer shown as 'Walk-in'."""
    return F.coalesce(_c(c), F.lit(label))


def name_or(c, other) -> Column:
    """PHP ``a ?: b`` — NULL or empty text falls back to another column."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), _c(other))


def password_hash(c) -> Column:
    """SHA2(text, 256) as lowercase hex."""
    return F.sha2(_c(c), 256)


def purchase_message(name, before, after) -> Column:
    """'Stock raised: <name> <before> -> <after>' with money formatting."""
    return F.format_string("Stock raised: %s %s -> %s", _c(name), money_text(before),
                           money_text(after))


def like_contains(c, text: str) -> Column:
    """Case-insensitive ``LIKE '%text%'`` with the text used raw, so ``%`` and
    ``_`` typed by a user act as wildcards (as in the reference)."""
    return _c(c).ilike(f"%{text}%")


def _sql_name(c) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("tolerant parsers take a column name")
