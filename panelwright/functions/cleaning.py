"""Small column helpers: coercion, safe ratios, clipping, sanitising, text keys."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """Text to double; anything unparseable, NaN or infinite is NULL."""
    return finite(text.try_cast("double"))


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def finite_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Apply :func:`finite` to several columns in one projection."""
    return df.withColumns({c: finite(F.col(c)) for c in cols})


def ratio(a: Column, b: Column) -> Column:
    """a / b with a zero divisor treated as missing."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def floor_at_zero(c: Column) -> Column:
    """max(c, 0) that keeps NULL (``greatest`` alone would return the bound)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def log1p_pos(c: Column) -> Column:
    return F.log1p(floor_at_zero(c))


def sqrt_pos(c: Column) -> Column:
    return F.sqrt(floor_at_zero(c))


def clip(c: Column, lo: Column, hi: Column) -> Column:
    """Clamp to [lo, hi], NULL stays NULL."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def text_key(c: Column) -> Column:
    """Trimmed upper-case key used by name joins."""
    return F.upper(F.trim(c))


def safe_identifier(c: Column, width: int = 15) -> Column:
    """Blank and slash to underscore, ampersand to n, cut to ``width``."""
    return F.substring(F.translate(c, " /&", "__n"), 1, width)


def fixed(c: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded from the exact binary value as C's printf does.

    ``format_string`` rounds the shortest decimal form half up instead (0.35 becomes 0.4 although
    the double lies below it). ``format_number`` is exact except between half a unit and one unit.
    """
    half = float(f"5e-{digits + 1}")
    up = F.abs(c) >= half if Fraction(half) > Fraction(5, 10 ** (digits + 1)) else F.abs(c) > half
    unit = F.concat(F.when(c < 0, "-").otherwise(""), F.lit(f"{10.0 ** -digits:.{digits}f}"))
    return F.when(up & (F.abs(c) < 10.0**-digits), unit).otherwise(F.replace(F.format_number(c, digits), F.lit(","), F.lit("")))


def is_ascii(c: Column) -> Column:
    return c.rlike("^[\\x00-\\x7F]*$")


def strip_lag(c: Column) -> Column:
    """Base variable of a ``_lagN`` feature name."""
    return F.regexp_replace(c, "_lag[0-9]+$", "")


def to_map(pairs: dict, key: Column, default=None) -> Column:
    """CASE over a small literal dict."""
    out = None
    for k, v in pairs.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))
