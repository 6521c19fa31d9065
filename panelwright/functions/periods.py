"""Month keys, ordinals, quarters, fiscal years and date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date layouts, day first.
DAY_FIRST_FORMATS = ["dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "dd-MMM-yyyy", "dd.MM.yyyy"]


def period_key(ts: Column) -> Column:
    """``yyyy-MM`` from a date or timestamp."""
    return F.concat_ws("-", F.year(ts).cast("string"), F.lpad(F.month(ts).cast("string"), 2, "0"))


def month_ordinal(ts: Column) -> Column:
    """year * 12 + month."""
    return (F.year(ts) * 12 + F.month(ts)).cast("int")


def period_ordinal(period: Column) -> Column:
    """Month ordinal of a ``yyyy-MM`` key."""
    return (F.substring(period, 1, 4).cast("int") * 12 + F.substring(period, 6, 2).cast("int")).cast("int")


def ordinal_period(ordinal: Column) -> Column:
    """``yyyy-MM`` key of a month ordinal."""
    year = F.floor((ordinal - 1) / 12).cast("int")
    month = (F.pmod(ordinal - 1, F.lit(12)) + 1).cast("int")
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))


def quarter_label(period: Column) -> Column:
    """``Q1-2024`` from ``2024-03``."""
    month = F.substring(period, 6, 2).cast("int")
    quarter = (F.floor((month - 1) / 3) + 1).cast("int")
    return F.concat(F.lit("Q"), quarter.cast("string"), F.lit("-"), F.substring(period, 1, 4))


def fiscal_year(period: Column) -> Column:
    """April-start fiscal year: ``2024-03`` gives ``FY2023``."""
    year = F.substring(period, 1, 4).cast("int")
    month = F.substring(period, 6, 2).cast("int")
    return F.concat(F.lit("FY"), F.when(month >= 4, year).otherwise(year - 1).cast("string"))


def parse_day_first(text: Column, formats: list[str] | None = None) -> Column:
    """Day-first date; unparseable text becomes NULL."""
    trimmed = F.trim(text)
    tries = [F.try_to_timestamp(trimmed, F.lit(f)).cast("date") for f in (formats or DAY_FIRST_FORMATS)]
    return F.coalesce(*tries)


def cyclic_month(period: Column) -> tuple[Column, Column]:
    """(sin, cos) of the month of year."""
    angle = F.substring(period, 6, 2).cast("double") * F.lit(2.0 * 3.141592653589793 / 12.0)
    return F.sin(angle), F.cos(angle)
