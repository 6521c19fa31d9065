"""Named queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with an optional SQL check."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return wrap


# Views hold values with few decimals, so means of them can fall exactly on a
# rounding boundary where summation order decides; this moves them off it.
OFF_TIE = 1.7e-9


def near(c, digits: int = 6):
    """Column rounded for comparison, without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(OFF_TIE), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double so that engines with other summation orders agree."""
    cols = {
        f.name: near(f.name, digits)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip
    }
    return df.withColumns(cols) if cols else df


def near_sql(expr: str, digits: int = 6) -> str:
    return f"round(({expr}) + 1.7e-9::DOUBLE, {digits}) + 0.0::DOUBLE"


def round_sql(cols: str | list[str], digits: int = 6) -> str:
    """``round(c, digits) AS c`` for a list of columns."""
    names = cols.split() if isinstance(cols, str) else cols
    return ", ".join(f"{near_sql(c, digits)} AS {c}" for c in names)
