"""Macro series: constant and quarterly tables, month spine, detection, pivot, derived rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions import periods as pr
from panelwright.functions.cleaning import to_number
from panelwright.operators.bars import pct_change

# Names of rate columns that get no percent change.
RATE_COLUMNS = ["repo_rate", "cpi", "cpi_inflation", "gdp_growth", "real_interest_rate", "repo_rate_change"]
# Words that mark date and value columns of an unknown price file.
DATE_WORDS = ["date"]
VALUE_WORDS = ["gold", "price", "usd", "inr"]
# Words that mark macro columns in a wide panel.
MACRO_WORDS = ["nifty", "index", "vix", "_return", "_pct"]


def constant_series(spark: SparkSession, values: dict[str, float], name: str) -> DataFrame:
    """A literal month-to-value table."""
    return spark.createDataFrame(list(values.items()), f"period string, {name} double")


def quarters_to_months(df: DataFrame, quarter: str, value: str) -> DataFrame:
    """``Q2-2024`` rows to three month rows each."""
    q = F.substring(quarter, 2, 1).cast("int")
    year = F.substring(quarter, 4, 4).cast("int")
    first = year * 12 + (q - 1) * 3 + 1
    return df.select(F.explode(F.sequence(first, first + 2)).alias("_m"), value).select(
        pr.ordinal_period(F.col("_m")).alias("period"), value
    )


def month_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every month between two ``yyyy-MM`` keys."""
    step = F.expr("interval 1 month")
    days = F.sequence(F.to_date(F.lit(start + "-01")), F.to_date(F.lit(end + "-01")), step)
    return spark.range(1).select(F.explode(days).alias("_d")).select(pr.period_key(F.col("_d")).alias("period"))


def find_date_and_value(cols: list[str]) -> tuple[str, str]:
    """Date and value column of a price file, by keyword, else the first two columns."""
    dates = [c for c in cols if any(k in c.lower() for k in DATE_WORDS)]
    values = [c for c in cols if any(k in c.lower() for k in VALUE_WORDS) and c not in dates]
    if dates and values:
        return dates[0], values[0]
    if len(cols) < 2:
        raise KeyError(f"no date and value column in {cols}")
    return cols[0], cols[1]


def last_per_month(df: DataFrame, name: str) -> DataFrame:
    """Last known value of each month of a file with unknown headers."""
    date, value = find_date_and_value(df.columns)
    d = F.col(date) if dict(df.dtypes)[date] != "string" else pr.parse_day_first(F.col(date))
    v = to_number(F.col(value).cast("string"))
    rows = df.select(d.alias("_d"), v.alias("_v")).where(F.col("_d").isNotNull())
    return rows.groupBy(pr.period_key(F.col("_d")).alias("period")).agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_d"))).alias(name)
    )


def pivot_symbols(df: DataFrame, symbols: list[str], values: dict[str, str]) -> DataFrame:
    """One column per symbol and value; the symbol list is given, so no extra scan."""
    aggs = [F.max(c).alias(suffix) for c, suffix in values.items()]
    return df.where(F.col("symbol").isin(*symbols)).groupBy("period").pivot("symbol", symbols).agg(*aggs)


def join_on_spine(spine: DataFrame, series: list[DataFrame]) -> DataFrame:
    """Left join several month series; columns already taken get a numbered prefix."""
    out = spine
    for i, s in enumerate(series):
        clash = {c: f"src{i}_{c}" for c in s.columns if c != "period" and c in out.columns}
        out = out.join(s.withColumnsRenamed(clash), "period", "left")
    return out


def forward_fill(df: DataFrame, cols: list[str], order: str = "period") -> DataFrame:
    """Carry the last value forward over a one-row-per-month table."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def derive_macro(df: DataFrame, policy: str = "repo_rate", inflation: str = "cpi") -> DataFrame:
    """Percent change for levels, real rate and change of the policy rate (one row per month)."""
    w = W.orderBy("period")
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer")]
    levels = [c for c in numeric if c not in RATE_COLUMNS and "_return" not in c and "_pct" not in c and c != "month_ord"]
    new: dict[str, Column] = {f"{c}_pct": pct_change(F.col(c), w) for c in levels if f"{c}_pct" not in df.columns}
    if policy in df.columns and inflation in df.columns:
        new["real_interest_rate"] = F.col(policy) - F.col(inflation)
    if policy in df.columns:
        new["repo_rate_change"] = F.col(policy) - F.lag(policy).over(w)
    return df.withColumns(new)


def macro_columns(cols: list[str], named: list[str]) -> list[str]:
    """Columns of a wide panel that hold macro series, by name."""
    return [c for c in cols if c in named or any(k in c.lower() for k in MACRO_WORDS)]


def macro_panel(df: DataFrame, cols: list[str], order: list[str]) -> DataFrame:
    """First non-NULL value per month under an explicit order."""
    at = F.struct(*order)
    return df.groupBy("period").agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in cols])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
