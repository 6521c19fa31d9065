"""Lagged, derived, filled, pruned and standardised features."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.cleaning import clip, log1p_pos, ratio, sqrt_pos
from panelwright.operators import skew
from panelwright.session import require_columns

# Share of periods used to fit statistics.
TRAIN_SHARE = 0.65
VALIDATION_SHARE = 0.17

# Feature groups of the ablation study by name prefix.
FEATURE_GROUPS = {
    "technical": ["rsi", "macd", "macd_signal", "bollinger_pband", "sma_20_pct", "sma_50_pct", "obv_change", "atr_pct",
                  "monthly_volatility", "volume_ratio"],
    "fundamental": ["pe", "pb", "roe", "debt_equity", "market_cap_log", "promoter_holding_pct", "eps_growth_qoq"],
    "macro": ["nifty50_return", "india_vix_close", "repo_rate", "cpi_inflation", "gdp_growth", "usd_inr_close",
              "crude_oil_close", "gold_usd_close", "us_10y_yield_close", "fii_net_monthly", "dii_net_monthly"],
    "sentiment": ["sentiment_mean", "sentiment_std", "sentiment_count", "pct_positive", "pct_negative"],
    "position": ["pct_nav", "holding_tenure", "allocation_change", "rank", "consensus_count", "fund_n_stocks"],
}
KEY_COLUMNS = {"fund", "isin", "period", "month_ord", "position_action", "action_ordinal", "sector", "stock_name", "date"}


def stock_frame(panel: DataFrame, cols: list[str]) -> DataFrame:
    """One row per (stock, month) of stock-level columns, so that lags step through months."""
    return panel.groupBy("isin", "period").agg(*[F.max(c).alias(c) for c in cols])


def add_lags(df: DataFrame, keys: list[str], order: str, cols: list[str], lags: list[int]) -> DataFrame:
    """``c_lagK`` for every column and lag over one window; ``keys`` + ``order`` must be unique."""
    require_columns(df, [*keys, order, *cols])
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for k in lags for c in cols})


def rolling_return(r: Column, w: W, n: int = 3, at_least: int = 2) -> Column:
    """Compounded return of the last ``n`` rows (exact product over a frame of n values)."""
    frame = w.rowsBetween(-(n - 1), 0)
    values = F.collect_list(r).over(frame)
    product = F.aggregate(values, F.lit(1.0), lambda acc, x: acc * (1.0 + x))
    return F.when(F.count(r).over(frame) >= at_least, product - 1.0)


def rolling_std(c: Column, w: W, n: int = 3, at_least: int = 2) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) >= at_least, F.stddev_samp(c).over(frame))


def relative_to_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Value over the group median; a zero median counts as missing."""
    med = skew.quantiles(df, keys, value, [0.5], "_q")
    df = skew.join_null_safe(df, med, keys, "left")
    return df.withColumn(out, ratio(F.col(value), F.element_at("_q", 1))).drop("_q")


def interactions(pairs: dict[str, tuple[str, str]]) -> dict[str, Column]:
    return {name: F.col(a) * F.col(b) for name, (a, b) in pairs.items()}


def nonlinear() -> dict[str, Column]:
    return {
        "log_market_cap": log1p_pos(F.col("market_cap")),
        "log_pe": log1p_pos(F.col("pe")),
        "sqrt_volatility": sqrt_pos(F.col("monthly_volatility")),
        "log_volume_ratio": log1p_pos(F.col("volume_ratio")),
    }


def interpolate(df: DataFrame, keys: list[str], order: str, cols: list[str], limit: int = 3, back: bool = False) -> DataFrame:
    """Linear gap filling inside each series, then capped carry forward.

    A gap cell is filled when it lies within ``limit`` rows of a known value on
    either side and has known values on both. ``back`` also carries values
    backward, which looks ahead and is therefore off by default.
    """
    w = W.partitionBy(*keys).orderBy(order)
    past, future = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    df = df.withColumn("_pos", F.row_number().over(w))

    def known_at(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.col("_pos"))

    def straight(c: str) -> Column:
        v0, p0 = F.last(c, ignorenulls=True).over(past), F.last(known_at(c), ignorenulls=True).over(past)
        v1, p1 = F.first(c, ignorenulls=True).over(future), F.first(known_at(c), ignorenulls=True).over(future)
        near = (F.col("_pos") - p0 <= limit) | (p1 - F.col("_pos") <= limit)
        line = v0 + (v1 - v0) * (F.col("_pos") - p0) / F.nullif(p1 - p0, F.lit(0))
        return F.coalesce(F.col(c), F.when(near, line))

    def carry(c: str, frame, fn) -> Column:
        v, p = fn(c, ignorenulls=True).over(frame), fn(known_at(c), ignorenulls=True).over(frame)
        return F.coalesce(F.col(c), F.when(F.abs(F.col("_pos") - p) <= limit, v))

    df = df.withColumns({c: straight(c) for c in cols})
    df = df.withColumns({c: carry(c, past, F.last) for c in cols})
    if back:
        df = df.withColumns({c: carry(c, future, F.first) for c in cols})
    return df.drop("_pos")


def period_cuts(df: DataFrame, shares: list[float], period: str = "period") -> list[str]:
    """First period after each cumulative share of the distinct periods.

    The list of periods is bounded by the calendar, so it may come to the driver.
    """
    periods = [r[0] for r in df.select(period).where(F.col(period).isNotNull()).distinct().orderBy(period).collect()]
    out, total = [], 0.0
    for s in shares:
        total += s
        i = int(len(periods) * total + 1e-9)
        out.append(periods[i] if i < len(periods) else "9999-99")
    return out


def add_split(df: DataFrame, shares: list[float] | None = None, period: str = "period") -> DataFrame:
    """train / validation / test by share of distinct periods."""
    cut1, cut2 = period_cuts(df, shares or [TRAIN_SHARE, VALIDATION_SHARE], period)
    p = F.col(period)
    return df.withColumn("split", F.when(p < cut1, "train").when(p < cut2, "validation").otherwise("test"))


def fit_zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and sample deviation of each column as (column_name, mean, std) rows."""
    row = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in cols])
    item = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("s")) for c in cols]))
    return row.select(item.alias("_i")).select(
        "_i.column_name", F.col("_i.s.mean").alias("mean"), F.col("_i.s.std").alias("std")
    )


def apply_zscore(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Standardise with stored statistics; zero deviation leaves the column alone."""
    new = {}
    for r in stats.collect():  # one row per column
        if r["std"] is not None and r["std"] > 0:
            new[r["column_name"]] = (F.col(r["column_name"]) - F.lit(r["mean"])) / F.lit(r["std"])
    return df.withColumns(new)


def winsor_bounds(df: DataFrame, cols: list[str], lo: float, hi: float) -> dict[str, tuple]:
    """Exact lower and upper percentile of each column, all columns in one job."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols]))
    long = df.select(cells.alias("_c")).select("_c.*")
    return {r["column_name"]: tuple(r["q"]) for r in skew.quantiles(long, ["column_name"], "value", [lo, hi], "q").collect()}  # one row per column


def winsorise(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), F.lit(lo), F.lit(hi)) for c, (lo, hi) in bounds.items()})


def correlation_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson r of every column pair from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    both = {f"{a}|{b}": F.corr(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in pairs}
    row = df.agg(*[c.alias(n) for n, c in both.items()])
    item = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]))
    return row.select(item.alias("_i")).select("_i.a", "_i.b", "_i.r")


def greedy_prune(cols: list[str], r: dict[tuple[str, str], float], threshold: float, protected: set[str]) -> list[str]:
    """Columns to drop from a correlation table.

    Walks the pairs in column order; of a pair above the threshold the
    unprotected one goes, else the one with the larger mean absolute r.
    """
    n = len(cols)
    m = np.full((n, n), np.nan)
    np.fill_diagonal(m, 1.0)
    at = {c: i for i, c in enumerate(cols)}
    for (a, b), x in r.items():
        if x is not None:
            m[at[a], at[b]] = m[at[b], at[a]] = abs(x)

    def mean_r(i: int, j: int) -> float:
        rest = [m[i, k] for k in range(n) if k not in (i, j) and not math.isnan(m[i, k])]
        return float(np.mean(rest)) if rest else float("nan")

    gone: set[int] = set()
    for j in range(n):  # column by column, partners above it
        for i in range(j):
            if i in gone or j in gone or not m[i, j] > threshold:
                continue
            if cols[j] in protected:
                gone.add(i)
            elif cols[i] in protected:
                gone.add(j)
            else:
                gone.add(j if mean_r(j, i) > mean_r(i, j) else i)
    return [cols[i] for i in sorted(gone)]


def prune_correlated(df: DataFrame, cols: list[str], threshold: float = 0.95, protected: set[str] = frozenset()) -> DataFrame:
    """Drop redundant columns; only the pair table reaches the driver."""
    r = {(x["a"], x["b"]): x["r"] for x in correlation_pairs(df, cols).collect()}
    return df.drop(*greedy_prune(cols, r, threshold, set(protected)))


def group_panel(df: DataFrame, keys: list[str], cols: list[str], id_col: str, count_name: str) -> DataFrame:
    """Means per group plus the number of distinct ids."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols], F.countDistinct(id_col).alias(count_name))


def frequent_ids(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` most frequent ids, smallest id on ties."""
    return df.groupBy(id_col).agg(F.count("*").alias("n_rows")).orderBy(F.col("n_rows").desc(), id_col).limit(n)


def frequent_panel(df: DataFrame, id_col: str, cols: list[str], n: int) -> DataFrame:
    """Means per period for the most frequent ids only."""
    top = frequent_ids(df, id_col, n).select(id_col)
    return df.join(F.broadcast(top), id_col, "left_semi").groupBy(id_col, "period").agg(*[F.avg(c).alias(c) for c in cols])


def assign_groups(cols: list[str]) -> dict[str, list[str]]:
    """Columns per feature group: by prefix, by lag suffix, and what is left over."""
    out = {g: [c for c in cols if any(c.startswith(p) for p in prefixes)] for g, prefixes in FEATURE_GROUPS.items()}
    out["causal_lags"] = [c for c in cols if "_lag" in c]
    taken = {c for cs in out.values() for c in cs}
    out["other"] = [c for c in cols if c not in taken and c not in KEY_COLUMNS]
    return out
