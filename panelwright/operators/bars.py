"""Price bars and technical indicators.

A symbol's daily series is one row per day, so per-symbol windows and ordered
arrays are bounded by the calendar, not by the number of trades.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.cleaning import finite, ratio


def ohlc(df: DataFrame, keys: list[str], order: list[str], price: str, volume: str) -> DataFrame:
    """Trades to bars: first, max, min, last price and summed volume per key.

    Partial aggregation only; no sort of the trades is needed.
    """
    at = F.struct(*order)
    return df.groupBy(*keys).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.sum(volume).alias("volume"),
    )


def coarsen(bars: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Bars to a coarser period: first open, extremes, last close, summed volume (NULLs skipped)."""

    def edge(c: str, fn) -> Column:
        return fn(F.col(c), F.when(F.col(c).isNotNull(), F.col(date)))

    return bars.groupBy(*keys).agg(
        edge("open", F.min_by).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        edge("close", F.max_by).alias("close"),
        F.sum("volume").alias("volume"),
    )


def pct_change(value: Column, w: W) -> Column:
    """Change from the previous row after carrying the last known value forward."""
    filled = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return F.try_divide(filled, F.nullif(before, F.lit(0.0))) - 1


def full_mean(c: Column, w: W, n: int) -> Column:
    """Mean of the last n rows, NULL until n values exist."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) == n, F.avg(c).over(frame))


def full_std(c: Column, w: W, n: int) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) == n, F.stddev_samp(c).over(frame))


def window_indicators(bars: DataFrame, key: str = "symbol", date: str = "date") -> DataFrame:
    """SMA 50/200, crosses, Bollinger %B, ATR, OBV and the daily return, one shuffle."""
    w = W.partitionBy(key).orderBy(date)
    close = F.col("close")
    df = bars.withColumns(
        {
            "_prev": F.lag("close").over(w),
            "sma20": full_mean(close, w, 20),
            "_sd20": full_std(close, w, 20),
            "sma50": full_mean(close, w, 50),
            "sma200": full_mean(close, w, 200),
        }
    )
    df = df.withColumns(
        {
            "_tr": F.greatest(
                F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_prev")), F.abs(F.col("low") - F.col("_prev"))
            ),
            "_flow": F.col("volume") * F.coalesce(F.signum(close - F.col("_prev")), F.lit(0.0)),
            "_p50": F.lag("sma50").over(w),
            "_p200": F.lag("sma200").over(w),
            "bollinger_pband": ratio(close - (F.col("sma20") - 2 * F.col("_sd20")), 4 * F.col("_sd20")),
            "daily_return": pct_change(close, w),
        }
    )
    up = (F.col("sma50") > F.col("sma200")) & (F.col("_p50") <= F.col("_p200"))
    down = (F.col("sma50") < F.col("sma200")) & (F.col("_p50") >= F.col("_p200"))
    df = df.withColumns(
        {
            "golden_cross": F.when(up, 1).otherwise(0),
            "death_cross": F.when(down, 1).otherwise(0),
            "atr": full_mean(F.col("_tr"), w, 14),
            "obv": F.sum("_flow").over(w.rowsBetween(W.unboundedPreceding, 0)),
        }
    )
    return df.drop("_prev", "_sd20", "_tr", "_flow", "_p50", "_p200", "sma20")


def recursive_indicators(
    bars: DataFrame, key: str = "symbol", date: str = "date", fast: int = 12, slow: int = 26, signal: int = 9, rsi: int = 14
) -> DataFrame:
    """MACD (line, signal, histogram) and Wilder RSI, one pass over each ordered series.

    Spark has no recursive window, so each symbol's series (one row per day,
    hence calendar-bounded) is smoothed in an Arrow batch. Several recursions
    share the pass and the cost is linear in the number of days.
    """

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        close = pdf["close"].astype(float)
        line = close.ewm(span=fast, adjust=False).mean() - close.ewm(span=slow, adjust=False).mean()
        sig = line.ewm(span=signal, adjust=False).mean()
        step = close.diff().to_numpy()

        def wilder(change: np.ndarray) -> np.ndarray:
            out = np.full(len(change), np.nan)
            if len(change) > rsi:
                seeded = np.concatenate([[change[1 : rsi + 1].mean()], change[rsi + 1 :]])
                out[rsi:] = pd.Series(seeded).ewm(alpha=1.0 / rsi, adjust=False).mean().to_numpy()
            return out

        up, down = wilder(np.clip(step, 0, None)), wilder(np.clip(-step, 0, None))
        down[down == 0] = np.nan
        return pd.DataFrame(
            {
                key: pdf[key].to_numpy(), date: pdf[date].to_numpy(), "macd_line": line.to_numpy(), "macd_signal": sig.to_numpy(),
                "macd_hist": (line - sig).to_numpy(), "rsi": 100.0 - 100.0 / (1.0 + up / down),
            }
        )

    schema = f"{key} string, {date} date, macd_line double, macd_signal double, macd_hist double, rsi double"
    got = bars.where(F.col("close").isNotNull()).select(key, date, "close").groupBy(key).applyInPandas(smooth, schema)
    return got.withColumn("rsi", finite(F.col("rsi")))


def monthly_rollup(daily: DataFrame, key: str = "symbol", date: str = "date") -> DataFrame:
    """Daily indicators to one row per symbol and month in a single aggregation."""
    daily = daily.join(daily.groupBy(key).agg(F.avg("volume").alias("_mean_vol")), key)

    def last(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(date))).alias(c)

    levels = [c for c in ("rsi", "macd_line", "macd_signal", "macd_hist", "bollinger_pband", "sma50", "sma200", "obv")
              if c in daily.columns]
    close_first = F.min_by(F.col("close"), F.when(F.col("close").isNotNull(), F.col(date)))
    close_last = F.max_by(F.col("close"), F.when(F.col("close").isNotNull(), F.col(date)))
    return daily.groupBy(key, "period").agg(
        *[last(c) for c in levels],
        F.max("golden_cross").alias("golden_cross"),
        F.max("death_cross").alias("death_cross"),
        F.avg("atr").alias("atr"),
        (ratio(close_last, close_first) - 1).alias("monthly_return"),
        F.stddev_samp("daily_return").alias("monthly_volatility"),
        F.avg(ratio(F.col("volume"), F.col("_mean_vol"))).alias("volume_ratio"),
    )


def drop_short_series(df: DataFrame, keys: list[str], min_rows: int) -> DataFrame:
    """Keep groups with at least ``min_rows`` rows (counted by partial aggregation)."""
    keep = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows).drop("_n")
    return df.join(keep, keys, "left_semi")
