"""Coverage, distribution and audit reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage_band(pct: Column) -> Column:
    return (
        F.when(pct >= 80, F.lit("high")).when(pct >= 50, F.lit("medium")).when(pct > 0, F.lit("low")).otherwise(F.lit("empty"))
    )


def unpivot_row(df: DataFrame, cols: list[str], name: str, value: str) -> DataFrame:
    """A wide aggregate row to (name, value) rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols]))
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, pairs.alias("_p")).select(*keep, f"_p.{name}", f"_p.{value}")


def coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """Percent of non-NULL values and its band for every column, one pass."""
    row = df.agg(*[(100.0 * F.count(c) / F.greatest(F.count("*"), F.lit(1))).alias(c) for c in cols])
    return unpivot_row(row, cols, "column_name", "pct").withColumn("band", coverage_band(F.col("pct")))


def distribution(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts and percent of total per category."""
    counts = df.groupBy(*cols).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / counts.agg(F.sum("n")).scalar())


def zero_variance(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns that carry no information: constant or at most one distinct value."""
    row = df.agg(
        *[
            F.when(F.coalesce(F.min(c) == F.max(c), F.lit(True)), 1.0).otherwise(0.0).alias(c)
            for c in cols
        ]
    )
    return unpivot_row(row, cols, "column_name", "constant")


def drop_zero_variance(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop the constant ones among ``cols`` (one aggregate decides)."""
    row = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if row[c]])


def authenticity_audit(raw: DataFrame, ready: DataFrame, entity: str, keys: list[str], value: str) -> DataFrame:
    """Per entity: first month with a true value, first delivered month, share of rows without a true value."""
    starts = raw.where(F.col(value).isNotNull()).groupBy(entity).agg(F.min("period").alias("true_start"))
    checked = ready.select(*keys).join(raw.select(*keys, value), keys, "left")
    filled = checked.groupBy(entity).agg(
        F.min("period").alias("ready_start"),
        F.count("*").alias("n_ready"),
        F.count(F.when(F.col(value).isNull(), 1)).alias("n_synthetic"),
    )
    return starts.join(filled, entity).withColumns(
        {
            "backfilled": F.col("ready_start") < F.col("true_start"),
            "synthetic_pct": F.round(100.0 * F.col("n_synthetic") / F.col("n_ready"), 6),
        }
    )
