"""Holdings: cleaning, decision classification, holding periods, exits, panel features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions import cleaning as cl
from panelwright.functions import periods as pr
from panelwright.functions.rules import industry_sector
from panelwright.operators import skew
from panelwright.session import require_columns

# Rule thresholds of the decision classifier.
MAX_GAP = 3
QUANTITY_STEP = 0.005
WEIGHT_STEP = 0.1
QUANTITY_SHARE = 0.3


def clean_holdings(raw: DataFrame, id_prefix: str = "INE") -> DataFrame:
    """Raw text rows to one typed row per (fund, isin, period), latest date kept."""
    require_columns(raw, ["fund", "isin", "date", "pct_nav"])
    typed = {
        "date": pr.parse_day_first(F.col("date")),
        "isin": F.trim("isin"),
        "pct_nav": cl.to_number(F.col("pct_nav")),
    }
    for c in ("market_value", "quantity"):
        if c in raw.columns:
            typed[c] = cl.to_number(F.col(c))
    df = raw.withColumns(typed)
    df = df.where(F.col("date").isNotNull() & F.startswith("isin", F.lit(id_prefix)) & (F.col("pct_nav") > 0))
    sector = industry_sector(F.col("industry")) if "industry" in raw.columns else F.lit("OTHERS")
    df = df.withColumns(
        {"sector": sector, "period": pr.period_key(F.col("date")), "month_ord": pr.month_ordinal(F.col("date"))}
    )
    ties = [F.col(c).desc() for c in ("market_value", "quantity", "pct_nav") if c in df.columns]
    return skew.keep_one(df, ["fund", "isin", "period"], [F.col("date").desc(), *ties])


def quantity_usable(df: DataFrame, share: float = QUANTITY_SHARE) -> bool:
    """True when more than ``share`` of the quantities are present."""
    got = df.agg((F.count("quantity") / F.greatest(F.count("*"), F.lit(1))).alias("s")).first()[0]
    return got is not None and got > share


def _series() -> "W":
    """Windows over one (fund, isin) series; its length is bounded by the calendar."""
    return W.partitionBy("fund", "isin").orderBy("month_ord")


def classify_positions(df: DataFrame, max_gap: int = MAX_GAP, use_quantity: bool = True) -> DataFrame:
    """Label every row INITIAL_POSITION / BUY / SELL / HOLD and add period id and tenure.

    One shuffle on (fund, isin): all windows share that partitioning and order.
    """
    require_columns(df, ["fund", "isin", "period", "month_ord", "pct_nav"])
    w = _series()
    qty = F.col("quantity") if use_quantity else F.lit(None).cast("double")
    df = df.withColumns(
        {
            "_prev_ord": F.lag("month_ord").over(w),
            "_prev_nav": F.lag("pct_nav").over(w),
            "_prev_qty": F.lag(qty).over(w),
        }
    )
    df = df.withColumns(
        {
            "month_gap": F.col("month_ord") - F.col("_prev_ord"),
            "quantity_change": qty - F.col("_prev_qty"),
            "_change": F.col("pct_nav") - F.col("_prev_nav"),
        }
    )
    initial = F.col("_prev_ord").isNull() | (F.col("month_gap") > max_gap)
    moved = F.when(F.col("_prev_qty") > 0, F.abs("quantity_change") / F.col("_prev_qty") > QUANTITY_STEP)
    moved = F.coalesce(moved, F.lit(False))
    action = (
        F.when(initial, F.lit("INITIAL_POSITION"))
        .when(moved & (F.col("quantity_change") > 0), F.lit("BUY"))
        .when(moved & (F.col("quantity_change") < 0), F.lit("SELL"))
        .when(F.col("_change") > WEIGHT_STEP, F.lit("BUY"))
        .when(F.col("_change") < -WEIGHT_STEP, F.lit("SELL"))
        .otherwise(F.lit("HOLD"))
    )
    df = df.withColumn("position_action", action)
    is_initial = F.col("position_action") == "INITIAL_POSITION"
    df = df.withColumns(
        {
            "size": F.when(is_initial, F.col("pct_nav")).otherwise(F.abs("_change")),
            "allocation_change": F.when(is_initial, F.col("pct_nav")).otherwise(F.col("_change")),
            "_period_no": F.sum(is_initial.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)),
            "_row": F.row_number().over(w),
        }
    )
    # Rows since the holding period opened: the row number of its INITIAL row carried forward.
    opened = F.max(F.when(is_initial, F.col("_row"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumns(
        {
            "holding_period_id": F.concat_ws("|", "fund", "isin", F.col("_period_no").cast("string")),
            "holding_tenure": (F.col("_row") - opened + 1).cast("int"),
        }
    )
    return df.drop("_prev_ord", "_prev_nav", "_prev_qty", "_change", "_period_no", "_row")


def detect_exits(df: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Rows after which a fund stops holding a stock for more than ``max_gap`` months."""
    df = df.withColumn("_next_ord", F.lead("month_ord").over(_series()))
    df = skew.join_group_totals(df, ["fund"], {"_fund_last": F.max("month_ord")})
    gone = F.coalesce(F.col("_next_ord"), F.col("_fund_last")) - F.col("month_ord") > max_gap
    return df.where(gone).select(
        "fund",
        "isin",
        "sector",
        F.col("period").alias("exit_month"),
        F.col("pct_nav").alias("last_pct_nav"),
        F.col("quantity").alias("last_quantity"),
        "holding_tenure",
    )


def add_breadth(df: DataFrame) -> DataFrame:
    """Fund breadth, sector weight and consensus from three pre-aggregations.

    (fund, isin, period) is unique, so a row count is a distinct count.
    """
    df = skew.join_group_totals(df, ["fund", "period"], {"fund_stock_count": F.count("*")})
    df = skew.join_group_totals(df, ["fund", "period", "sector"], {"sector_weight": F.sum("pct_nav")})
    return skew.join_group_totals(df, ["isin", "period"], {"consensus_count": F.count("*")})


def add_rank(df: DataFrame, top: int = 10) -> DataFrame:
    """Rank of the weight inside the fund and month, and the top-ten flag."""
    df = skew.rank_descending(df, ["fund", "period"], "pct_nav", "rank_in_fund")
    return df.withColumn("is_top10", (F.col("rank_in_fund") <= top).cast("int"))


def add_quintile(df: DataFrame) -> DataFrame:
    """Weight quintile inside the fund and month; 3 for the whole group if bin edges repeat."""
    edges = skew.quantiles(df, ["fund", "period"], "pct_nav", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], "_edges")
    edges = edges.withColumn("_edges", F.transform("_edges", lambda e: F.round(e, 9)))
    df = skew.join_null_safe(df, edges, ["fund", "period"], "left")
    distinct = F.size(F.array_distinct("_edges")) == 6
    v = F.col("pct_nav")
    inner = F.size(F.filter(F.slice("_edges", 2, 4), lambda e: e < v)) + 1
    return df.withColumn("allocation_quintile", F.when(distinct, inner).otherwise(3).cast("int")).drop("_edges")


def modal_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key, smallest value on ties."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    return skew.keep_one(counts, [key], [F.col("_n").desc(), F.col(value).asc()]).drop("_n")
