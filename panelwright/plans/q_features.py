"""Queries over engineered features: lags, derived columns, fills, panels, standardisation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions import cleaning as cl
from panelwright.functions import periods as pr
from panelwright.functions import rules as ru
from panelwright.operators import features as ft
from panelwright.operators import reports as rp
from panelwright.plans import views as v
from panelwright.plans.registry import near_sql, query, round_sql, rounded
from panelwright.plans.sqlviews import sql, view

STOCK = ["monthly_return", "monthly_volatility", "rsi", "volume_ratio", "sentiment_mean", "pe", "market_cap", "vix", "consensus_count"]

view("stock", ["panel"], "SELECT isin, period, " + ", ".join(f"max({c}) AS {c}" for c in STOCK) + " FROM panel GROUP BY isin, period")


def stock(spark, sf):
    return ft.stock_frame(v.panel(spark, sf), STOCK)


@query("stock_lags", sql("""
    SELECT isin, period, """ + ", ".join(
        f"{near_sql(f'lag({c}, {k}) OVER (PARTITION BY isin ORDER BY period)', 4)} AS {c}_lag{k}"
        for k in (1, 2, 3, 6) for c in ("monthly_return", "rsi", "pe")) + " FROM stock", "stock"))
def stock_lags(spark, sf):
    """Lags on the unique stock-month frame (WN1)."""
    df = ft.add_lags(stock(spark, sf), ["isin"], "period", ["monthly_return", "rsi", "pe"], [1, 2, 3, 6])
    return rounded(df.select("isin", "period", *[c for c in df.columns if "_lag" in c]), 4)


@query("derived_features", sql("""
    WITH r AS (SELECT *, lag(monthly_return) OVER w AS r1, lag(monthly_return, 2) OVER w AS r2,
        CASE WHEN count(monthly_return) OVER w3 >= 2 THEN stddev_samp(monthly_return) OVER w3 END AS volatility_3m,
        count(monthly_return) OVER w3 AS n3
      FROM stock WINDOW w AS (PARTITION BY isin ORDER BY period), w3 AS (PARTITION BY isin ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    m AS (SELECT *, CASE WHEN n3 >= 2 THEN (1 + coalesce(monthly_return, 0)) * (1 + coalesce(r1, 0)) * (1 + coalesce(r2, 0)) - 1 END AS momentum_3m FROM r)
    SELECT isin, period, round(momentum_3m, 4) + 0.0::DOUBLE AS momentum_3m, round(volatility_3m, 4) AS volatility_3m,
      round(pe * momentum_3m, 3) + 0.0::DOUBLE AS pe_x_momentum, round(rsi * momentum_3m, 3) + 0.0::DOUBLE AS rsi_x_momentum,
      round(vix * monthly_return, 3) + 0.0::DOUBLE AS vix_x_return, round(sentiment_mean * momentum_3m, 4) + 0.0::DOUBLE AS sentiment_x_momentum,
      round(ln(1 + greatest(market_cap, 0)), 6) AS log_market_cap, CASE WHEN pe IS NOT NULL THEN round(ln(1 + greatest(pe, 0)), 6) END AS log_pe,
      CASE WHEN monthly_volatility IS NOT NULL THEN round(sqrt(greatest(monthly_volatility, 0)), 4) END AS sqrt_volatility,
      CASE WHEN volume_ratio IS NOT NULL THEN round(ln(1 + greatest(volume_ratio, 0)), 4) END AS log_volume_ratio
    FROM m""".replace("round(ln(1 + greatest(market_cap, 0)), 6)", "CASE WHEN market_cap IS NOT NULL THEN round(ln(1 + greatest(market_cap, 0)), 6) END"), "stock"))
def derived_features(spark, sf):
    """Rolling return and deviation, interactions, log and root transforms (WN18, WN19, PRJ9, PRJ10)."""
    w = W.partitionBy("isin").orderBy("period")
    df = stock(spark, sf)
    df = df.withColumns(
        {"momentum_3m": ft.rolling_return(F.col("monthly_return"), w), "volatility_3m": ft.rolling_std(F.col("monthly_return"), w)}
    )
    df = df.withColumns(
        ft.interactions(
            {
                "pe_x_momentum": ("pe", "momentum_3m"),
                "rsi_x_momentum": ("rsi", "momentum_3m"),
                "vix_x_return": ("vix", "monthly_return"),
                "sentiment_x_momentum": ("sentiment_mean", "momentum_3m"),
            }
        )
    ).withColumns(ft.nonlinear())
    digits = {
        "momentum_3m": 4, "volatility_3m": 4, "pe_x_momentum": 3, "rsi_x_momentum": 3, "vix_x_return": 3,
        "sentiment_x_momentum": 4, "log_market_cap": 6, "log_pe": 6, "sqrt_volatility": 4, "log_volume_ratio": 4,
    }
    return df.select("isin", "period", *[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in digits.items()])


@query("allocation_features", sql("""
    SELECT fund, isin, period, round(pct_nav - lag(pct_nav) OVER (PARTITION BY fund, isin ORDER BY period), 6) + 0.0::DOUBLE AS allocation_momentum,
      round(pct_nav * sentiment_mean, 5) + 0.0::DOUBLE AS alloc_x_sentiment,
      round(pe / nullif(median(pe) OVER (PARTITION BY sector, period), 0), 6) AS pe_relative FROM panel""", "panel"))
def allocation_features(spark, sf):
    """First difference, conviction product, value relative to the sector median (WN17, PRJ9, PRJ11, WN20)."""
    p = v.panel(spark, sf).select("fund", "isin", "period", "sector", "pct_nav", "sentiment_mean", "pe")
    w = W.partitionBy("fund", "isin").orderBy("period")
    p = ft.relative_to_median(p, ["sector", "period"], "pe", "pe_relative")
    return p.select(
        "fund", "isin", "period",
        (F.round(F.col("pct_nav") - F.lag("pct_nav").over(w), 6) + F.lit(0.0)).alias("allocation_momentum"),
        (F.round(F.col("pct_nav") * F.col("sentiment_mean"), 5) + F.lit(0.0)).alias("alloc_x_sentiment"),
        F.round("pe_relative", 6).alias("pe_relative"),
    )


_GAPS = """
    WITH g AS (SELECT isin, period, row_number() OVER (PARTITION BY isin ORDER BY period) AS pos,
        CASE WHEN (CAST(substr(isin, 4, 3) AS INT) * 7 + CAST(substr(period, 6, 2) AS INT) * 3) % 11 < 4 THEN pe END AS pe FROM stock),
    k AS (SELECT *, last_value(pe IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN pe IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS p0,
        first_value(pe IGNORE NULLS) OVER n AS v1, first_value(CASE WHEN pe IS NOT NULL THEN pos END IGNORE NULLS) OVER n AS p1 FROM g
      WINDOW p AS (PARTITION BY isin ORDER BY pos ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY isin ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    l AS (SELECT isin, period, pos, coalesce(pe, CASE WHEN pos - p0 <= 3 OR p1 - pos <= 3 THEN v0 + (v1 - v0) * (pos - p0) / nullif(p1 - p0, 0) END) AS pe FROM k),
    f AS (SELECT *, last_value(pe IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN pe IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS p0 FROM l
      WINDOW p AS (PARTITION BY isin ORDER BY pos ROWS UNBOUNDED PRECEDING))"""


@query("gap_fill", sql(_GAPS + """
    SELECT isin, period, """ + near_sql("coalesce(pe, CASE WHEN pos - p0 <= 3 THEN v0 END)", 5) + """ AS pe FROM f""", "stock"))
def gap_fill(spark, sf):
    """Linear interpolation inside gaps and capped carry forward per stock (WN25)."""
    seen = (F.substring("isin", 4, 3).cast("int") * 7 + F.substring("period", 6, 2).cast("int") * 3) % 11 < 4
    df = stock(spark, sf).select("isin", "period", F.when(seen, F.col("pe")).alias("pe"))
    return rounded(ft.interpolate(df, ["isin"], "period", ["pe"]), 5)


@query("gap_fill_both_ways", sql(_GAPS + """,
    o AS (SELECT isin, period, pos, coalesce(pe, CASE WHEN pos - p0 <= 3 THEN v0 END) AS pe FROM f),
    b AS (SELECT *, first_value(pe IGNORE NULLS) OVER n AS v1, first_value(CASE WHEN pe IS NOT NULL THEN pos END IGNORE NULLS) OVER n AS p1 FROM o
      WINDOW n AS (PARTITION BY isin ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT isin, period, """ + near_sql("coalesce(pe, CASE WHEN p1 - pos <= 3 THEN v1 END)", 5) + """ AS pe FROM b""", "stock"))
def gap_fill_both_ways(spark, sf):
    """As gap_fill, and what is still open at the start of a series is carried backward (WN25)."""
    seen = (F.substring("isin", 4, 3).cast("int") * 7 + F.substring("period", 6, 2).cast("int") * 3) % 11 < 4
    df = stock(spark, sf).select("isin", "period", F.when(seen, F.col("pe")).alias("pe"))
    return rounded(ft.interpolate(df, ["isin"], "period", ["pe"], back=True), 5)


@query("period_split", sql("""
    WITH p AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT period FROM panel))
    SELECT split, count(*) AS n_rows, min(period) AS first_period, max(period) AS last_period FROM (
      SELECT p.period, CASE WHEN i < floor(n * 0.65) THEN 'train' WHEN i < floor(n * 0.82 + 1e-9) THEN 'validation' ELSE 'test' END AS split FROM panel JOIN p USING (period))
    GROUP BY split""", "panel"))
def period_split(spark, sf):
    """Temporal train / validation / test split (WN26)."""
    return ft.add_split(v.panel(spark, sf).select("period")).groupBy("split").agg(
        F.count("*").alias("n_rows"), F.min("period").alias("first_period"), F.max("period").alias("last_period")
    )


_SEC = ["pct_nav", "monthly_return", "monthly_volatility", "rsi", "volume_ratio", "sentiment_mean", "pe", "pb", "eps", "market_cap"]


@query("sector_panel", sql("SELECT sector, period, " + ", ".join(f"{near_sql(f'avg({c})', 4)} AS {c}" for c in _SEC)
       + ", count(DISTINCT isin) AS stock_count FROM panel GROUP BY sector, period", "panel"))
def sector_panel(spark, sf):
    """Sector means and breadth (AG11)."""
    return rounded(ft.group_panel(v.panel(spark, sf), ["sector", "period"], _SEC, "isin", "stock_count"), 4)


_FUND = ["pct_nav", "monthly_return", "monthly_volatility", "rsi", "sentiment_mean", "pe", "pb"]


@query("fund_panel", sql("SELECT fund, period, " + ", ".join(f"{near_sql(f'avg({c})', 4)} AS {c}" for c in _FUND)
       + ", count(DISTINCT isin) AS holdings_count FROM panel GROUP BY fund, period", "panel"))
def fund_panel(spark, sf):
    """Fund means and number of holdings (AG12)."""
    return rounded(ft.group_panel(v.panel(spark, sf), ["fund", "period"], _FUND, "isin", "holdings_count"), 4)


@query("frequent_stock_panel", sql("""
    WITH t AS (SELECT isin FROM panel GROUP BY isin ORDER BY count(*) DESC, isin LIMIT 10)
    SELECT isin, period, """ + ", ".join(f"{near_sql(f'avg({c})', 4)} AS {c}" for c in ("pct_nav", "quantity", "holding_tenure", "pe")) + """ FROM panel WHERE isin IN (SELECT isin FROM t) GROUP BY isin, period""", "panel"))
def frequent_stock_panel(spark, sf):
    """Most held stocks only, means per month (AG13, TOP3)."""
    return rounded(ft.frequent_panel(v.panel(spark, sf), "isin", ["pct_nav", "quantity", "holding_tenure", "pe"], 10), 4)


_ZV = ["rsi", "pe", "pct_nav", "flat", "none"]


@query("zero_variance", sql("""
    SELECT column_name, constant FROM (SELECT """ + ", ".join(
        f"CASE WHEN count(DISTINCT {c}) <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {c}" for c in _ZV)
    + " FROM (SELECT *, 7.0::DOUBLE AS flat, NULL::DOUBLE AS none FROM panel)) UNPIVOT (constant FOR column_name IN (" + ", ".join(_ZV) + "))", "panel"))
def zero_variance(spark, sf):
    """Columns without information (AG17)."""
    p = v.panel(spark, sf).withColumns({"flat": F.lit(7.0), "none": F.lit(None).cast("double")})
    return rp.zero_variance(p, _ZV)


_CORR = ["pct_nav", "quantity", "market_value", "holding_tenure", "consensus_count", "rsi", "monthly_return", "pe", "sentiment_mean", "vix"]


@query("correlation_pairs", sql(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0::DOUBLE AS r FROM panel" for i, a in enumerate(_CORR) for b in _CORR[i + 1:]), "panel"))
def correlation_pairs(spark, sf):
    """Pairwise-complete correlation table in one pass (AG18)."""
    return rounded(ft.correlation_pairs(v.panel(spark, sf), _CORR))


@query("pruned_feature_panel")
def pruned_feature_panel(spark, sf):
    """Panel after dropping constant and redundant columns (AG17, AG18 greedy pass)."""
    p = v.panel(spark, sf).withColumn("weight_copy", F.col("pct_nav") * 2)
    cols = [*_CORR, "weight_copy", "repo_rate", "cpi"]
    p = rp.drop_zero_variance(p.select("fund", "isin", "period", *cols), cols)
    return ft.prune_correlated(p, [c for c in cols if c in p.columns], 0.95, {"pct_nav", "consensus_count", "holding_tenure"})


_Z = ["pct_nav", "quantity", "rsi", "monthly_return", "pe", "consensus_count"]


@query("zscore_train", sql("""
    WITH p AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT period FROM panel)),
    s AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _Z) + """
          FROM panel JOIN p USING (period) WHERE i < floor(n * 0.65))
    SELECT fund, isin, period, """ + ", ".join(f"{near_sql(f'({c} - m_{c}) / s_{c}', 5)} AS {c}" for c in _Z) + " FROM panel, s", "panel"))
def zscore_train(spark, sf):
    """Standardised with statistics of the training periods only (AG19)."""
    p = v.panel(spark, sf).select("fund", "isin", "period", *_Z)
    cut = ft.period_cuts(p, [ft.TRAIN_SHARE])[0]
    return rounded(ft.apply_zscore(p, ft.fit_zscore(p.where(F.col("period") < cut), _Z)), 5)


@query("zscore_stats", sql("""
    WITH p AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT period FROM panel)),
    t AS (SELECT panel.* FROM panel JOIN p USING (period) WHERE i < floor(n * 0.65))
    """ + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {near_sql(f'avg({c})', 4)} AS mean, {near_sql(f'stddev_samp({c})', 4)} AS std FROM t" for c in _Z), "panel"))
def zscore_stats(spark, sf):
    """The stored statistics (AG19)."""
    p = v.panel(spark, sf).select("period", *_Z)
    cut = ft.period_cuts(p, [ft.TRAIN_SHARE])[0]
    return rounded(ft.fit_zscore(p.where(F.col("period") < cut), _Z), 4)


_WIN = ["quantity", "market_value", "pe", "pct_nav"]


@query("winsorised", sql("WITH q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in _WIN) + " FROM panel) "
       "SELECT fund, isin, period, " + ", ".join(f"{near_sql(f'CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo_{c}), hi_{c}) END', 5)} AS {c}" for c in _WIN) + " FROM panel, q", "panel"))
def winsorised(spark, sf):
    """Columns clamped at their exact 1st and 99th percentile (AG20)."""
    p = v.panel(spark, sf).select("fund", "isin", "period", *_WIN)
    return rounded(ft.winsorise(p, ft.winsor_bounds(p, _WIN, 0.01, 0.99)), 5)


@query("month_encoding", f"""
    WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM orders GROUP BY 1)
    SELECT period, n, {near_sql("sin(2 * pi() * CAST(substr(period, 6, 2) AS INT) / 12)")} AS month_sin,
      {near_sql("cos(2 * pi() * CAST(substr(period, 6, 2) AS INT) / 12)")} AS month_cos,
      {near_sql("(row_number() OVER (ORDER BY period) - 1) / greatest(count(*) OVER () - 1, 1)::DOUBLE")} AS month_index FROM m""")
def month_encoding(spark, sf):
    """Cyclic month and normalised index (PRJ12)."""
    m = v.table(spark, sf, "orders").groupBy(pr.period_key(F.col("o_orderdate")).alias("period")).agg(F.count("*").alias("n"))
    s, c = pr.cyclic_month(F.col("period"))
    w = W.orderBy("period")  # one row per calendar month
    last = F.greatest(F.count("*").over(W.partitionBy(F.lit(1))) - 1, F.lit(1))
    return rounded(m.withColumns({"month_sin": s, "month_cos": c, "month_index": (F.row_number().over(w) - 1) / last}))


_VARS = {"view": "rsi_lag2", "click": "india_vix_close_lag1", "purchase": "sentiment_mean", "signup": "real_interest_rate_lag3", "error": "eps"}


@query("variable_groups", f"""
    WITH e AS (SELECT CASE event_type {' '.join(f"WHEN '{k}' THEN '{x}'" for k, x in _VARS.items())} END || CASE WHEN user_id % 3 = 0 THEN '_ALLOC' ELSE '' END AS name, value FROM events)
    SELECT name, {ru.rules_sql('lower(name)', ru.VARIABLE_GROUP_RULES, 'other')} AS var_group, {ru.rules_sql('lower(name)', ru.VARIABLE_FAMILY_RULES, 'unknown')} AS family,
      regexp_replace(name, '_lag[0-9]+$', '') AS base, count(*) AS n FROM e GROUP BY ALL""")
def variable_groups(spark, sf):
    """Variable name groups and base names (PRJ6, PRJ14)."""
    e = v.table(spark, sf, "events")
    name = F.concat(cl.to_map(_VARS, F.col("event_type")), F.when(F.col("user_id") % 3 == 0, F.lit("_ALLOC")).otherwise(F.lit("")))
    n = F.col("name")
    return e.groupBy(name.alias("name")).agg(F.count("*").alias("n")).withColumns(
        {"var_group": ru.variable_group(n), "family": ru.variable_family(n), "base": cl.strip_lag(n)}
    )


@query("sanitised_numbers", """
    SELECT event_type, count(*) AS n, count(CASE WHEN value >= 50 THEN 1 END) AS finite_roots, count(CASE WHEN value <= 200 THEN 1 END) AS finite_exp,
      round(sum(CASE WHEN value >= 50 THEN sqrt(value - 50) ELSE 0 END), 4) AS root_sum FROM events GROUP BY event_type""")
def sanitised_numbers(spark, sf):
    """NaN and infinity to missing, missing to zero (PRJ15)."""
    e = v.table(spark, sf, "events").select(
        "event_type", F.sqrt(F.col("value") - 50).alias("root"),
        F.when(F.col("value") > 200, F.lit(float("inf"))).otherwise(F.col("value")).alias("grown"),
    )
    e = cl.finite_columns(e, ["root", "grown"])
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("root").alias("finite_roots"), F.count("grown").alias("finite_exp"),
        F.round(F.sum(F.coalesce("root", F.lit(0.0))), 4).alias("root_sum"),
    )


@query("sorted_panel", sql("SELECT fund, isin, period, pct_nav FROM panel ORDER BY fund, isin, period", "panel"))
def sorted_panel(spark, sf):
    """Final multi-key order (SRT1)."""
    return v.panel(spark, sf).select("fund", "isin", "period", "pct_nav").orderBy("fund", "isin", "period")
