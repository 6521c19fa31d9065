"""Panel Granger evidence: pooled panel, autoregressive order, sweep, regimes, summaries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.encodings import signed_action
from panelwright.functions.cleaning import to_map
from panelwright.operators import regression as rg
from panelwright.operators import skew
from panelwright.operators.macro import union_all

# Explanatory groups of the sweep.
CAUSE_GROUPS = {
    "price_momentum": ["monthly_return", "rsi", "momentum_3m", "bollinger_pband"],
    "trend": ["macd_hist"],
    "risk": ["monthly_volatility", "volume_ratio"],
    "position_size": ["pct_nav", "holding_tenure"],
    "herding": ["consensus_count"],
    "sentiment": ["sentiment_mean"],
    "macro_equity": ["nifty50_return", "india_vix_close", "index_return", "vix"],
    "macro_rates": ["cpi_inflation", "us_10y_yield", "cpi"],
}
TARGETS = ["action_ordinal", "buy_ratio", "sell_ratio"]
FDR_LEVEL = 0.05
MIN_OBS = 500
MAX_AR = 4


def cause_group(c: Column) -> Column:
    return to_map({v: g for g, vs in CAUSE_GROUPS.items() for v in vs}, c, "other")


def pooled_panel(
    df: DataFrame, stock_cols: list[str], fund_cols: list[str], macro_cols: list[str], news_floor: float | None = None, by: list[str] = ()
) -> DataFrame:
    """Funds pooled to one row per stock and month (and per stratum ``by``).

    Decisions become mean and shares, stock and macro columns the first known
    value by fund order, fund columns the mean; sentiment of thin months is missing.
    """
    a = signed_action(F.col("position_action"))

    def first(c: str) -> Column:
        return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("fund"))).alias(c)

    pooled = df.where(a.isNotNull()).groupBy(*by, "isin", "period").agg(
        F.avg(a.cast("double")).alias("action_ordinal"),
        F.avg((a == 1).cast("double")).alias("buy_ratio"),
        F.avg((a == -1).cast("double")).alias("sell_ratio"),
        F.count("*").alias("n_funds"),
        *[first(c) for c in [*stock_cols, *macro_cols, "sentiment_mean", "news_count"]],
        *[F.avg(c).alias(c) for c in fund_cols],
    )
    if news_floor is not None:
        thin = F.col("news_count") < news_floor
        pooled = pooled.withColumn("sentiment_mean", F.when(thin, F.lit(None)).otherwise(F.col("sentiment_mean")))
    return pooled.drop("news_count")


def add_regimes(pooled: DataFrame, market: str, volatility: str, inflation: str) -> DataFrame:
    """0/1 market states per month: rising market, above-median volatility and inflation."""
    months = pooled.groupBy("period").agg(F.max(market).alias("m"), F.max(volatility).alias("v"), F.max(inflation).alias("c"))
    mid = months.agg(F.median("v").alias("mv"), F.median("c").alias("mc"))  # over months, not rows
    flags = months.select(
        "period",
        F.when(F.col("m") > 0, 1.0).otherwise(0.0).alias("regime_bull"),
        F.when(F.col("v") > mid.select("mv").scalar(), 1.0).otherwise(0.0).alias("regime_hvix"),
        F.when(F.col("c") > mid.select("mc").scalar(), 1.0).otherwise(0.0).alias("regime_hcpi"),
    )
    return pooled.join(F.broadcast(flags), "period", "left")


def ar_order_table(panel: DataFrame, target: str, max_order: int = MAX_AR, min_obs: int = 100) -> DataFrame:
    """Sample size and moments of the autoregression of each order (lags stay inside the entity)."""
    w = W.partitionBy("isin").orderBy("period")
    y = rg.demean(panel.select("isin", "period", F.col(target).alias("y")).dropna(), "isin", ["y"])
    y = y.withColumns({f"a{k}": F.lag("y", k).over(w) for k in range(1, max_order + 1)})
    parts = []
    for order in range(1, max_order + 1):
        cols = ["y", *[f"a{k}" for k in range(1, order + 1)]]
        m = rg.cross_moments(y.dropna(subset=cols), [], cols)
        parts.append(m.select(F.lit(order).alias("ar_order"), "n", "s", "p"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("n") >= min_obs)


def select_ar_order(panel: DataFrame, target: str, max_order: int = MAX_AR) -> int:
    """Order with the lowest AIC (likelihood form with an intercept)."""
    best, order = math.inf, 1
    for r in ar_order_table(panel, target, max_order).collect():  # max_order rows
        _, rss = rg.ols_from_moments(r["n"], np.asarray(r["s"]), np.asarray(r["p"]))
        aic = r["n"] * (math.log(2 * math.pi * rss / r["n"]) + 1) + 2 * (r["ar_order"] + 1)
        if aic < best:
            best, order = aic, r["ar_order"]
    return order


KEYS = ["target", "cause", "lag"]


def hypothesis_rows(
    panel: DataFrame, targets: list[str], causes: list[str], lags: list[int], ar: int, extra: list[str] = ()
) -> DataFrame:
    """Long rows (target, cause, lag, y, x, a1..): all lags from one window, then one explode."""
    w = W.partitionBy("isin").orderBy("period")
    lagged = {f"_{c}_{k}": F.lag(c, k).over(w) if k else F.col(c) for c in causes for k in lags}
    ars = {f"_{t}_a{k}": F.lag(t, k).over(w) for t in targets for k in range(1, ar + 1)}
    df = panel.withColumns({**lagged, **ars})
    tests = F.array(
        *[
            F.struct(
                F.lit(t).alias("target"), F.col(t).cast("double").alias("y"),
                *[F.col(f"_{t}_a{k}").cast("double").alias(f"a{k}") for k in range(1, ar + 1)],
            )
            for t in targets
        ]
    )
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("cause"), F.lit(k).alias("lag"), F.col(f"_{c}_{k}").cast("double").alias("x"))
            for c in causes for k in lags
        ]
    )
    out = df.select("isin", "period", *extra, F.explode(tests).alias("_t"), cells.alias("_c"))
    out = out.select("isin", "period", *extra, "_t.*", F.explode("_c").alias("_h"))
    return out.select(*[c for c in out.columns if c != "_h"], "_h.cause", "_h.lag", "_h.x").where(
        (F.col("cause") != F.col("target")) & F.col("x").isNotNull() & F.col("y").isNotNull()
    )


def adjust_p(df: DataFrame, family: list[str], p: str = "p_value", level: float = FDR_LEVEL) -> DataFrame:
    """Benjamini-Hochberg adjusted p and rejection flag inside each family of tests.

    A family is a hypothesis list (hundreds of rows), never data rows.
    """
    tested = df.where(F.col(p).isNotNull())
    w = W.partitionBy(*family).orderBy(p, *[c for c in ("cause", "lag") if c in df.columns])
    n = F.count("*").over(W.partitionBy(*family))
    raw = F.col(p) * n / F.row_number().over(w)
    step = tested.withColumn("_raw", raw)
    after = w.rowsBetween(0, W.unboundedFollowing)
    return step.withColumn("p_fdr", F.least(F.min("_raw").over(after), F.lit(1.0))).withColumn(
        "significant", F.col("p_fdr") <= level
    ).drop("_raw")


def test_links(rows: DataFrame, ar: int, entities: Column, min_obs: int = MIN_OBS, extra: list[str] = ()) -> DataFrame:
    """One fixed-effects regression per (target, cause, lag): slope of x with autoregressive controls."""
    xs = ["x", *[f"a{k}" for k in range(1, ar + 1)], *extra]
    fit = rg.panel_ols(rows, KEYS, "isin", "y", xs, min_obs)
    t, k = F.element_at("t_stat", 1), len(xs)
    dof = F.greatest(F.col("n_obs") - k - entities, F.lit(1))
    out = fit.select(
        "target", "cause", cause_group(F.col("cause")).alias("cause_group"), "lag",
        F.when(F.col("lag") > 0, "causal").otherwise("association").alias("link_type"),
        F.element_at("beta", 1).alias("beta"), t.alias("t_stat"), F.element_at("p_value", 1).alias("p_value"),
        (t * t / (t * t + dof)).alias("partial_r2"), "n_obs", F.lit(ar).alias("ar_order"), "rsquared",
        (F.col("n_obs") / F.greatest(k + entities, F.lit(1))).alias("dof_ratio"),
        *[F.element_at(a, i + 1).alias(n) for a, n, i in _extra_columns(extra, ar)],
        F.col("beta").alias("_beta"), "rss",
    )
    return out.where(F.col("beta").isNotNull())


def _extra_columns(extra, ar: int):
    for j, _ in enumerate(extra):
        for a, n in (("beta", "interaction_beta"), ("t_stat", "interaction_t"), ("p_value", "interaction_p")):
            yield a, n, 1 + ar + j


def sweep(
    panel: DataFrame, targets: list[str], causes: list[str], lags: list[int], ar: dict[str, int], min_obs: int = MIN_OBS, with_dw: bool = False
) -> DataFrame:
    """All target x cause x lag tests with false discovery control per (target, link type).

    Targets that share an autoregressive order are fitted together in one job.
    """
    entities = panel.agg(F.countDistinct("isin")).scalar()
    parts = []
    for order in sorted({ar[t] for t in targets}):
        rows = hypothesis_rows(panel, [t for t in targets if ar[t] == order], causes, lags, order)
        links = test_links(rows, order, entities, min_obs)
        if with_dw:
            xs = ["x", *[f"a{k}" for k in range(1, order + 1)]]
            fitted = links.select(*KEYS, F.col("_beta").alias("beta"), "rss")
            dw = rg.within_durbin_watson(rows, KEYS, "isin", "period", "y", xs, fitted)
            links = links.join(dw, KEYS, "left").withColumn("dw_warning", F.col("dw_stat") < 1.5)
        parts.append(links.drop("_beta", "rss"))
    return adjust_p(union_all(parts), ["target", "link_type"])


def regime_interactions(panel: DataFrame, links: DataFrame, ar: dict[str, int], top: int = 30, min_obs: int = MIN_OBS) -> DataFrame:
    """Regime product term on the strongest significant causal links.

    The three regimes become part of the hypothesis key, so they share a job.
    """
    keep = links.where((F.col("link_type") == "causal") & F.col("significant"))
    keep = keep.orderBy(F.col("partial_r2").desc(), "target", "cause", "lag").limit(top)
    picked = [(r["target"], r["cause"], r["lag"]) for r in keep.select(*KEYS).collect()]
    entities = panel.agg(F.countDistinct("isin")).scalar()
    flags = ["regime_bull", "regime_hvix", "regime_hcpi"]
    parts = []
    for order in sorted({ar[t] for t, _, _ in picked}):
        mine = [h for h in picked if ar[h[0]] == order]
        names = [sorted({h[i] for h in mine}) for i in range(3)]
        wanted = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(c).alias("cause"), F.lit(k).alias("lag")) for t, c, k in mine])
        rows = hypothesis_rows(panel, names[0], names[1], names[2], order, flags)
        rows = rows.where(F.array_contains(wanted, F.struct(*KEYS)))
        state = F.explode(F.array(*[F.struct(F.lit(f).alias("regime"), F.col(f).alias("on")) for f in flags]))
        rows = rows.withColumn("_s", state).withColumns(
            {"x_regime": F.col("x") * F.col("_s.on"), "target": F.concat_ws("|", "target", "_s.regime")}
        )
        fit = test_links(rows, order, entities, min_obs, ["x_regime"]).drop("_beta", "rss")
        parts.append(fit)
    out = union_all(parts) if parts else None
    if out is None:
        return links.limit(0)
    return out.withColumns(
        {
            "regime": F.split_part("target", F.lit("|"), F.lit(2)),
            "target": F.split_part("target", F.lit("|"), F.lit(1)),
            "interaction_significant": F.col("interaction_p") < 0.05,
        }
    )


def best_per_group(links: DataFrame) -> DataFrame:
    """Strongest significant link per target, cause group and link type."""
    sig = links.where(F.col("significant"))
    return skew.keep_one(sig, ["target", "cause_group", "link_type"], [F.col("partial_r2").desc(), F.col("cause"), F.col("lag")])


def top_per_target(links: DataFrame, k: int = 12) -> DataFrame:
    return skew.top_k(best_per_group(links), ["target"], [F.col("partial_r2").desc(), F.col("cause"), F.col("lag")], k)


def driver_importance(links: DataFrame) -> DataFrame:
    """Mean absolute t of the significant causal links per cause."""
    sig = links.where(F.col("significant") & (F.col("link_type") == "causal"))
    return sig.groupBy("cause").agg(F.avg(F.abs("t_stat")).alias("mean_abs_t"), F.count("*").alias("n_links"))


def all_links(links: DataFrame) -> DataFrame:
    """Links in the shape the graph layer reads."""
    return links.withColumns(
        {
            "stratum": F.lit("pooled"),
            "effect": F.col("target"),
            "edge_type": F.when(F.col("link_type") == "causal", "GRANGER_CAUSES").otherwise("ASSOCIATED_WITH"),
            "strength": F.col("t_stat"),
        }
    )


def rank_links(links: DataFrame) -> DataFrame:
    """Result order: link type, significant first, target, absolute t."""
    return links.orderBy(F.asc("link_type"), F.desc("significant"), F.asc("target"), F.abs("t_stat").desc())
