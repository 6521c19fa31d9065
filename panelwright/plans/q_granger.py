"""Queries over panel regression evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import granger as gr
from panelwright.operators import graph as gp
from panelwright.operators import regression as rg
from panelwright.operators import sweep as sw
from panelwright.plans import views as v
from panelwright.plans.registry import near, near_sql, query, round_sql, rounded
from panelwright.plans.sqlviews import FUND_VARS, MACRO_VARS, STOCK_VARS, sql, view

_POOL = ["action_ordinal", "buy_ratio", "sell_ratio", *FUND_VARS, "sentiment_mean", *STOCK_VARS]


@query("pooled_panel", sql(f"SELECT isin, period, n_funds, regime_bull, regime_hvix, regime_hcpi, index_return, vix, cpi, {round_sql(_POOL, 4)} FROM pooled", "pooled"))
def pooled_panel(spark, sf):
    """Decisions pooled per stock and month with market states (AG14, AG15)."""
    p = gr.add_regimes(gr.pooled_panel(v.panel(spark, sf), v.STOCK_VARS, v.FUND_VARS, v.MACRO_VARS, 10), "index_return", "vix", "cpi")
    return p.withColumns({c: near(c, 4) for c in _POOL})


@query("entity_demeaned", sql(f"""
    SELECT isin, period, {near_sql('action_ordinal - avg(action_ordinal) OVER (PARTITION BY isin)')} AS action_ordinal,
      {near_sql('pct_nav - avg(pct_nav) OVER (PARTITION BY isin)')} AS pct_nav FROM pooled""", "pooled"))
def entity_demeaned(spark, sf):
    """Within transform (WN27)."""
    return rounded(rg.demean(v.pooled(spark, sf).select("isin", "period", "action_ordinal", "pct_nav"), "isin", ["action_ordinal", "pct_nav"]))


_LINK = "beta t_stat p_value p_fdr partial_r2 rsquared"


@query("panel_links", sql(f"SELECT target, cause, cause_group, lag, link_type, n_obs, significant, {round_sql(_LINK, 5)} FROM links", "links"))
def panel_links(spark, sf):
    """Fixed-effects slope, clustered t, p, false discovery control for every target, cause and lag (CS1, JN19, WN28)."""
    l = gr.sweep(v.pooled(spark, sf), gr.TARGETS, v.CAUSES, v.LAGS, {t: 0 for t in gr.TARGETS}, min_obs=100)
    return rounded(l.select("target", "cause", "cause_group", "lag", "link_type", "n_obs", "significant", *_LINK.split()), 5)


_AR = " UNION ALL ".join(
    f"SELECT {k} AS ar_order, count(*) AS n, round(sum(y * y), 4) AS yy, round(sum(y * a{k}), 4) AS y_last, round(sum(a{k} * a{k}), 4) AS last_last FROM l WHERE "
    + " AND ".join(f"a{i} IS NOT NULL" for i in range(1, k + 1)) for k in range(1, 5))


@query("autoregressive_orders", sql("""
    WITH d AS (SELECT isin, period, action_ordinal - avg(action_ordinal) OVER (PARTITION BY isin) AS y FROM pooled WHERE action_ordinal IS NOT NULL),
    l AS (SELECT y, lag(y, 1) OVER w AS a1, lag(y, 2) OVER w AS a2, lag(y, 3) OVER w AS a3, lag(y, 4) OVER w AS a4 FROM d WINDOW w AS (PARTITION BY isin ORDER BY period))
    """ + _AR, "pooled"))
def autoregressive_orders(spark, sf):
    """Sample size and moments of the autoregressions of all orders the choice is made from (CS2)."""
    t = gr.ar_order_table(v.pooled(spark, sf), "action_ordinal")
    # upper triangle of k + 1 columns: (y, y) first, (y, last) at place k + 1, (last, last) at the end
    at = lambda i: F.round(F.element_at("p", i), 4) + F.lit(0.0)
    return t.select("ar_order", "n", at(F.lit(1)).alias("yy"), at(F.col("ar_order") + 1).alias("y_last"), at(F.size("p")).alias("last_last"))


_CONTROLLED = "beta t_stat p_value p_fdr partial_r2 rsquared dw_stat"


@query("links_with_controls", sql(f"SELECT stratum, target, cause, lag, n_obs, {round_sql(_CONTROLLED, 4)} FROM control_links", "control_links"))
def links_with_controls(spark, sf):
    """The whole sweep with one autoregressive control, pooled and per fund type, from one moment table (CS1, CS3, CS5, AG24)."""
    return rounded(v.stratum_links(spark, sf).select("stratum", "target", "cause", "lag", "n_obs", *_CONTROLLED.split()), 4)


view("strong", ["control_links"], "SELECT * FROM control_links WHERE p_fdr <= 0.05 AND lag > 0")


@query("links_by_stratum", sql("""
    SELECT stratum, target, lag > 0 AS causal, count(*) AS n_tests, count(CASE WHEN p_fdr <= 0.05 THEN 1 END) AS n_rejected FROM control_links GROUP BY ALL""", "control_links"))
def links_by_stratum(spark, sf):
    """Tests and rejections under false discovery control in every stratum (AG28)."""
    g = v.stratum_links(spark, sf).groupBy("stratum", "target", (F.col("lag") > 0).alias("causal"))
    return g.agg(F.count("*").alias("n_tests"), F.count(F.when(F.col("significant"), 1)).alias("n_rejected"))


@query("stratum_sign_consistency", sql(f"""
    WITH p AS (SELECT cause, stratum, sign(avg(beta)) AS s FROM strong GROUP BY ALL), c AS (SELECT cause, count(*) AS n, count(DISTINCT s) AS k FROM p GROUP BY cause HAVING count(*) >= 2)
    SELECT {near_sql('avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END)')} AS sign_consistency, count(*) AS variables_in_multiple_strata FROM c""", "strong"))
def stratum_sign_consistency(spark, sf):
    """Share of causes whose significant links have one sign in all strata that have them (AG24)."""
    l = v.stratum_links(spark, sf).where(F.col("significant") & (F.col("link_type") == "causal"))
    return rounded(gp.sign_consistency(l, "stratum"))


@query("competency_by_stratum", sql("""
    SELECT question, round(value + 1.7e-9, 3) AS value, coalesce(value > 0, false) AS answered FROM (
      SELECT count(CASE WHEN target = 'action_ordinal' AND lag = 1 AND beta > 0 THEN 1 END)::DOUBLE AS q01, count(CASE WHEN target = 'action_ordinal' AND beta < 0 AND p_fdr < 0.01 THEN 1 END)::DOUBLE AS q02,
        count(DISTINCT stratum)::DOUBLE AS q03, count(DISTINCT CASE WHEN cause IN ('cpi', 'index_return', 'vix') THEN cause END)::DOUBLE AS q04, count(CASE WHEN starts_with(cause, 'sentiment') THEN 1 END)::DOUBLE AS q05,
        max(abs(t_stat)) AS q06, (SELECT count(*) FROM (SELECT cause FROM strong GROUP BY cause HAVING count(DISTINCT stratum) = 1))::DOUBLE AS q08, count(DISTINCT lag)::DOUBLE AS q09
      FROM strong) UNPIVOT (value FOR question IN (q01, q02, q03, q04, q05, q06, q08, q09))""", "strong"))
def competency_by_stratum(spark, sf):
    """The questions about links, asked of significant links of all strata (GR8, AG27)."""
    l = v.stratum_links(spark, sf).where(F.col("significant"))
    e = gp.causal_edges(l, v.parents(spark, sf), v.effects(spark, sf))
    return gp.competency(e).where(~F.col("question").isin("q07", "q10")).withColumn("value", near("value", 3))


@query("granger_sweep")
def granger_sweep(spark, sf):
    """Full sweep with autoregressive controls chosen by AIC, Durbin-Watson and FDR, pooled and per fund type (CS2, CS3, CS5)."""
    return rounded(gr.rank_links(v.fitted_links(spark, sf)))


@query("regime_interactions")
def regime_interactions(spark, sf):
    """Regime product terms on the thirty strongest pooled links, with the orders chosen by AIC (CS4)."""
    whole = F.col("stratum") == "pooled"
    links = v.fitted_links(spark, sf).where(whole)
    return rounded(sw.regime_interactions(v.stratified_panel(spark, sf).where(whole), links, v.ar_orders(spark, sf), v.REGIMES, 30, 100))


@query("durbin_watson", sql("""
    WITH b AS (SELECT beta FROM links WHERE target = 'action_ordinal' AND cause = 'pct_nav' AND lag = 1),
    d AS (SELECT isin, period, y, x FROM (SELECT isin, period, action_ordinal AS y, lag(pct_nav) OVER (PARTITION BY isin ORDER BY period) AS x FROM pooled) WHERE x IS NOT NULL AND y IS NOT NULL),
    e AS (SELECT isin, period, y - x * (SELECT beta FROM b) AS u, (y - avg(y) OVER (PARTITION BY isin)) - (x - avg(x) OVER (PARTITION BY isin)) * (SELECT beta FROM b) AS e FROM d)
    SELECT 'pct_nav' AS cause, 1 AS lag, round(sum(st * st) / sum(e * e), 5) AS dw_stat FROM (SELECT e, e - lag(e) OVER (PARTITION BY isin ORDER BY period) AS st FROM e)""", "links", "pooled"))
def durbin_watson(spark, sf):
    """Residual autocorrelation inside entities for one link (CS5)."""
    p = v.pooled(spark, sf)
    rows = gr.hypothesis_rows(p, ["action_ordinal"], ["pct_nav"], [1], 0)
    fit = rg.panel_ols(rows, gr.KEYS, "isin", "y", ["x"])
    return rounded(rg.within_durbin_watson(rows, gr.KEYS, "isin", "period", "y", ["x"], fit).drop("target"), 5)


@query("best_links", sql(f"""
    SELECT target, cause_group, link_type, cause, lag, {round_sql('partial_r2', 5)} FROM (
      SELECT *, row_number() OVER (PARTITION BY target, cause_group, link_type ORDER BY partial_r2 DESC, cause, lag) AS rn FROM links WHERE significant) WHERE rn = 1""", "links"))
def best_links(spark, sf):
    """Best significant link per target, group and type (AG21, CS6)."""
    b = gr.best_per_group(v.links(spark, sf))
    return rounded(b.select("target", "cause_group", "link_type", "cause", "lag", "partial_r2"), 5)


@query("top_links_per_target", sql("""
    WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, cause_group, link_type ORDER BY partial_r2 DESC, cause, lag) AS rn FROM links WHERE significant) WHERE rn = 1)
    SELECT target, cause, lag, pos FROM (SELECT target, cause, lag, row_number() OVER (PARTITION BY target ORDER BY partial_r2 DESC, cause, lag) AS pos FROM b) WHERE pos <= 12""", "links"))
def top_links_per_target(spark, sf):
    """Top twelve after deduplication (CS6, TOP2)."""
    return gr.top_per_target(v.links(spark, sf)).select("target", "cause", "lag", "pos")


@query("driver_importance", sql(f"""
    SELECT cause, {near_sql('avg(abs(t_stat))', 4)} AS mean_abs_t, count(*) AS n_links FROM links WHERE significant AND link_type = 'causal' GROUP BY cause""", "links"))
def driver_importance(spark, sf):
    """Mean absolute t per cause (AG25)."""
    return rounded(gr.driver_importance(v.links(spark, sf)), 4)


@query("strongest_drivers", sql(f"""
    SELECT cause, target, lag, {round_sql('beta', 5)} FROM links WHERE significant AND link_type = 'causal' ORDER BY abs(beta) DESC, cause, lag LIMIT 10""", "links"))
def strongest_drivers(spark, sf):
    """Global top by absolute slope (TOP1)."""
    l = v.links(spark, sf).where(F.col("significant") & (F.col("link_type") == "causal"))
    return rounded(l.orderBy(F.abs("beta").desc(), "cause", "lag").limit(10).select("cause", "target", "lag", "beta"), 5)
