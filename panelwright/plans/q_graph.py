"""Queries over the property graph, decision subgraphs, paths and fingerprints."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.operators import egonet as eg
from panelwright.operators import graph as gp
from panelwright.plans import views as v
from panelwright.plans.registry import near, near_sql, query, round_sql, rounded
from panelwright.plans.sqlviews import sql, view

view("rg_0", ["panel"], "SELECT period, max(vix) AS v, max(index_return) AS r FROM panel GROUP BY period")
view("rg_1", ["rg_0"], "SELECT period, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS vix_value, (r - avg(r) OVER ()) / stddev_samp(r) OVER () AS market_return FROM rg_0")
view("regimes", ["rg_1"], """
  SELECT *, vix_level || '_' || market_trend AS regime FROM (SELECT *, CASE WHEN vix_value IS NULL THEN 'UNKNOWN' WHEN vix_value > 0.75 THEN 'HIGH_VOLATILITY'
      WHEN vix_value < -0.5 THEN 'LOW_VOLATILITY' ELSE 'MODERATE_VOLATILITY' END AS vix_level,
    CASE WHEN market_return IS NULL THEN 'UNKNOWN' WHEN market_return > 0.75 THEN 'BULL' WHEN market_return < -0.75 THEN 'BEAR' ELSE 'SIDEWAYS' END AS market_trend FROM rg_1)""")


@query("regime_months", sql(f"SELECT period, regime, vix_level, market_trend, {round_sql('vix_value market_return', 5)} FROM regimes", "regimes"))
def regime_months(spark, sf):
    """Volatility band and trend per month (GR3, GR4)."""
    return rounded(v.regimes(spark, sf), 5)


@query("regime_raw_scale", sql("""
    SELECT period, CASE WHEN vix > 25 THEN 'HIGH_VOLATILITY' WHEN vix > 15 THEN 'MODERATE_VOLATILITY' ELSE 'LOW_VOLATILITY' END AS vix_level,
      CASE WHEN index_return IS NULL THEN 'UNKNOWN' WHEN index_return * 100 > 3 THEN 'BULL' WHEN index_return * 100 < -3 THEN 'BEAR' ELSE 'SIDEWAYS' END AS market_trend FROM macro""", "macro"))
def regime_raw_scale(spark, sf):
    """Raw-level thresholds on percent returns (GR3)."""
    m = v.macro(spark, sf).withColumn("pct", F.col("index_return") * 100)
    return gp.regimes(m, "vix", "pct", "raw").select("period", "vix_level", "market_trend")


view("exits", ["classified"], """
  SELECT fund, isin, period AS exit_month, pct_nav AS last_pct_nav, holding_tenure FROM (SELECT *, lead(month_ord) OVER (PARTITION BY fund, isin ORDER BY month_ord) AS nxt,
    max(month_ord) OVER (PARTITION BY fund) AS fl FROM classified) WHERE coalesce(nxt, fl) - month_ord > 3""")
view("stock_sector", ["panel"], """
  SELECT isin, sector FROM (SELECT isin, sector, row_number() OVER (PARTITION BY isin ORDER BY count(*) DESC, sector) AS rn FROM panel GROUP BY isin, sector) WHERE rn = 1""")
view("gnodes", ["panel", "regimes", "links", "parents", "effects"], """
  SELECT DISTINCT 'Sector' AS label, sector AS node_id FROM panel UNION SELECT 'Fund', fund FROM panel UNION SELECT 'Stock', isin FROM panel UNION SELECT 'TimePeriod', period FROM panel
  UNION SELECT 'MarketRegime', regime FROM regimes UNION SELECT 'FundSnapshot', fund || '|' || period FROM panel UNION SELECT 'StockSnapshot', isin || '|' || period FROM panel
  UNION SELECT 'CausalVariable', cause FROM links UNION SELECT 'CausalVariable', target FROM links UNION SELECT 'CausalVariable', variable FROM parents
  UNION SELECT 'CausalVariable', target FROM parents UNION SELECT 'CausalVariable', treatment FROM effects UNION SELECT 'CausalVariable', outcome FROM effects
  UNION SELECT 'CausalVariable', 'position_action' UNION SELECT 'DomainConcept', cause_group FROM links UNION SELECT 'DomainConcept', 'fund_decision' UNION SELECT 'CausalAnalysis', 'panel_granger_v2'""")
view("best_cause", ["links"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cause ORDER BY abs(beta) DESC, lag, target) AS rn FROM links WHERE significant) WHERE rn = 1")
_N = "NULL::DOUBLE"
view("gedges", ["panel", "exits", "stock_sector", "regimes", "links", "parents", "effects", "best_cause"], f"""
  SELECT 'HOLDS' AS etype, 'Fund' AS src_label, fund AS src, 'Stock' AS dst_label, isin AS dst, period, pct_nav AS val, {_N} AS lag, {_N} AS beta, {_N} AS p_fdr, {_N} AS t_stat FROM panel
  UNION ALL SELECT 'EXITED', 'Fund', fund, 'Stock', isin, exit_month, last_pct_nav, {_N}, {_N}, {_N}, {_N} FROM exits
  UNION ALL SELECT 'BELONGS_TO', 'Stock', isin, 'Sector', sector, NULL, {_N}, {_N}, {_N}, {_N}, {_N} FROM stock_sector
  UNION ALL SELECT 'ACTIVE_IN', 'Fund', fund, 'TimePeriod', period, NULL, count(*), {_N}, {_N}, {_N}, {_N} FROM panel GROUP BY fund, period
  UNION ALL SELECT 'NEXT', 'TimePeriod', period, 'TimePeriod', nxt, NULL, {_N}, {_N}, {_N}, {_N}, {_N} FROM (SELECT period, lead(period) OVER (ORDER BY period) AS nxt FROM (SELECT DISTINCT period FROM panel)) WHERE nxt IS NOT NULL
  UNION ALL SELECT 'IN_REGIME', 'TimePeriod', period, 'MarketRegime', regime, NULL, round(vix_value, 6), {_N}, {_N}, {_N}, {_N} FROM regimes
  UNION ALL SELECT DISTINCT 'OF_FUND', 'FundSnapshot', fund || '|' || period, 'Fund', fund, NULL, {_N}, {_N}, {_N}, {_N}, {_N} FROM panel
  UNION ALL SELECT DISTINCT 'AT_TIME', 'FundSnapshot', fund || '|' || period, 'TimePeriod', period, NULL, {_N}, {_N}, {_N}, {_N}, {_N} FROM panel
  UNION ALL SELECT DISTINCT 'OF_STOCK', 'StockSnapshot', isin || '|' || period, 'Stock', isin, NULL, {_N}, {_N}, {_N}, {_N}, {_N} FROM panel
  UNION ALL SELECT DISTINCT 'AT_TIME', 'StockSnapshot', isin || '|' || period, 'TimePeriod', period, NULL, {_N}, {_N}, {_N}, {_N}, {_N} FROM panel
  UNION ALL SELECT 'GRANGER_CAUSES', 'CausalVariable', cause, 'CausalVariable', target, NULL, beta, lag, beta, p_fdr, t_stat FROM links WHERE link_type = 'causal'
  UNION ALL SELECT 'ASSOCIATED_WITH', 'CausalVariable', cause, 'CausalVariable', target, NULL, beta, 0, beta, p_fdr, t_stat FROM links WHERE link_type = 'association'
  UNION ALL SELECT DISTINCT 'REPRESENTS', 'CausalVariable', cause, 'DomainConcept', cause_group, NULL, {_N}, {_N}, {_N}, {_N}, {_N} FROM links
  UNION ALL SELECT 'REPRESENTS', 'CausalVariable', 'position_action', 'DomainConcept', 'fund_decision', NULL, {_N}, {_N}, {_N}, {_N}, {_N}
  UNION ALL SELECT 'INFLUENCES', 'DomainConcept', cause_group, 'DomainConcept', 'fund_decision', NULL, count(*), {_N}, {_N}, {_N}, {_N} FROM links WHERE link_type = 'causal' GROUP BY cause_group
  UNION ALL SELECT 'CAUSES', 'CausalVariable', variable, 'CausalVariable', target, NULL, confidence, {_N}, {_N}, {_N}, {_N} FROM parents
  UNION ALL SELECT 'CAUSAL_EFFECT', 'CausalVariable', treatment, 'CausalVariable', outcome, NULL, theta_hat, {_N}, {_N}, {_N}, {_N} FROM effects
  UNION ALL SELECT 'DRIVES_FUND_DECISION', 'CausalVariable', cause, 'TimePeriod', period, period, beta, {_N}, {_N}, {_N}, {_N} FROM best_cause, (SELECT DISTINCT period FROM panel)""")


@query("graph_nodes", sql("SELECT label, node_id FROM gnodes", "gnodes"))
def graph_nodes(spark, sf):
    """All node builders (GR1)."""
    return v.graph_nodes(spark, sf).select("label", "node_id")


@query("graph_edges", sql("SELECT etype, src_label, src, dst_label, dst, period, round(val + 1.7e-9::DOUBLE, 4) + 0.0::DOUBLE AS val FROM gedges", "gedges"))
def graph_edges(spark, sf):
    """All edge builders with their main property (GR2, GR4, GR5, WN31, JN14)."""
    names = ["pct_nav", "last_pct_nav", "holdings_count", "vix_value", "link_count", "confidence", "theta_hat"]
    val = F.coalesce(*[F.try_element_at("props", F.lit(n)) for n in names], F.try_element_at("props", F.lit("beta")))
    return v.graph_edges(spark, sf).select("etype", "src_label", "src", "dst_label", "dst", "period", near(val, 4).alias("val"))


@query("fund_snapshots", sql(f"SELECT fund, period, count(DISTINCT isin) AS total_stocks, {near_sql('sum(pct_nav)', 4)} AS total_nav FROM panel GROUP BY fund, period", "panel"))
def fund_snapshots(spark, sf):
    """Fund snapshot aggregates (AG29)."""
    return rounded(gp.fund_snapshots(v.panel(spark, sf)), 4)


@query("stock_snapshots", sql("SELECT isin, period, " + ", ".join(f"{near_sql(f'avg({c})', 4)} AS {c}" for c in ("pct_nav", "pe", "rsi")) + " FROM panel GROUP BY isin, period", "panel"))
def stock_snapshots(spark, sf):
    """Stock snapshot aggregates (AG29)."""
    return rounded(gp.stock_snapshots(v.panel(spark, sf), ["pct_nav", "pe", "rsi"]), 4)


@query("causal_link_edges", sql(f"""
    SELECT cause AS src, target AS dst, lag::DOUBLE AS lag, CASE WHEN beta > 0 THEN 'positive' ELSE 'negative' END AS direction,
      CASE WHEN partial_r2 >= 0.014 THEN 'large' WHEN partial_r2 >= 0.006 THEN 'medium' WHEN partial_r2 >= 0.002 THEN 'small' ELSE 'negligible' END AS effect_size, {near_sql('t_stat', 4)} AS t_stat
    FROM links WHERE link_type = 'causal'""", "links"))
def causal_link_edges(spark, sf):
    """Causal edges with direction and size word (GR5, PRJ13)."""
    e = v.graph_edges(spark, sf).where(F.col("etype") == "GRANGER_CAUSES")
    return e.select("src", "dst", F.col("props")["lag"].alias("lag"), F.col("attrs")["direction"].alias("direction"), F.col("attrs")["effect_size"].alias("effect_size"), near(F.col("props")["t_stat"], 4).alias("t_stat"))


_ALONE = "(SELECT label, node_id FROM gnodes EXCEPT (SELECT src_label, src FROM gedges UNION SELECT dst_label, dst FROM gedges))"


@query("isolated_nodes", sql(f"SELECT label, node_id FROM {_ALONE}", "gnodes", "gedges"))
def isolated_nodes(spark, sf):
    """Nodes without edges (JN15)."""
    return gp.isolated(v.graph_nodes(spark, sf), v.graph_edges(spark, sf)).select("label", "node_id")


_ISO = f"(SELECT count(*) FROM {_ALONE})"
view("m_struct", ["gnodes", "gedges"], f"""
  SELECT 'structural' AS category, metric, value FROM (SELECT v AS total_nodes, e AS total_edges, e / (v * (v - 1)) AS density, 2 * e / v AS average_degree,
      (SELECT count(DISTINCT label) FROM gnodes WHERE label IN ('Fund', 'Stock', 'Sector', 'TimePeriod', 'CausalVariable', 'CausalAnalysis', 'DomainConcept', 'MarketCapStratum')) / 8.0::DOUBLE AS schema_node_coverage,
      (SELECT count(DISTINCT etype) FROM gedges WHERE etype IN ('HOLDS', 'BELONGS_TO', 'ACTIVE_IN', 'NEXT', 'GRANGER_CAUSES', 'REPRESENTS', 'INFLUENCES')) / 7.0::DOUBLE AS schema_rel_coverage,
      iso AS isolated_nodes, 1 - iso / v AS connected_ratio
    FROM (SELECT (SELECT count(*) FROM gnodes)::DOUBLE AS v, (SELECT count(*) FROM gedges)::DOUBLE AS e, {_ISO}::DOUBLE AS iso))
  UNPIVOT (value FOR metric IN (total_nodes, total_edges, density, average_degree, schema_node_coverage, schema_rel_coverage, isolated_nodes, connected_ratio))""")


@query("graph_structure", sql("SELECT category, metric, round(value + 1.7e-9, 8) AS value FROM m_struct", "m_struct"))
def graph_structure(spark, sf):
    """Size, density, degree, schema coverage, connected share (GR6)."""
    m = gp.structural(v.graph_nodes(spark, sf), v.graph_edges(spark, sf))
    return m.withColumn("value", near("value", 8))


@query("graph_counts", sql("SELECT 'node' AS kind, label AS name, count(*) AS n FROM gnodes GROUP BY label UNION ALL SELECT 'edge', etype, count(*) FROM gedges GROUP BY etype", "gnodes", "gedges"))
def graph_counts(spark, sf):
    """Counts by label and type (GR6)."""
    n = v.graph_nodes(spark, sf).groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("node"))
    e = v.graph_edges(spark, sf).groupBy(F.col("etype").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge"))
    return n.unionByName(e)


view("m_cons", ["links", "gnodes", "gedges"], """
  SELECT 'consistency' AS category, metric, value FROM (
    SELECT avg((k = 1)::INT)::DOUBLE AS sign_consistency, count(*)::DOUBLE AS variables_in_multiple_strata,
      (SELECT avg((abs(strength) > 1.96)::INT) FROM links WHERE edge_type = 'GRANGER_CAUSES')::DOUBLE AS t_stat_integrity, max(o)::DOUBLE AS orphan_causal_variables, 1 - max(o) / max(cv)::DOUBLE AS causal_variable_utilization
    FROM (SELECT cause, count(DISTINCT s) AS k FROM (SELECT cause, target, sign(avg(beta)) AS s FROM links WHERE edge_type = 'GRANGER_CAUSES' GROUP BY ALL) GROUP BY cause HAVING count(*) >= 2),
      (SELECT count(*) AS o FROM gnodes n WHERE label = 'CausalVariable' AND node_id NOT IN (SELECT src FROM gedges WHERE etype IN ('GRANGER_CAUSES', 'ASSOCIATED_WITH')) AND node_id NOT IN (SELECT dst FROM gedges WHERE etype IN ('GRANGER_CAUSES', 'ASSOCIATED_WITH'))),
      (SELECT count(*) AS cv FROM gnodes WHERE label = 'CausalVariable'))
  UNPIVOT (value FOR metric IN (sign_consistency, variables_in_multiple_strata, t_stat_integrity, orphan_causal_variables, causal_variable_utilization))""")


@query("graph_consistency", sql("SELECT category, metric, round(value + 1.7e-9, 6) AS value FROM m_cons", "m_cons"))
def graph_consistency(spark, sf):
    """Sign consistency over targets, significance, unused variables (AG24, GR7, JN15)."""
    m = gp.consistency(v.links(spark, sf), v.graph_nodes(spark, sf), v.graph_edges(spark, sf), "target")
    return m.withColumn("value", near("value"))


view("m_sem", ["gnodes", "gedges", "panel"], """
  SELECT 'semantic' AS category, metric, value FROM (
    SELECT count(CASE WHEN label = 'Stock' THEN 1 END)::DOUBLE AS total_stocks, (SELECT count(DISTINCT src) FROM gedges WHERE etype = 'BELONGS_TO') / count(CASE WHEN label = 'Stock' THEN 1 END)::DOUBLE AS stock_sector_coverage,
      1.0::DOUBLE AS entity_coverage_ratio, (SELECT -sum(s * log2(s + 1e-10)) FROM (SELECT count(*) / sum(count(*)) OVER () AS s FROM gedges WHERE etype = 'REPRESENTS' GROUP BY dst)) AS concept_entropy,
      (SELECT -sum(s * log2(s + 1e-10)) / log2(count(*)) FROM (SELECT count(*) / sum(count(*)) OVER () AS s FROM gedges WHERE etype = 'REPRESENTS' GROUP BY dst)) AS concept_entropy_normalized,
      (SELECT count(DISTINCT dst) FROM gedges WHERE etype = 'ACTIVE_IN') / count(CASE WHEN label = 'TimePeriod' THEN 1 END)::DOUBLE AS temporal_completeness,
      count(CASE WHEN label = 'TimePeriod' THEN 1 END)::DOUBLE AS total_timepoints, count(CASE WHEN label = 'Fund' THEN 1 END)::DOUBLE AS total_funds,
      count(CASE WHEN label = 'Sector' THEN 1 END)::DOUBLE AS total_sectors, count(CASE WHEN label = 'MarketRegime' THEN 1 END)::DOUBLE AS total_regimes FROM gnodes)
  UNPIVOT (value FOR metric IN (total_stocks, stock_sector_coverage, entity_coverage_ratio, concept_entropy, concept_entropy_normalized, temporal_completeness, total_timepoints, total_funds, total_sectors, total_regimes))""")


@query("graph_semantics", sql("SELECT category, metric, round(value + 1.7e-9, 6) AS value FROM m_sem", "m_sem"))
def graph_semantics(spark, sf):
    """Coverage and concept entropy (AG22, GR7)."""
    m = gp.semantic(v.graph_nodes(spark, sf), v.graph_edges(spark, sf), v.panel(spark, sf))
    return m.withColumn("value", near("value"))


@query("graph_informativeness", sql("""
    SELECT 'informativeness' AS category, metric, round(value + 1.7e-9, 5) AS value FROM (
      SELECT count(CASE WHEN g THEN 1 END)::DOUBLE AS granger_causes_count, count(CASE WHEN NOT g THEN 1 END)::DOUBLE AS associations_count, count(*)::DOUBLE AS total_causal_edges,
        avg(r2) AS r2_mean, median(r2) AS r2_median, max(r2) AS r2_max, count(CASE WHEN r2 >= 0.02 THEN 1 END)::DOUBLE AS above_small, count(CASE WHEN r2 >= 0.06 THEN 1 END)::DOUBLE AS above_medium,
        count(CASE WHEN r2 >= 0.14 THEN 1 END)::DOUBLE AS above_large, avg(CASE WHEN g THEN lag END)::DOUBLE AS avg_lag, count(DISTINCT CASE WHEN g THEN cause END)::DOUBLE AS unique_causes
      FROM (SELECT *, edge_type = 'GRANGER_CAUSES' AS g, CASE WHEN edge_type = 'GRANGER_CAUSES' THEN partial_r2 END AS r2 FROM links))
    UNPIVOT (value FOR metric IN (granger_causes_count, associations_count, total_causal_edges, r2_mean, r2_median, r2_max, above_small, above_medium, above_large, avg_lag, unique_causes))""", "links"))
def graph_informativeness(spark, sf):
    """Link counts, effect sizes, weighted mean lag (AG28, GR7)."""
    return gp.informativeness(v.links(spark, sf)).withColumn("value", near("value", 5))


@query("graph_temporal", sql("""
    SELECT 'temporal' AS category, metric, round(value + 1.7e-9, 6) AS value FROM (
      SELECT avg(n) AS avg_stocks_per_fund_month, min(n)::DOUBLE AS min_stocks, max(n)::DOUBLE AS max_stocks, sum(n)::DOUBLE AS total_holds, (SELECT count(*) FROM exits)::DOUBLE AS total_exits, 1.0::DOUBLE AS chain_complete
      FROM (SELECT count(*) AS n FROM panel GROUP BY fund, period))
    UNPIVOT (value FOR metric IN (avg_stocks_per_fund_month, min_stocks, max_stocks, total_holds, total_exits, chain_complete))""", "panel", "exits"))
def graph_temporal(spark, sf):
    """Holdings per fund-month, totals, month chain (AG30, GR7)."""
    return gp.temporal(v.graph_edges(spark, sf), v.graph_nodes(spark, sf)).withColumn("value", near("value"))


view("comp", ["gedges"], """
  SELECT question, value, coalesce(value > 0, false) AS answered FROM (
    SELECT count(CASE WHEN dst = 'action_ordinal' AND lag = 1 AND beta > 0 THEN 1 END)::DOUBLE AS q01, count(CASE WHEN dst = 'action_ordinal' AND beta < 0 AND p_fdr < 0.01 THEN 1 END)::DOUBLE AS q02,
      1.0::DOUBLE AS q03, count(DISTINCT CASE WHEN src IN ('cpi', 'index_return', 'vix') THEN src END)::DOUBLE AS q04, count(CASE WHEN starts_with(src, 'sentiment') THEN 1 END)::DOUBLE AS q05,
      max(abs(t_stat)) AS q06, (SELECT count(*) FROM gedges WHERE etype = 'INFLUENCES')::DOUBLE AS q07, count(DISTINCT src)::DOUBLE AS q08, count(DISTINCT lag)::DOUBLE AS q09, (SELECT count(*) FROM gedges)::DOUBLE AS q10
    FROM gedges WHERE etype = 'GRANGER_CAUSES') UNPIVOT (value FOR question IN (q01, q02, q03, q04, q05, q06, q07, q08, q09, q10))""")


@query("competency_questions", sql("SELECT question, round(value + 1.7e-9, 4) AS value, answered FROM comp", "comp"))
def competency_questions(spark, sf):
    """Ten named questions with an answered flag (GR8, AG27)."""
    return gp.competency(v.graph_edges(spark, sf)).withColumn("value", near("value", 4))


@query("graph_quality", sql("""
    WITH c AS (SELECT CASE metric WHEN 'total_nodes' THEN 'struct_size' WHEN 'schema_node_coverage' THEN 'schema_nodes' WHEN 'schema_rel_coverage' THEN 'schema_rels' WHEN 'connected_ratio' THEN 'connected'
        WHEN 'causal_variable_utilization' THEN 'var_utilization' WHEN 'temporal_completeness' THEN 'temporal_complete' WHEN 'entity_coverage_ratio' THEN 'entity_coverage'
        WHEN 'concept_entropy_normalized' THEN 'concept_diversity' ELSE metric END AS component, CASE WHEN metric = 'total_nodes' THEN least(1, value / 10000) ELSE value END AS value
      FROM (SELECT * FROM m_struct UNION ALL SELECT * FROM m_cons UNION ALL SELECT * FROM m_sem)
      WHERE metric IN ('total_nodes', 'schema_node_coverage', 'schema_rel_coverage', 'connected_ratio', 'sign_consistency', 'causal_variable_utilization', 'temporal_completeness', 'entity_coverage_ratio', 'concept_entropy_normalized')
      UNION ALL SELECT 'inferential', avg(answered::INT) FROM comp)
    SELECT component, round(value + 1.7e-9, 6) AS value FROM c UNION ALL SELECT 'overall', round(avg(value) + 1.7e-9, 6) FROM c""", "m_struct", "m_cons", "m_sem", "comp"))
def graph_quality(spark, sf):
    """Component scores and their mean (GR9)."""
    n, e = v.graph_nodes(spark, sf), v.graph_edges(spark, sf)
    m = gp.structural(n, e).unionByName(gp.consistency(v.links(spark, sf), n, e, "target")).unionByName(gp.semantic(n, e, v.panel(spark, sf)))
    return gp.overall_quality(m, gp.competency(e)).withColumn("value", near("value"))


def _contains_edges(spark, sf):
    """region > nation > customer > segment as one edge type."""
    n = v.table(spark, sf, "nation").join(v.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = v.table(spark, sf, "customer").join(v.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        n.select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
        .union(c.select("n_name", "c_name"))
        .union(c.select("c_name", "c_mktsegment"))
    )


_CONTAINS = """e AS (SELECT r_name AS a, n_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT c_name, c_mktsegment FROM customer)"""
_WALK = "p AS (SELECT a, b, a || ' > ' || b AS chain, 1 AS length FROM e UNION ALL SELECT p.a, e.b, p.chain || ' > ' || e.b, p.length + 1 FROM p JOIN e ON p.b = e.a WHERE p.length < 4)"


@query("path_counts", f"WITH RECURSIVE {_CONTAINS}, {_WALK} SELECT CAST(length AS INT) AS length, count(*) AS n, min(chain) AS first_chain FROM p GROUP BY length")
def path_counts(spark, sf):
    """Variable-length paths of one to four hops (GR10, JN17)."""
    p = gp.path_summaries(_contains_edges(spark, sf))
    return p.groupBy("length").agg(F.sum("n").alias("n"), F.min(F.element_at("chains", 1)).alias("first_chain"))


@query("longest_paths", f"WITH RECURSIVE {_CONTAINS}, {_WALK} SELECT chain, CAST(length AS INT) AS length FROM p ORDER BY length DESC, chain LIMIT 3")
def longest_paths(spark, sf):
    """Longest chains (GR10)."""
    return gp.longest_paths(_contains_edges(spark, sf))


view("drivers10", ["links"], "SELECT * FROM links WHERE significant AND link_type = 'causal' ORDER BY abs(beta) DESC, cause, target, lag LIMIT 10")
view("drivers8", ["links"], "SELECT *, row_number() OVER (ORDER BY abs(beta) DESC, cause, target, lag) AS rk FROM links WHERE significant AND link_type = 'causal' ORDER BY abs(beta) DESC, cause, target, lag LIMIT 8")
view("parents8", ["parents"], "SELECT * FROM parents ORDER BY confidence DESC, variable, stratum LIMIT 8")
view("top15", ["panel"], "SELECT fund, period, isin AS peer, sector AS psec FROM (SELECT *, row_number() OVER (PARTITION BY fund, period ORDER BY pct_nav DESC, isin) AS rn FROM panel) WHERE rn <= 15")
view("ego", ["panel", "top15", "regimes", "drivers10", "parents8"], """
  SELECT fund, isin, period, 1 AS grp, 0::DOUBLE AS o, 'Fund:' || fund AS src, 'HOLDS' AS etype, 'Stock:' || isin AS dst FROM panel
  UNION ALL SELECT fund, isin, period, 2, 0, 'Stock:' || isin, 'BELONGS_TO', 'Sector:' || sector FROM panel
  UNION ALL SELECT fund, isin, p.period, 3, 0, 'TimePeriod:' || p.period, 'IN_REGIME', 'MarketRegime:' || coalesce(regime, 'UNKNOWN') FROM panel p LEFT JOIN regimes r ON r.period = p.period
  UNION ALL SELECT p.fund, p.isin, p.period, 4, 0, 'Fund:' || p.fund, 'HOLDS', 'Stock:' || peer FROM panel p JOIN top15 t ON t.fund = p.fund AND t.period = p.period AND t.peer <> p.isin
  UNION ALL SELECT p.fund, p.isin, p.period, 4, 0, 'Stock:' || peer, 'BELONGS_TO', 'Sector:' || psec FROM panel p JOIN top15 t ON t.fund = p.fund AND t.period = p.period AND t.peer <> p.isin
  UNION ALL SELECT fund, isin, period, 5, -abs(beta), 'CausalVar:' || cause, 'GRANGER_CAUSES', 'CausalVar:' || target FROM panel, drivers10
  UNION ALL SELECT fund, isin, period, 6, -confidence, 'CausalVar:' || variable, 'CAUSES', 'CausalVar:' || target FROM panel, parents8""")


@query("decision_subgraphs", sql("""
    SELECT fund, isin, period, count(*) AS n_edges, md5(string_agg(src || '-' || etype || '-' || dst, ';' ORDER BY src || '-' || etype || '-' || dst)) AS signature FROM ego GROUP BY fund, isin, period""", "ego"))
def decision_subgraphs(spark, sf):
    """Edge list around every decision, reported as a signature (GR11, JN11)."""
    g = v.subgraphs(spark, sf)
    lines = F.array_sort(F.transform("edges", lambda e: F.concat_ws("-", e["src"], e["etype"], e["dst"])))
    return g.select("fund", "isin", "period", F.size("edges").cast("long").alias("n_edges"), F.md5(F.array_join(lines, ";")).alias("signature"))


view("wl_e", ["ego"], """
  SELECT hash(fund, isin, period) AS k, src AS a, dst AS b, etype, grp, o FROM ego UNION ALL SELECT hash(fund, isin, period), dst, src, etype, grp, o FROM ego""")
view("wl_adj", ["wl_e"], """
  SELECT k, a, b, arg_max(etype, (grp, o)) AS etype, count(*) AS times FROM wl_e GROUP BY k, a, b""")
view("wl_0", ["wl_e"], "SELECT DISTINCT k, a AS node, split_part(a, ':', 1) AS label FROM wl_e")
for _r in (1, 2, 3):
    view(f"wl_{_r}", ["wl_adj", f"wl_{_r - 1}"], f"""
  SELECT s.k, s.node, substr(md5(any_value(s.label) || '||' || string_agg(n.label || '|' || x.etype, ',' ORDER BY n.label || '|' || x.etype)), 1, 12) AS label
  FROM wl_{_r - 1} s JOIN (SELECT k, a, b, etype, unnest(range(times)) AS u FROM wl_adj) x ON x.k = s.k AND x.a = s.node JOIN wl_{_r - 1} n ON n.k = x.k AND n.node = x.b GROUP BY s.k, s.node""")
view("wl_hist", ["wl_0", "wl_1", "wl_2", "wl_3"], """
  SELECT k, label, count(*) AS n FROM (SELECT k, label FROM wl_0 UNION ALL SELECT k, label FROM wl_1 UNION ALL SELECT k, label FROM wl_2 UNION ALL SELECT k, label FROM wl_3) GROUP BY k, label""")


@query("wl_fingerprints", sql("""
    SELECT p.fund, p.isin, p.period, h.n_labels, h.signature FROM panel p
    JOIN (SELECT k, count(*) AS n_labels, md5(string_agg(label || '=' || n, ';' ORDER BY label || '=' || n)) AS signature FROM wl_hist GROUP BY k) h ON h.k = hash(p.fund, p.isin, p.period)""", "panel", "wl_hist"))
def wl_fingerprints(spark, sf):
    """Subtree-pattern histogram of every decision, computed once per distinct shape (GR14)."""
    g, h = v.shapes(spark, sf), v.shape_histograms(spark, sf)
    items = F.array_sort(F.collect_list(F.concat_ws("=", "label", F.col("n").cast("string"))))
    sig = h.groupBy("shape").agg(F.count("*").alias("n_labels"), F.md5(F.array_join(items, ";")).alias("signature"))
    return g.select("fund", "isin", "period", "shape").join(F.broadcast(sig), "shape").drop("shape")


view("wl_small", ["panel"], "SELECT fund, isin, period, lag(period) OVER (PARTITION BY fund, isin ORDER BY period) AS prev FROM panel")


view("wl_q", ["wl_small"], "SELECT *, hash(fund, isin, period) AS ka, hash(fund, isin, prev) AS kb FROM wl_small WHERE prev IS NOT NULL")
view("wl_qa", ["wl_q", "wl_hist"], "SELECT q.ka, q.kb, a.label, a.n FROM wl_q q JOIN wl_hist a ON a.k = q.ka")
view("wl_qab", ["wl_qa", "wl_hist"], "SELECT x.ka, sum(x.n * b.n) AS dot FROM wl_qa x JOIN wl_hist b ON b.k = x.kb AND b.label = x.label GROUP BY x.ka")
view("wl_norm", ["wl_hist"], "SELECT k, sqrt(sum(n * n)) AS nn FROM wl_hist GROUP BY k")


@query("wl_similarity_to_previous", sql(f"""
    SELECT fund, isin, period, {near_sql('d.dot / (x.nn * y.nn)')} AS wl_similarity FROM wl_q q JOIN wl_qab d ON d.ka = q.ka JOIN wl_norm x ON x.k = q.ka JOIN wl_norm y ON y.k = q.kb""", "wl_q", "wl_qab", "wl_norm"))
def wl_similarity_to_previous(spark, sf):
    """Cosine of the histograms of a decision and the one before it (GR15)."""
    g = v.shapes(spark, sf)
    sim = F.broadcast(v.shape_similarity(spark, sf))
    w = W.partitionBy("fund", "isin").orderBy("period")
    d = g.select("fund", "isin", "period", F.col("shape").alias("shape_a"), F.lag("shape").over(w).alias("shape_b")).where(F.col("shape_b").isNotNull())
    return rounded(d.join(sim, ["shape_a", "shape_b"]).drop("shape_a", "shape_b"))


@query("decision_paths", sql("""
    WITH d AS (SELECT string_agg('CausalVariable:' || cause || ':GRANGER_CAUSES', '>' ORDER BY rk) AS t, count(*) AS k, round(max(beta), 5) AS top FROM drivers8)
    SELECT fund, isin, p.period, position_action, CAST(4 + k AS BIGINT) AS hops, md5('Fund:' || fund || ':>Stock:' || isin || ':HOLDS>Sector:' || sector || ':BELONGS_TO>MarketRegime:' || coalesce(regime, 'UNKNOWN') || ':IN_REGIME>' || t) AS signature,
      round(pct_nav, 6) AS pct_nav, round(top + 1.7e-9, 4) AS top_beta FROM panel p LEFT JOIN regimes r ON r.period = p.period, d""", "panel", "regimes", "drivers8"))
def decision_paths(spark, sf):
    """Ordered hops from fund to causal drivers (GR12)."""
    p = v.decision_paths(spark, sf)
    text = F.concat_ws(">", F.transform("path", lambda h: F.concat_ws(":", h["node_type"], h["node_id"], F.coalesce(h["edge_type"], F.lit("")))))
    top = F.array_max(F.transform(F.slice("path", 5, 8), lambda h: h["edge_props"]["beta"]))
    return p.select(
        "fund", "isin", "period", "position_action", F.size("path").cast("long").alias("hops"), F.md5(text).alias("signature"),
        F.round(F.element_at("path", 2)["edge_props"]["pct_nav"], 6).alias("pct_nav"), near(F.round(top, 5), 4).alias("top_beta"),
    )


@query("encoded_paths", sql("""
    WITH ids AS (SELECT node_id, row_number() OVER (ORDER BY node_id) AS i FROM (SELECT fund AS node_id FROM panel UNION SELECT isin FROM panel UNION SELECT sector FROM panel
        UNION SELECT coalesce(regime, 'UNKNOWN') FROM panel p LEFT JOIN regimes r ON r.period = p.period UNION SELECT cause FROM drivers8)),
    k AS (SELECT count(*) AS k FROM drivers8), dv AS (SELECT list(CAST(i AS INT) ORDER BY rk) AS ids FROM drivers8 JOIN ids ON node_id = cause)
    SELECT p.fund, p.isin, p.period, array_to_string(list_resize(list_concat([0, 1, 2, 3], list_resize([4], k, 4)), 13, 6), ',') AS node_types,
      array_to_string(list_resize(list_concat([CAST(f.i AS INT), CAST(s.i AS INT), CAST(c.i AS INT), CAST(m.i AS INT)], dv.ids), 13, 0), ',') AS node_ids,
      array_to_string(list_resize(list_concat([0, 1, 2, 3], list_resize([4], k, 4)), 13, 8), ',') AS edge_types, round(p.pct_nav, 6) AS stock_weight, p.holding_tenure::DOUBLE AS stock_tenure
    FROM panel p LEFT JOIN regimes r ON r.period = p.period JOIN ids f ON f.node_id = p.fund JOIN ids s ON s.node_id = p.isin JOIN ids c ON c.node_id = p.sector
    JOIN ids m ON m.node_id = coalesce(regime, 'UNKNOWN'), k, dv""", "panel", "regimes", "drivers8"))
def encoded_paths(spark, sf):
    """Paths as padded ids and an edge-feature matrix; vocabulary from sorted ids (GR13)."""
    e = eg.encode_paths(*v.path_parts(spark, sf))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    stock = F.element_at("edge_feats", 2)
    return e.select("fund", "isin", "period", text("node_types").alias("node_types"), text("node_ids").alias("node_ids"), text("edge_types").alias("edge_types"),
                    F.round(F.element_at(stock, 1), 6).alias("stock_weight"), F.element_at(stock, 2).alias("stock_tenure"))


@query("portfolio_peers", sql("""
    SELECT fund, isin, period, pos, peer, round(peer_pct_nav, 6) AS peer_pct_nav FROM (SELECT p.fund, p.isin, p.period, q.isin AS peer, q.pct_nav AS peer_pct_nav,
      row_number() OVER (PARTITION BY p.fund, p.isin, p.period ORDER BY q.pct_nav DESC, q.isin) AS pos
      FROM panel p JOIN panel q ON q.fund = p.fund AND q.period = p.period AND q.isin <> p.isin) WHERE pos <= 5""", "panel"))
def portfolio_peers(spark, sf):
    """Five largest other holdings of the fund and month (JN11)."""
    return rounded(eg.peers_of(v.panel(spark, sf).select("fund", "isin", "period", "sector", "pct_nav"), 5))


@query("cause_effect_matrix", sql("SELECT cause, " + ", ".join(f"{near_sql(f'''max(abs(strength)) FILTER (effect = '{t}')''', 4)} AS {t}" for t in ("action_ordinal", "buy_ratio", "sell_ratio")) + " FROM links GROUP BY cause", "links"))
def cause_effect_matrix(spark, sf):
    """Strongest links as a cause by effect matrix (AG34)."""
    return rounded(gp.cause_effect_matrix(v.links(spark, sf), ["action_ordinal", "buy_ratio", "sell_ratio"]), 4)


@query("strong_directed_links", sql(f"SELECT cause, effect, lag, {near_sql('abs(strength)', 4)} AS strength FROM links WHERE edge_type = 'GRANGER_CAUSES' ORDER BY abs(strength) DESC, cause, effect, lag LIMIT 60", "links"))
def strong_directed_links(spark, sf):
    """Sixty strongest directed links (AG34, TOP1)."""
    g = v.links(spark, sf).where(F.col("edge_type") == "GRANGER_CAUSES")
    return rounded(g.orderBy(F.abs("strength").desc(), "cause", "effect", "lag").limit(60).select("cause", "effect", "lag", F.abs("strength").alias("strength")), 4)


@query("lag_and_type_shares", sql(f"SELECT edge_type, lag, count(*) AS n, {near_sql('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM links GROUP BY edge_type, lag", "links"))
def lag_and_type_shares(spark, sf):
    """Link shares by type and lag (AG28, AG34, AG23)."""
    from panelwright.operators.reports import distribution

    return rounded(distribution(v.links(spark, sf), ["edge_type", "lag"]))


@query("domain_influence", sql(f"SELECT cause_group AS src, count(*)::DOUBLE AS link_count, {near_sql('max(partial_r2)', 5)} AS max_partial_r2 FROM links WHERE link_type = 'causal' GROUP BY cause_group", "links"))
def domain_influence(spark, sf):
    """Links and strongest effect per concept (AG26)."""
    e = v.graph_edges(spark, sf).where(F.col("etype") == "INFLUENCES")
    return e.select("src", F.col("props")["link_count"].alias("link_count"), near(F.col("props")["max_partial_r2"], 5).alias("max_partial_r2"))
