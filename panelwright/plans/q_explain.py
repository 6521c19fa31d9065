"""Queries over evidence, explanations and counterfactuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.encodings import action_class, class_label
from panelwright.operators import egonet as eg
from panelwright.operators import explain as ex
from panelwright.plans import q_graph as _graph_views  # noqa: F401  (defines SQL views used below)
from panelwright.plans import views as v
from panelwright.plans.registry import near_sql, query, round_sql, rounded
from panelwright.plans.sqlviews import EVIDENCE, sql, view

view("best_link", ["links"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cause ORDER BY abs(beta) DESC, lag, target) AS rn FROM links) WHERE rn = 1")
view("evidence", ["parents", "effects", "best_link"], """
  SELECT coalesce(p.variable, e.treatment, g.cause) AS variable, icp_confidence, icp_certified, theta_hat AS dml_theta, ci_lower_95, ci_upper_95, significant AS dml_significant, direction AS dml_direction,
    g.beta AS granger_beta, g.lag AS granger_lag, g.cause_group AS granger_group
  FROM (SELECT variable, max(confidence) AS icp_confidence, CAST(max(in_intersection::INT) AS INT) AS icp_certified FROM parents GROUP BY 1) p
  FULL JOIN (SELECT treatment, theta_hat, ci_lower_95, ci_upper_95, significant, direction FROM effects WHERE outcome = 'action_ordinal') e ON e.treatment = p.variable
  FULL JOIN (SELECT cause, beta, lag, cause_group FROM best_link) g ON g.cause = coalesce(p.variable, e.treatment)""")
_EV = "icp_confidence dml_theta ci_lower_95 ci_upper_95 granger_beta"


def _evidence(spark, sf):
    return ex.merge_evidence(v.links(spark, sf), v.parents(spark, sf), v.effects(spark, sf))


@query("evidence_by_variable", sql(f"SELECT variable, icp_certified, dml_significant, dml_direction, granger_lag, granger_group, {round_sql(_EV, 5)} FROM evidence", "evidence"))
def evidence_by_variable(spark, sf):
    """Evidence of all methods per variable (ML15, AG21)."""
    return rounded(_evidence(spark, sf), 5)


@query("causal_paths_to_concepts", sql(f"""
    WITH t AS (SELECT * FROM links WHERE significant AND link_type = 'causal' ORDER BY abs(beta) DESC, cause, target, lag LIMIT 5),
    c AS (SELECT DISTINCT cause, cause_group FROM links UNION SELECT 'position_action', 'fund_decision')
    SELECT t.cause, t.target, t.lag, {near_sql('t.beta', 5)} AS beta, c.cause_group AS concept FROM t LEFT JOIN c ON c.cause = t.target""", "links"))
def causal_paths_to_concepts(spark, sf):
    """Link, effect and optional concept (JN17)."""
    concepts = v.graph_edges(spark, sf).where(F.col("etype") == "REPRESENTS")
    return rounded(ex.causal_paths(v.links(spark, sf), concepts).select("cause", "target", "lag", "beta", "concept"), 5)


def _predicted(spark, sf):
    p = v.panel(spark, sf).select("fund", "isin", "period", "month_ord", "sector", "pct_nav", "position_action")
    guess = class_label(F.pmod(F.substring("isin", 4, 3).cast("int") + F.col("month_ord"), F.lit(3)))
    driver = F.element_at(F.array(*[F.lit(c) for c in [*EVIDENCE, "macd_hist"]]), F.pmod(F.col("month_ord"), F.lit(len(EVIDENCE) + 1)).cast("int") + 1)
    return p.withColumns({"predicted_label": guess, "driver": driver})


view("guess", ["panel"], """
  SELECT fund, isin, period, sector, pct_nav, CASE (CAST(substr(isin, 4, 3) AS INT) + month_ord) % 3 WHEN 2 THEN 'BUY' WHEN 1 THEN 'HOLD' ELSE 'SELL' END AS predicted_label,
    CASE month_ord % 11 """ + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate([*EVIDENCE, "macd_hist"])) + " END AS driver FROM panel")
view("peers5", ["panel"], """
  SELECT fund, isin, period, count(*) AS k, string_agg('- also holds ' || peer || ' (' || psec || ') at ' || printf('%.1f', w) || '%', chr(10) ORDER BY pos) AS t FROM (
    SELECT p.fund, p.isin, p.period, q.isin AS peer, q.sector AS psec, q.pct_nav AS w, row_number() OVER (PARTITION BY p.fund, p.isin, p.period ORDER BY q.pct_nav DESC, q.isin) AS pos
    FROM panel p JOIN panel q ON q.fund = p.fund AND q.period = p.period AND q.isin <> p.isin) WHERE pos <= 5 GROUP BY ALL""")


view("cause_lines", ["links", "parents", "effects"], """
  SELECT string_agg(t, chr(10) ORDER BY o, w DESC, t) AS lines FROM (
    SELECT * FROM (SELECT 0 AS o, abs(beta) AS w, '- ' || cause || ' -> ' || target || ' (lag=' || lag || ', beta=' || printf('%+.4f', beta) || ')' AS t
      FROM links WHERE significant AND link_type = 'causal' ORDER BY abs(beta) DESC, cause, target, lag LIMIT 8)
    UNION ALL SELECT * FROM (SELECT 1, confidence, '- ' || variable || ' => ' || target || ' (confidence=' || printf('%.2f', confidence) || ')' FROM parents ORDER BY confidence DESC, variable, stratum LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 2, abs(theta_hat), '- ' || treatment || ' ~> ' || outcome || ' (theta=' || printf('%+.4f', theta_hat) || CASE WHEN significant THEN '*' ELSE '' END
      || ', CI=[' || printf('%+.4f', ci_lower_95) || ', ' || printf('%+.4f', ci_upper_95) || '])' FROM effects ORDER BY abs(theta_hat) DESC, treatment, outcome LIMIT 5))""")


def _explained(spark, sf, decisions):
    """Explanations with eight links, five parents, five effects and five peers."""
    links, effects = v.links(spark, sf), v.effects(spark, sf)
    top = effects.orderBy(F.abs("theta_hat").desc(), "treatment", "outcome").limit(5)
    return ex.explanations(decisions, v.regimes(spark, sf), eg.top_drivers(links, 8), eg.top_parents(v.parents(spark, sf), 5), top)


@query("decision_explanations", sql("""
    SELECT g.fund, g.isin, g.period, predicted_label, coalesce(regime, 'UNKNOWN') AS regime, coalesce(k, 0) AS n_peers,
      md5(g.fund || ' in ' || g.period || ': ' || predicted_label || ' ' || g.isin || chr(10) || 'Market state: ' || coalesce(regime, 'UNKNOWN') || chr(10) || 'What moves such decisions:' || chr(10)
        || coalesce(lines, '') || chr(10) || 'The fund besides:' || chr(10) || coalesce(t, '')) AS text_md5
    FROM guess g CROSS JOIN cause_lines LEFT JOIN regimes r ON r.period = g.period LEFT JOIN peers5 p ON p.fund = g.fund AND p.isin = g.isin AND p.period = g.period""", "guess", "regimes", "peers5", "cause_lines"))
def decision_explanations(spark, sf):
    """Record and whole rendered text of every decision (ML16, JN11)."""
    x = _explained(spark, sf, _predicted(spark, sf))
    return x.select("fund", "isin", "period", "predicted_label", "regime", F.size("peers").cast("long").alias("n_peers"), F.md5("text").alias("text_md5"))


@query("counterfactual_texts", sql("""
    WITH c AS (SELECT g.*, e.variable AS known, coalesce(dml_theta, granger_beta) AS th, ci_lower_95 AS lo, ci_upper_95 AS hi,
                 CASE predicted_label WHEN 'SELL' THEN 1 WHEN 'BUY' THEN -1 ELSE 0 END * sign(coalesce(dml_theta, granger_beta, 0)) AS m
               FROM guess g LEFT JOIN evidence e ON e.variable = g.driver),
    n AS (SELECT *, CASE WHEN known IS NULL THEN NULL WHEN lo IS NULL OR hi IS NULL THEN 'interval unknown' WHEN lo > 0 OR hi < 0 THEN 'interval excludes zero' ELSE 'interval includes zero' END AS cf_confidence,
                 CASE WHEN known IS NULL THEN NULL WHEN m > 0 THEN 'higher' WHEN m < 0 THEN 'lower' ELSE 'different' END AS move FROM c)
    SELECT fund, isin, period, cf_confidence, move,
      md5('With ' || driver || ' ' || move || ', ' || predicted_label || ' on ' || isin || ' would be less likely (effect ' || coalesce(printf('%+.4f', th), 'unknown') || ', ' || cf_confidence || ')') AS text_md5 FROM n""", "guess", "evidence"))
def counterfactual_texts(spark, sf):
    """What-if direction, interval verdict and text of every decision, NULL without evidence (ML17)."""
    c = ex.counterfactuals(_predicted(spark, sf), _evidence(spark, sf))
    return c.select("fund", "isin", "period", "cf_confidence", F.col("cf_move").alias("move"), F.md5("counterfactual").alias("text_md5"))


@query("explanation_quality", sql(f"""
    SELECT count(*) AS n_explanations, {near_sql('avg((e.variable IS NOT NULL)::INT)')} AS avg_faithfulness, {near_sql('avg(coalesce(dml_significant, false)::INT)')} AS avg_ci_faithfulness,
      {near_sql('avg((icp_confidence IS NOT NULL)::INT)')} AS pct_with_icp_evidence, {near_sql('avg((dml_theta IS NOT NULL)::INT)')} AS pct_with_dml_ci, {near_sql('avg((granger_beta IS NOT NULL)::INT)')} AS pct_with_granger,
      {near_sql('avg((e.variable IS NOT NULL)::INT)')} AS pct_with_counterfactual, {near_sql("avg((coalesce(regime, 'UNKNOWN') <> 'UNKNOWN')::INT)")} AS pct_with_regime_context, {near_sql('avg((k IS NOT NULL)::INT)')} AS pct_with_portfolio_context,
      {near_sql('(1 + avg((icp_confidence IS NOT NULL)::INT) + avg((dml_theta IS NOT NULL)::INT) + avg((e.variable IS NOT NULL)::INT)) / 4')} AS explanation_completeness
    FROM guess g LEFT JOIN evidence e ON e.variable = g.driver LEFT JOIN regimes r ON r.period = g.period LEFT JOIN peers5 p ON p.fund = g.fund AND p.isin = g.isin AND p.period = g.period""", "guess", "evidence", "regimes", "peers5"))
def explanation_quality(spark, sf):
    """Faithfulness, evidence shares, completeness (ML18)."""
    d, ev = _predicted(spark, sf), _evidence(spark, sf)
    x = _explained(spark, sf, d)
    cf = ex.counterfactuals(d, ev).select("fund", "isin", "period", "counterfactual")
    cited = d.select("fund", "isin", "period", F.col("driver").alias("variable"))
    return rounded(ex.quality(cited, ev, x.join(cf, ["fund", "isin", "period"], "left")))
