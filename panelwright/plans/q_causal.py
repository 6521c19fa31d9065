"""Queries over environments, invariance, cross-fitted effects and coherence of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import coherence as co
from panelwright.operators import effects as ef
from panelwright.operators import graph as gp
from panelwright.operators import invariance as iv
from panelwright.operators import parents as ip
from panelwright.plans import views as v
from panelwright.plans.registry import near_sql, query, round_sql, rounded
from panelwright.plans.sqlviews import EVIDENCE, sql, view

view("env", ["decisions"], """
  SELECT d.*, 'Q' || CAST((CAST(substr(period, 6, 2) AS INT) - 1) // 3 + 1 AS VARCHAR) || '__' ||
    CASE WHEN coalesce(index_return, 0) <= -0.02 THEN 'bear' WHEN coalesce(index_return, 0) <= 0.02 THEN 'flat' ELSE 'bull' END || '__' ||
    CASE WHEN period <= (SELECT p FROM (SELECT period AS p, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT period FROM decisions)) WHERE i = n // 2)
      THEN 'early' ELSE 'late' END AS environment FROM decisions d""")


@query("environments", sql("SELECT environment, count(*) AS n FROM env GROUP BY environment HAVING count(*) >= 150", "env"))
def environments(spark, sf):
    """Quarter x market move x half labels, small ones dropped (CS7, FLT6)."""
    e = iv.filter_environments(iv.add_environment(v.decisions(spark, sf), "index_return"))
    return e.groupBy("environment").agg(F.count("*").alias("n"))


_MI = ["pct_nav", "quantity", "holding_tenure", "rsi", "pe", "consensus_count"]


@query("binned_information", sql("""
    WITH l AS (SELECT variable, value, action_ordinal AS y FROM (SELECT action_ordinal, """ + ", ".join(f"{c}::DOUBLE AS {c}" for c in _MI) + """ FROM decisions)
               UNPIVOT (value FOR variable IN (""" + ", ".join(_MI) + """))),
    q AS (SELECT variable, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM l GROUP BY variable),
    b AS (SELECT variable, len(list_filter(e, lambda x: x < value)) AS bin, y, count(*) AS n FROM l JOIN q USING (variable) GROUP BY ALL),
    m AS (SELECT variable, n, sum(n) OVER (PARTITION BY variable) AS t, sum(n) OVER (PARTITION BY variable, bin) AS nb, sum(n) OVER (PARTITION BY variable, y) AS ny FROM b)
    SELECT variable, """ + near_sql("sum(n / t * ln(n * t::DOUBLE / (nb * ny)))") + " AS mi FROM m GROUP BY variable", "decisions"))
def binned_information(spark, sf):
    """Mutual information with the decision over equal-frequency bins (CS10)."""
    return rounded(iv.binned_information(v.decisions(spark, sf), "action_ordinal", _MI))


@query("ks_between_groups", sql("""
    WITH a AS (SELECT fund_type AS g, pct_nav AS x, count(*) AS n FROM decisions GROUP BY ALL),
    x AS (SELECT DISTINCT x FROM a), g AS (SELECT g, sum(n) AS t FROM a GROUP BY g),
    c AS (SELECT g.g, x.x, sum(coalesce(a.n, 0)) OVER (PARTITION BY g.g ORDER BY x.x) / g.t AS f, g.t FROM g CROSS JOIN x LEFT JOIN a ON a.g = g.g AND a.x = x.x)
    SELECT p.g AS a, q.g AS b, """ + near_sql("max(abs(p.f - q.f))") + """ AS ks, CAST(max(p.t) AS BIGINT) AS n_a, CAST(max(q.t) AS BIGINT) AS n_b
    FROM c p JOIN c q ON p.x = q.x AND p.g < q.g GROUP BY ALL""", "decisions"))
def ks_between_groups(spark, sf):
    """Exact two-sample KS distance of every pair of groups by bucketed running counts (CS11)."""
    d = v.decisions(spark, sf).groupBy("fund_type", "pct_nav").agg(F.count("*").alias("n"))
    groups = ["large cap", "mid cap", "small cap"]
    return rounded(iv.ks_between(d, [], "fund_type", "pct_nav", "n", groups))


_CAND = ["rsi", "monthly_return", "pe", "sentiment_mean", "vix", "cpi", "volume_ratio"]


_BLANKET = [*_CAND, "holding_tenure", "quantity", "market_cap"]


@query("blanket_first_step", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS n, round(corr({c}, action_ordinal), 6) + 0.0::DOUBLE AS r FROM decisions" for c in _BLANKET), "decisions"))
def blanket_first_step(spark, sf):
    """Correlation of every candidate with the decision over the rows that have both (CS8)."""
    got = iv.complete_covariances(v.decisions(spark, sf), ["action_ordinal"], _BLANKET)
    rows = [(c, n, float(m[0, 1] / (m[0, 0] * m[1, 1]) ** 0.5)) for c, (n, m) in got.items()]
    return rounded(spark.createDataFrame(rows, "variable string, n long, r double"))


@query("markov_blanket")
def markov_blanket(spark, sf):
    """Grow-shrink blankets of the three targets, every test on all rows it can use (CS8, CS9)."""
    rows = [(t, i, c) for t, found in v.blankets(spark, sf).items() for i, c in enumerate(found)]
    return spark.createDataFrame(rows, "target string, pos int, variable string")


@query("invariant_parents")
def invariant_parents(spark, sf):
    """All subsets of up to three of 30 candidates, per stratum and target, at the primary threshold (CS12)."""
    return rounded(v.fitted_parents(spark, sf).where(F.col("alpha") == iv.ALPHA_PRIMARY).drop("alpha"))


@query("invariance_thresholds")
def invariance_thresholds(spark, sf):
    """Threshold sweep and stability of the same searches (CS13)."""
    p = v.fitted_parents(spark, sf)
    keys = ["stratum", "target", "variable"]
    return rounded(p.join(ip.threshold_stability(p), keys, "left"))


@query("soft_intersection", sql(f"""
    SELECT variable, count(DISTINCT stratum) AS n_sets, {near_sql('count(DISTINCT stratum) / (SELECT count(DISTINCT stratum) FROM parents WHERE confidence >= 0.15)::DOUBLE')} AS share
    FROM parents WHERE confidence >= 0.15 GROUP BY variable
    HAVING count(DISTINCT stratum) / (SELECT count(DISTINCT stratum) FROM parents WHERE confidence >= 0.15)::DOUBLE >= 0.8""", "parents"))
def soft_intersection(spark, sf):
    """Variables in at least 80 percent of the sets (SET4)."""
    return rounded(iv.frequent_members(v.parents(spark, sf).where(F.col("confidence") >= 0.15), "stratum", "variable"))


@query("confounder_scores", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS control, round(corr({c}, pct_nav), 5) + 0.0::DOUBLE AS r_t, round(corr({c}, action_ordinal), 5) + 0.0::DOUBLE AS r_y, "
    f"round(abs(corr({c}, pct_nav)) + abs(corr({c}, action_ordinal)), 5) AS score FROM decisions" for c in EVIDENCE if c != "pct_nav"), "decisions"))
def confounder_scores(spark, sf):
    """Controls scored by correlation with treatment and outcome (CS14)."""
    return rounded(ef.confounder_scores(v.decisions(spark, sf), "pct_nav", "action_ordinal", EVIDENCE), 5)


@query("double_ml_linear", sql(f"""
    WITH d AS (SELECT action_ordinal AS y, pct_nav AS t, consensus_count::DOUBLE AS x, month_ord % 5 AS f FROM decisions),
    m AS (SELECT k.f, regr_slope(d.y, d.x) AS sl_y, regr_intercept(d.y, d.x) AS ic_y, regr_slope(d.t, d.x) AS sl_t, regr_intercept(d.t, d.x) AS ic_t
          FROM (SELECT DISTINCT f FROM d) k JOIN d ON d.f <> k.f GROUP BY k.f),
    r AS (SELECT y - ic_y - sl_y * x AS ry, t - ic_t - sl_t * x AS rt FROM d JOIN m USING (f)),
    h AS (SELECT sum(rt * ry) / sum(rt * rt) AS theta, sum(rt * rt) AS tt, count(*) AS n FROM r)
    SELECT n, {near_sql('theta')} AS theta, {near_sql('sqrt(n * vp) / tt')} AS se, {near_sql('sqrt(vp / tt)')} AS se_simple
    FROM (SELECT n, theta, tt, var_pop((ry - theta * rt) * rt) AS vp FROM r, h GROUP BY ALL)""", "decisions"))
def double_ml_linear(spark, sf):
    """Cross-fitted effect with least-squares nuisances on given folds (CS15)."""
    d = v.decisions(spark, sf).select(
        F.col("action_ordinal").alias("y"), F.col("pct_nav").alias("t"), F.col("consensus_count").cast("double").alias("x"), (F.col("month_ord") % 5).alias("f")
    )
    return rounded(ef.theta_from_residuals(ef.linear_residuals(d, "y", "t", ["x"], "f")))


@query("double_ml_bivariate", sql(f"""
    WITH d AS (SELECT is_sell - avg(is_sell) OVER () AS y, pct_nav - avg(pct_nav) OVER () AS t FROM decisions),
    h AS (SELECT sum(t * y) / sum(t * t) AS theta, sum(t * t) AS tt, count(*) AS n FROM d),
    e AS (SELECT n, theta, sqrt(n * var_pop((y - theta * t) * t)) / tt AS se, sqrt(var_pop((y - theta * t) * t) / tt) AS ss FROM d, h GROUP BY n, theta, tt)
    SELECT 'pct_nav' AS treatment, 'is_sell' AS outcome, 0 AS n_controls, n AS n_obs, {near_sql('theta')} AS theta_hat, {near_sql('se')} AS std_error, {near_sql('ss')} AS se_simple,
      {near_sql('theta - 1.96 * se')} AS ci_lower_95, {near_sql('theta + 1.96 * se')} AS ci_upper_95,
      theta - 1.96 * se > 0 OR theta + 1.96 * se < 0 AS significant, CASE WHEN theta > 0 THEN 'positive' ELSE 'negative' END AS direction FROM e""", "decisions"))
def double_ml_bivariate(spark, sf):
    """Fallback without controls (CS15)."""
    return rounded(ef.double_ml(v.decisions(spark, sf), "is_sell", "pct_nav", [], ["fund", "isin", "period"]))


@query("double_ml_forest")
def double_ml_forest(spark, sf):
    """Cross-fitting with random-forest nuisances, flagged against the parents (CS15)."""
    d = v.decisions(spark, sf)
    controls = ef.select_controls(d, "rsi", "is_buy", ["holding_tenure", "pe", "vix", "volume_ratio"], 3)
    small = {"numTrees": 5, "maxDepth": 3, "minInstancesPerNode": 20}
    est = ef.double_ml(d, "is_buy", "rsi", controls, ["fund", "isin", "period"], repeats=1, folds=2, params=small)
    return rounded(ef.flag_certified(est, v.parents(spark, sf)))


@query("effects_of_all_treatments")
def effects_of_all_treatments(spark, sf):
    """Cross-fitted effects of all treatments on three outcomes, three repeats of five folds (CS15, CS16)."""
    return rounded(v.fitted_effects(spark, sf))


@query("fitted_coherence")
def fitted_coherence(spark, sf):
    """Theory coherence of the fitted links of every stratum together (CS17)."""
    return rounded(co.coherence(co.target_links(v.fitted_links(spark, sf))))


@query("fitted_consensus")
def fitted_consensus(spark, sf):
    """Variables confirmed by fitted links, parents and effects (CS17)."""
    links, parents, effects = v.evidence(spark, sf)
    return co.consensus(co.method_variables(co.target_links(links), parents, effects))


@query("fitted_stability")
def fitted_stability(spark, sf):
    """Stratified stability of the fitted parents, signs from the fitted links (CS18)."""
    parents = v.fitted_parents(spark, sf).where(F.col("alpha") == iv.ALPHA_PRIMARY).drop("alpha")  # effects take no part
    real = parents.where("stratum <> 'pooled' AND target = 'action_ordinal'")
    return rounded(co.stability(co.target_links(v.fitted_links(spark, sf)), real))


@query("fitted_feature_sets")
def fitted_feature_sets(spark, sf):
    """Set algebra over the variables that the fitted methods and the blankets found (SET2, ML13)."""
    links, parents, effects = v.evidence(spark, sf)
    found = sorted({c for cs in v.blankets(spark, sf).values() for c in cs})
    blanket = spark.createDataFrame([(c,) for c in found], "variable string")
    everything = spark.createDataFrame([(c,) for c in v.NUMERIC], "variable string")
    return co.feature_sets(links, parents, effects, blanket, everything)


@query("fitted_causal_graph")
def fitted_causal_graph(spark, sf):
    """Causal edges from the fitted evidence, by kind and stratum (GR5)."""
    e = gp.causal_edges(*v.evidence(spark, sf))
    return e.groupBy("etype", F.col("attrs")["stratum"].alias("stratum")).agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_sources"))


@query("fitted_competency")
def fitted_competency(spark, sf):
    """The ten questions asked of the fitted graph (GR8, AG27)."""
    links, parents, effects = v.evidence(spark, sf)
    return rounded(gp.competency(gp.causal_edges(links.where("significant"), parents, effects)))


_SIGN = "CASE cause_group WHEN 'price_momentum' THEN 1 WHEN 'trend' THEN 1 WHEN 'sentiment' THEN 1 WHEN 'macro_rates' THEN -1 WHEN 'macro_equity' THEN 1 WHEN 'risk' THEN -1 ELSE 0 END"
view("coh", ["links"], f"""
  SELECT *, CASE WHEN p_fdr < 0.05 THEN 1 ELSE 0 END AS fs, {_SIGN} AS es,
    CASE WHEN {_SIGN} = 0 THEN 0.5 WHEN sign(beta) = {_SIGN} THEN 1.0 ELSE 0.0 END AS sa FROM links WHERE edge_type = 'GRANGER_CAUSES' AND target = 'action_ordinal'""")


@query("theory_coherence", sql(f"""
    SELECT {near_sql('avg(fs * sa)')} AS coherence, {near_sql('CASE WHEN sum(fs * abs(beta)) > 1e-9 THEN sum(fs * abs(beta) * sa) / sum(fs * abs(beta)) ELSE 0 END')} AS coherence_weighted,
      count(*) AS n_edges, sum(fs) AS n_fdr_significant, count(CASE WHEN fs = 1 AND sa = 1 THEN 1 END) AS n_theory_aligned,
      count(CASE WHEN fs = 1 AND sa = 0 AND es <> 0 THEN 1 END) AS n_contrarian, {near_sql('avg(sa)')} AS pct_sign_agreement, 1.0::DOUBLE AS pct_domain_grounded FROM coh""", "coh"))
def theory_coherence(spark, sf):
    """Agreement of link signs with theory, uniform and weighted (CS17)."""
    out = co.coherence(co.target_links(v.links(spark, sf)))
    return out.withColumns({c: F.round(F.col(c) + 1.7e-9, 6) + F.lit(0.0) for c in ("coherence", "coherence_weighted", "pct_sign_agreement")})


@query("method_consensus", sql("""
    WITH m AS (SELECT DISTINCT 'g' AS k, cause AS v FROM coh WHERE fs = 1 UNION SELECT 'i', variable FROM parents WHERE confidence >= 0.15
      UNION SELECT 'd', treatment FROM effects WHERE outcome = 'action_ordinal' AND significant),
    f AS (SELECT v, max(k = 'g') AS g, max(k = 'i') AS i, max(k = 'd') AS d FROM m GROUP BY v)
    SELECT count(CASE WHEN g AND NOT i AND NOT d THEN 1 END) AS granger_only, count(CASE WHEN g AND i THEN 1 END) AS granger_and_icp,
      count(CASE WHEN g AND d THEN 1 END) AS granger_and_dml, count(CASE WHEN g AND i AND d THEN 1 END) AS all_three FROM f""", "coh", "parents", "effects"))
def method_consensus(spark, sf):
    """Variables confirmed by several methods (CS17)."""
    l = co.target_links(v.links(spark, sf))
    return co.consensus(co.method_variables(l, v.parents(spark, sf), v.effects(spark, sf)))


@query("feature_set_variants", sql("""
    WITH g AS (SELECT DISTINCT cause AS v FROM links WHERE p_value < 0.05), i10 AS (SELECT DISTINCT variable AS v FROM parents WHERE confidence >= 0.10),
    i25 AS (SELECT DISTINCT variable AS v FROM parents WHERE confidence >= 0.25), i50 AS (SELECT DISTINCT variable AS v FROM parents WHERE confidence >= 0.5),
    d AS (SELECT DISTINCT treatment AS v FROM effects WHERE significant), m AS (SELECT DISTINCT variable AS v FROM parents WHERE in_intersection),
    a AS (SELECT DISTINCT treatment AS v FROM effects UNION SELECT DISTINCT cause FROM links)
    SELECT 'granger_only' AS feature_set, v AS variable FROM g UNION ALL SELECT 'icp_only_conf25', v FROM i25 UNION ALL SELECT 'icp_only_conf50', v FROM i50
    UNION ALL SELECT 'icp_only_conf10', v FROM i10 UNION ALL SELECT 'dml_only', v FROM d UNION ALL SELECT 'markov_blanket', v FROM m
    UNION ALL SELECT 'mb_union_dml', v FROM (SELECT v FROM m UNION SELECT v FROM d) UNION ALL SELECT 'mb_union_icp', v FROM (SELECT v FROM m UNION SELECT v FROM i25)
    UNION ALL SELECT 'granger_union_icp', v FROM (SELECT v FROM g UNION SELECT v FROM i25)
    UNION ALL SELECT 'all_causal_union', v FROM (SELECT v FROM g UNION SELECT v FROM i25 UNION SELECT v FROM d UNION SELECT v FROM m)
    UNION ALL SELECT 'all_causal_intersection', v FROM (SELECT v FROM g INTERSECT SELECT v FROM i25 INTERSECT SELECT v FROM d)
    UNION ALL SELECT 'dml_intersection_icp', v FROM (SELECT v FROM d INTERSECT SELECT v FROM i25)
    UNION ALL SELECT 'granger_intersection_dml', v FROM (SELECT v FROM g INTERSECT SELECT v FROM d) UNION ALL SELECT 'all_features', v FROM a""", "links", "parents", "effects"))
def feature_set_variants(spark, sf):
    """Set algebra over the variables of each method (SET2)."""
    l, p, e = v.links(spark, sf), v.parents(spark, sf), v.effects(spark, sf)
    blanket = p.where("in_intersection").select("variable")
    everything = e.select(F.col("treatment").alias("variable")).union(l.select("cause"))
    return co.feature_sets(l, p, e, blanket, everything)


@query("stratum_overlap", sql(f"""
    WITH v AS (SELECT DISTINCT stratum, variable FROM parents WHERE confidence >= 0.15), s AS (SELECT stratum, count(*) AS n FROM v GROUP BY 1)
    SELECT a.stratum AS s1, b.stratum AS s2, a.n AS n1, b.n AS n2, k.n_shared, {near_sql('k.n_shared / (a.n + b.n - k.n_shared)::DOUBLE')} AS jaccard
    FROM s a JOIN s b ON a.stratum < b.stratum CROSS JOIN LATERAL (SELECT count(*) AS n_shared FROM v x JOIN v y ON x.variable = y.variable WHERE x.stratum = a.stratum AND y.stratum = b.stratum) k""", "parents"))
def stratum_overlap(spark, sf):
    """Pairwise Jaccard of strata (SET3)."""
    return rounded(co.stratum_overlap(v.parents(spark, sf)))


@query("stratified_stability", sql(f"""
    WITH kp AS (SELECT * FROM parents WHERE confidence >= 0.15), v AS (SELECT DISTINCT stratum, variable FROM kp), s AS (SELECT stratum, count(*) AS n FROM v GROUP BY 1),
    j AS (SELECT coalesce(avg(k.c / (a.n + b.n - k.c)::DOUBLE), 0) AS j FROM s a JOIN s b ON a.stratum < b.stratum
      CROSS JOIN LATERAL (SELECT count(*) AS c FROM v x JOIN v y ON x.variable = y.variable WHERE x.stratum = a.stratum AND y.stratum = b.stratum) k),
    cv AS (SELECT variable, count(*) AS n, stddev_pop(confidence) / avg(confidence) AS cv FROM kp GROUP BY 1),
    st AS (SELECT coalesce(1 - avg(cv), 0.8) AS st FROM cv WHERE n >= 2),
    sg AS (SELECT cause, sign(sum(sign(beta))) AS dom FROM coh WHERE cause IN (SELECT variable FROM cv WHERE n = (SELECT count(DISTINCT stratum) FROM parents)) GROUP BY 1),
    cc AS (SELECT coalesce(avg(sh), 0.5) AS cc FROM (SELECT cause, avg(CASE WHEN sign(beta) = dom THEN 1.0 ELSE 0.0 END) AS sh FROM coh JOIN sg USING (cause) GROUP BY 1)),
    lp AS (SELECT coalesce(avg(CASE WHEN n >= 3 THEN 1.0 ELSE 0.0 END), 0) AS lp FROM (SELECT cause, count(DISTINCT lag) AS n FROM coh WHERE p_fdr < 0.05 GROUP BY 1))
    SELECT {near_sql('j')} AS jaccard_avg, {near_sql('cc')} AS sign_concordance, {near_sql('st')} AS stability, {near_sql('lp')} AS lag_persistence,
      {near_sql('j * cc * st')} AS stratified_stability, {near_sql('pow(j * cc * st, 0.7) * pow(lp, 0.3)')} AS composite FROM j, st, cc, lp""", "coh", "parents"))
def stratified_stability(spark, sf):
    """Overlap, sign concordance and confidence variation combined with lag persistence (CS18)."""
    return rounded(co.stability(co.target_links(v.links(spark, sf)), v.parents(spark, sf)))


@query("lag_half_stability", sql(f"""
    WITH l AS (SELECT list_sort(list(DISTINCT lag)) AS l FROM coh), h AS (SELECT cause, max(lag <= l[len(l) // 2]) AS e, max(lag > l[len(l) // 2]) AS t FROM coh, l GROUP BY cause)
    SELECT {near_sql('count(CASE WHEN e AND t THEN 1 END) / count(*)::DOUBLE')} AS jaccard_avg, {near_sql('0.7 * count(CASE WHEN e AND t THEN 1 END) / count(*)::DOUBLE')} AS stratified_stability FROM h""", "coh"))
def lag_half_stability(spark, sf):
    """Early against late lags when no strata exist (CS18)."""
    return rounded(co.lag_half_stability(co.target_links(v.links(spark, sf))))


@query("faithfulness", sql(f"""
    WITH im AS (SELECT treatment || '_lag1' AS variable, treatment AS base, abs(theta_hat / nullif(std_error, 0)) AS w FROM effects WHERE outcome = 'action_ordinal'),
    top AS (SELECT * FROM im ORDER BY w DESC, variable LIMIT 8),
    str AS (SELECT cause, max(abs(beta)) AS s FROM coh GROUP BY cause),
    cs AS (SELECT cause AS base FROM links WHERE edge_type = 'GRANGER_CAUSES' UNION SELECT variable FROM parents WHERE confidence >= 0.3),
    kt AS (SELECT * FROM str ORDER BY s DESC, cause LIMIT 8),
    sh AS (SELECT rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0 AS ri, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs FROM top JOIN str ON cause = base),
    r AS (SELECT count(*) AS n_shared, CASE WHEN count(*) >= 4 THEN coalesce(corr(ri, rs), 0) ELSE 0 END AS rho FROM sh),
    q AS (SELECT n_shared, rho, (SELECT count(*) FROM top WHERE base IN (SELECT base FROM cs)) / 8.0 AS g, (SELECT count(*) FROM kt WHERE cause IN (SELECT base FROM top)) / 8.0 AS c FROM r)
    SELECT n_shared, {near_sql('rho')} AS rho, {near_sql('g')} AS grounding_ratio, {near_sql('c')} AS causal_coverage, {near_sql('CASE WHEN g + c > 0 THEN 2 * g * c / (g + c) ELSE 0 END')} AS f1_grounding,
      {near_sql('CASE WHEN g + c > 0 THEN 2 * g * c / (g + c) ELSE 0 END * (rho + 1) / 2')} AS faithfulness FROM q""", "coh", "parents", "effects", "links"))
def faithfulness(spark, sf):
    """Do important features appear among the causes, and in the same order (CS19)."""
    e = v.effects(spark, sf).where(F.col("outcome") == "action_ordinal")
    imp = e.select(F.concat("treatment", F.lit("_lag1")).alias("variable"), F.abs(F.col("theta_hat") / F.nullif(F.col("std_error"), F.lit(0.0))).alias("importance"))
    return rounded(co.faithfulness(imp, v.links(spark, sf), v.parents(spark, sf), 8))
