"""Queries over prediction tables: agreement, comparison tests, ensemble, backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import backtest as bt
from panelwright.operators import evaluate as ev
from panelwright.plans import views as v
from panelwright.plans.registry import near_sql, query, round_sql, rounded
from panelwright.plans.sqlviews import sql, view

MODELS = ["hold", "previous", "rule"]


def _agree_view(name: str, keys: str) -> None:
    eq = " AND ".join(f"t.{k} = u.{k}" for k in keys.split(", "))
    view(name, ["predictions"], f"""
  SELECT {keys}, sum(tp) / sum(nt) AS accuracy, sum(nt * f1) / sum(nt) AS f1_weighted,
    (sum(tp) / sum(nt) - sum(nt * np) / (sum(nt) * sum(nt))) / nullif(1 - sum(nt * np) / (sum(nt) * sum(nt)), 0) AS kappa,
    max(CASE WHEN k = 2 AND nt > 0 THEN tp / nt END) AS buy_recall, max(CASE WHEN k = 0 AND nt > 0 THEN tp / nt END) AS sell_recall, CAST(sum(nt) AS BIGINT) AS n
  FROM (SELECT {keys}, k, tp, nt, np, CASE WHEN nt + np > 0 THEN 2 * tp / (nt + np) ELSE 0 END AS f1 FROM (
    SELECT {keys}, k, count(CASE WHEN actual = k AND predicted = k THEN 1 END)::DOUBLE AS tp, count(CASE WHEN actual = k THEN 1 END)::DOUBLE AS nt,
      count(CASE WHEN predicted = k THEN 1 END)::DOUBLE AS np FROM predictions, (SELECT unnest([0, 1, 2]) AS k) GROUP BY {keys}, k))
  GROUP BY {keys}""")


_agree_view("agree_model", "model")
_agree_view("agree_fold", "model, period")
_AGREE = "accuracy f1_weighted kappa buy_recall sell_recall"


@query("agreement_by_model", sql(f"SELECT model, n, {round_sql(_AGREE)} FROM agree_model", "agree_model"))
def agreement_by_model(spark, sf):
    """Accuracy, weighted F1, kappa and recalls per model (ML5, ML6, ML7)."""
    return rounded(ev.agreement(v.predictions(spark, sf), ["model"]))


@query("agreement_by_fold", sql(f"SELECT model, period, n, {round_sql(_AGREE)} FROM agree_fold", "agree_fold"))
def agreement_by_fold(spark, sf):
    """The same per model and month (ML5)."""
    return rounded(ev.agreement(v.predictions(spark, sf), ["model", "period"]))


@query("class_report", sql(f"""
    SELECT model, k AS label, CAST(nt AS BIGINT) AS support, CAST(np AS BIGINT) AS n_predicted, CAST(tp AS BIGINT) AS tp,
      {near_sql('CASE WHEN np > 0 THEN tp / np ELSE 0 END')} AS precision, {near_sql('CASE WHEN nt > 0 THEN tp / nt ELSE 0 END')} AS recall, {near_sql('2 * tp / (nt + np)')} AS f1
    FROM (SELECT model, k, count(CASE WHEN actual = k AND predicted = k THEN 1 END)::DOUBLE AS tp, count(CASE WHEN actual = k THEN 1 END)::DOUBLE AS nt,
      count(CASE WHEN predicted = k THEN 1 END)::DOUBLE AS np FROM predictions, (SELECT unnest([0, 1, 2]) AS k) GROUP BY model, k) WHERE nt + np > 0""", "predictions"))
def class_report(spark, sf):
    """Per-class support, precision, recall and F1 (ML5)."""
    return rounded(ev.class_report(ev.confusion(v.predictions(spark, sf), ["model"]), ["model"]))


@query("mcnemar", sql(f"""
    WITH c AS (SELECT fund, isin, period, max(CASE WHEN model = 'hold' THEN (predicted = actual)::INT END) AS hold, max(CASE WHEN model = 'previous' THEN (predicted = actual)::INT END) AS previous,
      max(CASE WHEN model = 'rule' THEN (predicted = actual)::INT END) AS rule FROM predictions GROUP BY ALL),
    p AS (SELECT 'hold' AS model_a, 'previous' AS model_b, count(CASE WHEN hold = 1 AND previous = 0 THEN 1 END) AS a_only, count(CASE WHEN hold = 0 AND previous = 1 THEN 1 END) AS b_only FROM c
      UNION ALL SELECT 'hold', 'rule', count(CASE WHEN hold = 1 AND rule = 0 THEN 1 END), count(CASE WHEN hold = 0 AND rule = 1 THEN 1 END) FROM c
      UNION ALL SELECT 'previous', 'rule', count(CASE WHEN previous = 1 AND rule = 0 THEN 1 END), count(CASE WHEN previous = 0 AND rule = 1 THEN 1 END) FROM c)
    SELECT *, {near_sql('CASE WHEN a_only + b_only = 0 THEN 0 WHEN a_only + b_only < 25 THEN a_only ELSE pow(abs(a_only - b_only) - 1, 2) / (a_only + b_only) END')} AS statistic,
      CASE WHEN a_only + b_only = 0 THEN 'none' WHEN a_only + b_only < 25 THEN 'exact_binomial' ELSE 'chi2_continuity_corrected' END AS method FROM p""", "predictions"))
def mcnemar(spark, sf):
    """Pairwise disagreement test (CS21)."""
    return rounded(ev.mcnemar(v.predictions(spark, sf), MODELS))


def _folds(spark, sf):
    return ev.agreement(v.predictions(spark, sf), ["model", "period"]).withColumnRenamed("period", "fold")


@query("fold_ranks", sql("""
    SELECT model, period AS fold, rank() OVER (PARTITION BY period ORDER BY round(accuracy, 12) DESC) + (count(*) OVER (PARTITION BY period, round(accuracy, 12)) - 1) / 2.0::DOUBLE AS rank FROM agree_fold""", "agree_fold"))
def fold_ranks(spark, sf):
    """Average ranks inside each fold, ties averaged (WN29)."""
    return ev.fold_ranks(_folds(spark, sf), "accuracy").select("model", "fold", "rank")


@query("friedman", sql(f"""
    WITH r AS (SELECT model, period, accuracy, rank() OVER (PARTITION BY period ORDER BY accuracy DESC) + (count(*) OVER (PARTITION BY period, accuracy) - 1) / 2.0::DOUBLE AS rank FROM agree_fold),
    m AS (SELECT model, avg(rank) AS mr, count(*) AS n FROM r GROUP BY 1),
    t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*) AS c FROM r GROUP BY period, accuracy))
    SELECT count(*) AS k, max(n) AS n, {near_sql('(12.0 * max(n) / (count(*) * (count(*) + 1)) * sum(mr * mr) - 3 * max(n) * (count(*) + 1)) / (1 - max(ties) / (max(n) * count(*) * (count(*) * count(*) - 1)))')} AS statistic,
      {near_sql('exp(-(12.0 * max(n) / (count(*) * (count(*) + 1)) * sum(mr * mr) - 3 * max(n) * (count(*) + 1)) / (1 - max(ties) / (max(n) * count(*) * (count(*) * count(*) - 1))) / 2)')} AS p_value
    FROM m, t""", "agree_fold"))
def friedman(spark, sf):
    """Tie-corrected rank statistic over folds; three models, so its tail is exp(-x / 2) (CS22)."""
    return rounded(ev.friedman(_folds(spark, sf), "accuracy"))


@query("nemenyi", sql(f"""
    WITH r AS (SELECT model, period, rank() OVER (PARTITION BY period ORDER BY accuracy DESC) + (count(*) OVER (PARTITION BY period, accuracy) - 1) / 2.0::DOUBLE AS rank FROM agree_fold),
    m AS (SELECT model, avg(rank) AS r, count(*) AS n FROM r GROUP BY 1)
    SELECT a.model AS model_a, b.model AS model_b, {near_sql('abs(a.r - b.r)')} AS rank_diff, {near_sql('2.343 * sqrt(12 / (6.0 * a.n))')} AS critical_diff,
      abs(a.r - b.r) > 2.343 * sqrt(12 / (6.0 * a.n)) AND (SELECT exp(-(max(n) * sum(r * r) - 12 * max(n)) / (1 - max(ties) / (24.0 * max(n))) / 2) < 0.05
        FROM m, (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*) AS c FROM agree_fold GROUP BY period, accuracy))) AS significant
    FROM m a JOIN m b ON a.model < b.model""", "agree_fold"))
def nemenyi(spark, sf):
    """Mean-rank differences against the critical difference (CS22)."""
    return rounded(ev.nemenyi(_folds(spark, sf), "accuracy"))


@query("paired_comparison", sql(f"""
    WITH j AS (SELECT a.model AS model_a, b.model AS model_b, a.accuracy AS sa, b.accuracy AS sb FROM agree_fold a JOIN agree_fold b ON a.period = b.period AND a.model < b.model)
    SELECT model_a, model_b, count(*) AS n_folds, {near_sql('avg(sa)')} AS mean_a, {near_sql('avg(sb)')} AS mean_b, {near_sql('avg(sa - sb) / (stddev_samp(sa - sb) / sqrt(count(*)))')} AS t_stat,
      {near_sql('(avg(sa) - avg(sb)) / sqrt((var_samp(sa) + var_samp(sb)) / 2)')} AS cohens_d,
      CASE WHEN abs((avg(sa) - avg(sb)) / sqrt((var_samp(sa) + var_samp(sb)) / 2)) < 0.2 THEN 'negligible' WHEN abs((avg(sa) - avg(sb)) / sqrt((var_samp(sa) + var_samp(sb)) / 2)) < 0.5 THEN 'small'
        WHEN abs((avg(sa) - avg(sb)) / sqrt((var_samp(sa) + var_samp(sb)) / 2)) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude
    FROM j GROUP BY ALL""", "agree_fold"))
def paired_comparison(spark, sf):
    """Paired t and effect size per model pair (CS23)."""
    return rounded(ev.paired_comparison(_folds(spark, sf), "accuracy"))


@query("comparison_report")
def comparison_report(spark, sf):
    """All pairs: paired t with Bonferroni correction, effect size, McNemar with p-values (CS24)."""
    return rounded(ev.comparison_report(v.predictions(spark, sf), MODELS))


@query("bootstrap_intervals")
def bootstrap_intervals(spark, sf):
    """Bias-corrected accelerated intervals from the confusion counts (CS20)."""
    return rounded(ev.bootstrap_table(v.predictions(spark, sf)))


view("ens", ["predictions"], """
  SELECT 'ensemble' AS model, fund, isin, period, actual, CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS predicted FROM (
    SELECT fund, isin, period, actual, count(CASE WHEN predicted = 0 THEN 1 END) AS c0, count(CASE WHEN predicted = 1 THEN 1 END) AS c1, count(CASE WHEN predicted = 2 THEN 1 END) AS c2
    FROM predictions GROUP BY ALL HAVING count(*) = 3)""")


@query("majority_vote", sql("SELECT fund, isin, period, actual, predicted, model FROM ens", "ens"))
def majority_vote(spark, sf):
    """Ensemble by majority, smallest class on ties (ML11, JN12)."""
    return ev.majority_vote(v.predictions(spark, sf))


view("bt_rows", ["predictions", "returns"], """
  SELECT p.*, coalesce(r.real_return, 0) AS real_return FROM predictions p LEFT JOIN returns r USING (isin, period)""")
view("bt_sets", ["predictions"], """
  SELECT model, period, coalesce(list(DISTINCT isin) FILTER (predicted = 2), []) AS s FROM predictions GROUP BY model, period""")
view("bt_turn", ["bt_sets"], """
  SELECT model, period, CASE WHEN p IS NULL OR len(p) = 0 THEN 1.0 ELSE 1 - len(list_intersect(s, p)) / greatest(len(list_distinct(list_concat(s, p))), 1)::DOUBLE END AS turnover
  FROM (SELECT *, lag(s) OVER (PARTITION BY model ORDER BY period) AS p FROM bt_sets)""")
view("bt", ["bt_rows", "bt_turn"], """
  SELECT model, period, coalesce(avg(CASE WHEN predicted = 2 THEN real_return END), 0) AS gross_return, avg(real_return) AS benchmark_return,
    count(CASE WHEN predicted = 2 THEN 1 END) AS n_buy, max(turnover) AS turnover,
    coalesce(avg(CASE WHEN predicted = 2 THEN real_return END), 0) - max(turnover) * 0.01 AS net_return
  FROM bt_rows JOIN bt_turn USING (model, period) GROUP BY model, period""")


@query("monthly_backtest", sql(f"SELECT model, period, n_buy, {round_sql('gross_return benchmark_return turnover net_return')} FROM bt", "bt"))
def monthly_backtest(spark, sf):
    """Gross, net and benchmark return with turnover cost (ML8, JN13, WN32)."""
    return rounded(bt.monthly_backtest(v.predictions(spark, sf), v.returns(spark, sf)))


@query("turnover", sql(f"SELECT model, period, {round_sql('turnover')} FROM bt_turn", "bt_turn"))
def turnover(spark, sf):
    """1 - Jaccard of consecutive buy sets (WN32)."""
    return rounded(bt.turnover(v.predictions(spark, sf)))


view("bt_dd", ["bt"], """
  SELECT *, growth / max(growth) OVER (PARTITION BY model ORDER BY period) - 1 AS drawdown FROM (
    SELECT *, product(1 + net_return) OVER (PARTITION BY model ORDER BY period) AS growth, product(1 + benchmark_return) OVER (PARTITION BY model ORDER BY period) AS bgrowth FROM bt)""")


@query("drawdowns", sql(f"SELECT model, period, {near_sql('ln(growth)', 5)} AS log_growth, {round_sql('drawdown', 5)} FROM bt_dd", "bt_dd"))
def drawdowns(spark, sf):
    """Cumulative growth, running peak and drawdown (WN30)."""
    d = bt.drawdowns(bt.monthly_backtest(v.predictions(spark, sf), v.returns(spark, sf)))
    return rounded(d.select("model", "period", F.log("growth").alias("log_growth"), "drawdown"), 5)


_PERF = "annualized_return sharpe_ratio sortino_ratio information_ratio max_drawdown calmar_ratio hit_rate avg_turnover log_cumulative log_benchmark"


@query("performance", sql(f"""
    WITH a AS (SELECT model, count(*) AS n, arg_max(growth, period) AS g, arg_max(bgrowth, period) AS bg, avg(net_return - 0.005) AS e, stddev_pop(net_return - 0.005) AS s,
      count(CASE WHEN net_return < 0.005 THEN 1 END) AS nd, stddev_pop(CASE WHEN net_return - 0.005 < 0 THEN net_return - 0.005 END) AS sd, avg(net_return - benchmark_return) AS ac,
      stddev_pop(net_return - benchmark_return) AS sa, min(drawdown) AS max_drawdown, avg((net_return > 0)::INT) AS hit_rate, avg(turnover) AS avg_turnover FROM bt_dd GROUP BY model),
    b AS (SELECT *, pow(g, 12.0 / n) - 1 AS annualized_return, CASE WHEN s > 0 THEN e / s * sqrt(12) ELSE 0 END AS sharpe_ratio FROM a),
    c AS (SELECT *, CASE WHEN nd > 1 THEN CASE WHEN sd > 0 THEN e / sd * sqrt(12) ELSE 0 END ELSE 2 * sharpe_ratio END AS sortino_ratio,
      CASE WHEN sa > 0 THEN ac / sa * sqrt(12) ELSE 0 END AS information_ratio, CASE WHEN max_drawdown <> 0 THEN annualized_return / abs(max_drawdown) ELSE 0 END AS calmar_ratio,
      ln(g) AS log_cumulative, ln(bg) AS log_benchmark FROM b)
    SELECT model, n AS n_months, {round_sql(_PERF, 5)} FROM c""", "bt_dd"))
def performance(spark, sf):
    """Cumulative, annualised, Sharpe, Sortino, information, drawdown, Calmar, hit rate (ML10)."""
    p = bt.performance(bt.monthly_backtest(v.predictions(spark, sf), v.returns(spark, sf)))
    p = p.withColumns({"log_cumulative": F.log(F.col("cumulative_return") + 1), "log_benchmark": F.log(F.col("benchmark_cumulative") + 1)})
    return rounded(p.select("model", "n_months", *_PERF.split()), 5)
