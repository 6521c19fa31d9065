import itertools

import numpy as np
import pandas as pd

from panelwright.functions import tails
from panelwright.operators import evaluate as ev
from panelwright.operators import features as ft
from panelwright.operators import granger as gr
from panelwright.operators import invariance as iv
from panelwright.operators import regression as rg


def test_tails_against_published_values():
    assert abs(tails.t_two_sided(2.228, 10) - 0.05) < 1e-4
    assert abs(tails.t_two_sided(1.96, 1e7) - 0.05) < 1e-4
    assert abs(tails.chi2_tail(3.841, 1) - 0.05) < 1e-4
    assert abs(tails.normal_ppf(0.975) - 1.959964) < 1e-6
    assert abs(tails.binomial_two_sided(2, 10) - 0.109375) < 1e-9
    assert abs(tails.kolmogorov_tail(0.5, 10_000, 10_000)) < 1e-12
    assert tails.kolmogorov_tail(0.0, 50, 50) == 1.0


def test_panel_regression_matches_dummy_variables(spark):
    rng = np.random.default_rng(0)
    g = np.repeat(np.arange(8), 40)
    x1, x2 = rng.normal(size=320), rng.normal(size=320)
    y = 0.5 * x1 - 0.2 * x2 + g * 0.3 + rng.normal(size=320)
    pdf = pd.DataFrame({"isin": g.astype(str), "y": y, "x1": x1, "x2": x2, "h": 1})
    r = rg.panel_ols(spark.createDataFrame(pdf), ["h"], "isin", "y", ["x1", "x2"]).first()
    m = pdf.groupby("isin")[["y", "x1", "x2"]].transform("mean")
    d = pdf[["y", "x1", "x2"]] - m
    X, Y = d[["x1", "x2"]].to_numpy(), d["y"].to_numpy()
    beta = np.linalg.solve(X.T @ X, X.T @ Y)
    e = Y - X @ beta
    meat = sum(np.outer(X[g == i].T @ e[g == i], X[g == i].T @ e[g == i]) for i in range(8))
    inv = np.linalg.inv(X.T @ X)
    se = np.sqrt(np.diag(320 / 318 * inv @ meat @ inv))
    assert np.allclose(r["beta"], beta) and np.allclose(r["se"], se)
    assert abs(r["rsquared"] - (1 - e @ e / (Y @ Y))) < 1e-9


def test_false_discovery_adjustment(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.2]
    df = spark.createDataFrame([("t", str(i), i, v) for i, v in enumerate(p)], "target string, cause string, lag int, p_value double")
    got = {r["lag"]: r["p_fdr"] for r in gr.adjust_p(df, ["target"]).collect()}
    order = np.argsort(p)
    adj = np.minimum.accumulate((np.array(p)[order] * 5 / np.arange(1, 6))[::-1])[::-1]
    assert np.allclose([got[i] for i in order], adj)


def test_partial_correlation_equals_residual_correlation():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(500, 2))
    x, y = z @ [1, 2] + rng.normal(size=500), z @ [0.5, -1] + rng.normal(size=500)
    cov = np.cov(np.column_stack([x, y, z]), rowvar=False)
    r, p = iv.partial_correlation(cov, 500, 0, 1, [2, 3])
    q = np.column_stack([np.ones(500), z])
    rx, ry = x - q @ np.linalg.lstsq(q, x, rcond=None)[0], y - q @ np.linalg.lstsq(q, y, rcond=None)[0]
    assert abs(r - np.corrcoef(rx, ry)[0, 1]) < 1e-9 and 0 <= p <= 1


def test_ks_distance_against_brute_force(spark):
    rng = np.random.default_rng(2)
    samples = {"a": rng.normal(size=300).round(2), "b": rng.normal(0.3, 1, 200).round(2), "c": rng.uniform(-1, 1, 150).round(2)}
    rows = [(g, float(v), 1) for g, vs in samples.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    got = {(r["a"], r["b"]): r["ks"] for r in iv.ks_between(df, [], "g", "v", "n", ["a", "b", "c"], buckets=5).collect()}
    for a, b in itertools.combinations("abc", 2):
        grid = np.concatenate([samples[a], samples[b]])
        f = lambda s: np.array([(s <= x).mean() for x in grid])
        assert abs(got[(a, b)] - np.abs(f(samples[a]) - f(samples[b])).max()) < 1e-12


def test_greedy_pruning_protects():
    r = {("a", "b"): 0.99, ("a", "c"): 0.1, ("b", "c"): 0.2}
    assert ft.greedy_prune(["a", "b", "c"], r, 0.95, {"a"}) == ["b"]
    assert ft.greedy_prune(["a", "b", "c"], r, 0.95, set()) == ["b"]


def test_feature_groups():
    g = ft.assign_groups(["rsi", "pe_relative", "pct_nav_lag1", "isin", "odd"])
    assert g["technical"] == ["rsi"] and g["causal_lags"] == ["pct_nav_lag1"] and g["other"] == ["odd"]


def test_bootstrap_interval_brackets_point():
    cells = np.array([[40, 5, 5], [6, 30, 4], [3, 3, 54]])
    for m in ("accuracy", "f1_weighted", "f1_macro", "kappa"):
        b = ev.bca_interval(cells, m)
        assert b["ci_lower"] <= b["point_estimate"] <= b["ci_upper"]
    assert abs(ev.bca_interval(cells, "accuracy")["point_estimate"] - 124 / 150) < 1e-12
