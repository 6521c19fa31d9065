"""Quantiles by digits against numpy, and the screening of subsets by two environments."""

import numpy as np
from pyspark.sql import functions as F

from panelwright.operators import parents as ip
from panelwright.operators import skew

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def test_quantiles_of_overlapping_groups(spark, monkeypatch):
    monkeypatch.setattr(skew, "CHUNK", 150)
    r = np.random.default_rng(4)
    rows = []
    for i in range(701):
        a = float(r.normal() * 10.0 ** int(r.integers(-8, 9)))
        rows.append(("x" if i % 3 else None if i % 2 else "y", None if i % 5 == 0 else a, [-0.0, 0.0, 1.0, float(np.inf), -2.5][i % 5], None, float(i // 300)))
    df = spark.createDataFrame(rows, "g string, a double, b double, none double, few double")
    got = skew.column_quantiles(df.repartition(3), ["a", "b", "none", "few"], PROBS, {"x": F.col("g") == "x", "y": F.col("g") == "y", "all": F.lit(True), "no": F.col("g") == "z"})
    assert set(got) == {(g, c) for g in ("x", "y", "all") for c in ("a", "b", "few")}
    for (g, c), q in got.items():
        v = np.sort([x for row in rows if g in ("all", row[0]) and (x := row[1 + ["a", "b", "none", "few"].index(c)]) is not None])
        pos = np.array(PROBS) * (len(v) - 1)
        low, high = v[np.floor(pos).astype(int)], v[np.ceil(pos).astype(int)]
        with np.errstate(invalid="ignore"):
            assert q == np.where(low == high, low, low + (high - low) * (pos - np.floor(pos))).tolist()
    assert skew.column_quantiles(df.limit(0), ["a"], PROBS, {"all": F.lit(True)}) == {}


def shifted(spark, n=6000):
    r = np.random.default_rng(7)
    rows = []
    for i in range(n):
        env = ["Q1", "Q2", "Q3", "Q4"][i % 4]
        a, b = float(r.normal()), float(r.normal())
        rows.append((None, env, float(r.normal() + a + (3.0 if env == "Q3" else 0.0)), a, b))
    return spark.createDataFrame(rows, "stratum string, environment string, y double, a double, b double")


def search(scale=1.0):
    s = ip.Search(ip.POOLED, "y", ["a", "b"], ["Q1", "Q2", "Q3", "Q4"], 6000, [(0,), (1,)])
    s.intercept, s.weights, s.scale = np.zeros(2), np.array([[1.0, 0.0], [0.0, 0.0]]), np.full(2, scale)
    s.low, s.high = np.zeros(2), np.ones(2)
    return s


def test_two_environments_refute_a_subset(spark):
    rows, q, names = shifted(spark), {}, ["y", "a", "b"]
    s, whole = search(), search()
    pairs = ip.telling_pairs(s, ip.environment_sums(rows, names), names, q)
    assert pairs.shape == (2, 2) and (pairs == 2).any(1).all()  # Q3 stands apart
    ip.count_bounds(rows, [s], [np.arange(2)], q, 64, [pairs])
    ip.count_bounds(rows, [whole], [np.arange(2)], q, 1024)
    assert (s.high < ip.SMALL_P).all() and (s.low == 0).all() and (whole.low <= s.high).all()


def test_counts_leave_tasks_once(spark, monkeypatch):
    """However many chunks a task works through, it hands on one row per block."""
    seen = []
    real = ip.distance_bounds
    monkeypatch.setattr(ip, "distance_bounds", lambda h: (seen.append(h.sum()), real(h))[1])
    monkeypatch.setattr(ip, "CHUNK", 100)
    monkeypatch.setattr(ip, "CELLS", 500)  # one block a pass
    monkeypatch.setattr(ip, "BLOCK", 1)
    a, b = search(), search()
    rows = shifted(spark)
    ip.count_bounds(rows, [a], [np.arange(2)], {}, 64)
    monkeypatch.setattr(ip, "CELLS", 1 << 24)
    ip.count_bounds(rows.repartition(5), [b], [np.arange(2)], {}, 64)
    assert np.allclose(a.high, b.high) and np.allclose(a.low, b.low)
    assert len(ip._blocks([np.arange(2)], [a], 64, None)) == 1
