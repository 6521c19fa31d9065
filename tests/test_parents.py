"""Two-phase subset search against sorting the residuals of every subset."""

from itertools import combinations

import numpy as np
import pytest

from panelwright.functions.tails import kolmogorov_tail
from panelwright.operators import invariance as iv
from panelwright.operators import parents as ip

COLS = ["a", "b", "c", "d", "e", "zero"]


def frame(spark, n=4200, seed=2):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        month = i % 24
        market = [-0.05, 0.0, 0.05][month % 3]
        kind = ["small", "large", "mid"][int(r.integers(0, 3))]
        a, e = float(r.normal()), float(r.integers(0, 3))
        b = float(a + r.normal() + market * 8)
        c = None if i % 9 == 0 else float(r.normal())
        y = int(np.clip(round(1 + 0.6 * a + 0.5 * r.normal() + (0.4 * e - 0.4 if kind == "mid" else 0)), 0, 2))
        rows.append((kind if i % 50 else None, f"20{20 + month // 12}-{1 + month % 12:02d}", market, float(y), float(y == 2), float(y == 0), a, b, c, float(market * 10), e, 1.0))
    cols = "kind string, period string, market double, y double, up double, down double, " + ", ".join(f"{c} double" for c in COLS)
    return spark.createDataFrame(rows, cols), rows


def brute(rows, stratum, target, cands, max_size, min_env):
    at = {"y": 3, "up": 4, "down": 5} | {c: 6 + i for i, c in enumerate(COLS)}
    months = sorted({r[1] for r in rows})
    mid = months[len(months) // 2]

    def env(r):
        move = "bear" if r[2] <= -0.02 else "flat" if r[2] <= 0.02 else "bull"
        return f"Q{(int(r[1][5:]) - 1) // 3 + 1}__{move}__{'early' if r[1] <= mid else 'late'}"

    mine = [r for r in rows if stratum == ip.POOLED or r[0] == stratum]
    count = {}
    for r in mine:
        count[env(r)] = count.get(env(r), 0) + 1
    mine = [r for r in mine if count[env(r)] >= min_env]
    envs = np.array([env(r) for r in mine])
    y = np.array([r[at[target]] for r in mine])
    x = {c: np.array([np.nan if r[at[c]] is None else r[at[c]] for r in mine]) for c in cands}
    x = {c: np.where(np.isnan(v), np.nanmedian(v), v) for c, v in x.items()}
    out = {}
    for k in range(1, max_size + 1):
        for sub in combinations(cands, k):
            z = np.column_stack([np.ones(len(y)), *[x[c] for c in sub]])
            e = np.round(y - z @ np.linalg.lstsq(z, y, rcond=None)[0], 12)
            groups = [np.sort(e[envs == g]) for g in sorted(set(envs))]
            p = 1.0
            for g, h in combinations([g for g in groups if len(g) >= 30], 2):
                u = np.concatenate([g, h])
                d = np.abs(np.searchsorted(g, u, "right") / len(g) - np.searchsorted(h, u, "right") / len(h)).max()
                p = min(p, kolmogorov_tail(d, len(g), len(h)))
            out[sub] = p
    return out


@pytest.mark.parametrize("bins, fine, chunk", [(32, 1024, 65536), (4, 8, 700)])
def test_search_equals_sorted_residuals(spark, monkeypatch, bins, fine, chunk):
    monkeypatch.setattr(ip, "CHUNK", chunk)
    monkeypatch.setattr(ip, "BLOCK", 7)
    df, rows = frame(spark)
    merge = {"y": [0, 1, 2], "up": [0, 0, 1], "down": [1, 0, 0]}
    found = ip.search_all(df, ["y", "up", "down"], COLS, "kind", "market", ["d"], merge=merge, min_env=40, bins=bins, fine_bins=fine)
    assert {(s.stratum, s.target) for s in found} == {(k, t) for k in ("pooled", "small", "large", "mid") for t in ("y", "up", "down")}
    undecided = 0
    for s in found:
        want = brute(rows, s.stratum, s.target, s.candidates, 3, 40)
        names = [tuple(s.candidates[v] for v in m) for m in s.members]
        assert "zero" not in s.candidates and set(names) == set(want)
        for i, sub in enumerate(names):
            p = want[sub]
            assert s.low[i] - 1e-9 <= p <= s.high[i] + 1e-9
            undecided += s.high[i] - s.low[i] > 1e-9
            for a in iv.ALPHAS:
                assert (s.high[i] > a) == (p > a)
        for c in s.candidates:
            best = max(p for sub, p in want.items() if c in sub)
            got = max(s.high[i] for i, sub in enumerate(names) if c in sub)
            assert abs(best - got) < 1e-9
    if bins == 32:
        assert undecided > 0  # bounds alone settled some


def test_parent_table_and_stability(spark):
    s = ip.Search("pooled", "y", ["a", "b"], ["e", "f"], 700, [(0,), (1,), (0, 1)], low=np.array([0.3, 0.01, 0.12]), high=np.array([0.3, 0.01, 0.12]))
    t = {(r.alpha, r.variable): r for r in ip.parent_table(spark, [s], iv.ALPHAS).collect()}
    assert t[0.10, "a"].confidence == 1.0 and t[0.10, "a"].strict and t[0.10, "b"].confidence == 0.5 and t[0.10, "b"].confidence_type == "plausible"
    assert t[0.20, "b"].confidence == round(0.12 / 0.2, 4) and t[0.20, "b"].plausible_sets_total == 1
    stable = {r.variable: (r.n_alphas, r.stable) for r in ip.threshold_stability(ip.parent_table(spark, [s], iv.ALPHAS)).collect()}
    assert stable == {"a": (4, True)}


def test_empty_and_single_environment(spark):
    df, _ = frame(spark, 400)
    assert ip.search_all(df.limit(0), ["y"], COLS, "kind", "market") == []
    assert ip.search_all(df.where("period = '2020-01'"), ["y"], COLS, "kind", "market", min_rows=1, min_env=1) == []
    assert ip.parent_table(spark, []).count() == 0


def test_bounds_hold_for_ties():
    r = np.random.default_rng(0)
    h = r.integers(0, 40, (5, 3, 16)) + 5
    low, high = ip.distance_bounds(h)
    assert (low <= high).all() and (low > 0).all()
