"""Entity fixed-effects regression from sufficient statistics.

Every model is fitted from sums: one aggregation per (hypothesis, entity)
gives the counts, sums and cross products; subtracting the entity means from
them is the within transform. Solving and standard errors then need only
these small tables, so a sweep of hundreds of regressions is a fixed number
of Spark jobs and no observation row is ever collected.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.tails import t_two_sided


def _pairs(k: int) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(k), 2))


def cross_moments(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """n, sums ``s`` and cross products ``p`` (upper triangle) per key, as two arrays."""
    k = len(cols)
    sums = [F.sum(F.col(c).cast("double")) for c in cols]
    prods = [F.sum(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double")) for i, j in _pairs(k)]
    aggs = [F.count("*").alias("n"), F.array(*sums).alias("s"), F.array(*prods).alias("p")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def within_moments(df: DataFrame, hypothesis: list[str], entity: str, cols: list[str]) -> DataFrame:
    """Demeaned cross products ``w`` per (hypothesis, entity); rows with a NULL among ``cols`` are left out."""
    m = cross_moments(df.dropna(subset=cols), [*hypothesis, entity], cols)
    terms = [
        F.element_at("p", x + 1) - F.element_at("s", i + 1) * F.element_at("s", j + 1) / F.col("n")
        for x, (i, j) in enumerate(_pairs(len(cols)))
    ]
    return m.select(*hypothesis, entity, "n", F.array(*terms).alias("w"))


def sum_arrays(name: str, size: int) -> Column:
    return F.array(*[F.sum(F.element_at(name, i + 1)) for i in range(size)])


def unpack(flat: np.ndarray, k: int) -> np.ndarray:
    m = np.empty((k, k))
    for x, (i, j) in enumerate(_pairs(k)):
        m[i, j] = m[j, i] = flat[x]
    return m


def _solver(k: int):
    """Coefficients of column 0 on columns 1..k-1 from packed cross products."""

    @F.pandas_udf("array<double>")
    def solve(w: pd.Series) -> pd.Series:
        out = []
        for flat in w:
            m = unpack(np.asarray(flat, dtype=float), k)
            a, b = m[1:, 1:], m[1:, 0]
            d = np.sqrt(np.clip(np.diag(a), 0, None))
            ok = d > 1e-12 * max(1.0, d.max(initial=0.0))
            beta = np.full(k - 1, np.nan)
            if ok.any():
                c = a[np.ix_(ok, ok)] / np.outer(d[ok], d[ok])
                beta[ok] = np.linalg.lstsq(c, b[ok] / d[ok], rcond=1e-10)[0] / d[ok]
            out.append([None if np.isnan(x) else float(x) for x in beta])
        return pd.Series(out)

    return solve


_FIT = "struct<se:array<double>, t_stat:array<double>, p_value:array<double>, rsquared:double, rss:double>"


def _inference(k: int):
    """Clustered standard errors, t, p and R2 from packed moments, coefficients and score products."""

    @F.pandas_udf(_FIT)
    def infer(w: pd.Series, beta: pd.Series, meat: pd.Series, n: pd.Series, entities: pd.Series) -> pd.DataFrame:
        rows = []
        for flat, b, s, obs, groups in zip(w, beta, meat, n, entities):
            m = unpack(np.asarray(flat, dtype=float), k)
            b = np.array([np.nan if x is None else x for x in b], dtype=float)
            used = ~np.isnan(b)
            bz = np.where(used, b, 0.0)
            a = m[1:, 1:]
            rss = m[0, 0] - 2 * bz @ m[1:, 0] + bz @ a @ bz
            inv = np.full((k - 1, k - 1), 0.0)
            inv[np.ix_(used, used)] = np.linalg.pinv(a[np.ix_(used, used)])
            # Effects are nested in the clusters, so only the slopes use up degrees of freedom.
            scale = obs / max(obs - used.sum(), 1)
            cov = scale * inv @ unpack(np.asarray(s, dtype=float), k - 1) @ inv
            se = np.sqrt(np.clip(np.diag(cov), 0, None))
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.where(used & (se > 0), b / se, np.nan)
            dof = max(obs - used.sum() - groups, 1)
            p = [t_two_sided(x, dof) for x in t]
            clean = lambda v: [None if np.isnan(x) else float(x) for x in v]
            rows.append((clean(np.where(used, se, np.nan)), clean(t), clean(p), 1 - rss / m[0, 0] if m[0, 0] > 0 else None, rss))
        return pd.DataFrame(rows, columns=["se", "t_stat", "p_value", "rsquared", "rss"])

    return infer


def panel_ols(df: DataFrame, hypothesis: list[str], entity: str, y: str, xs: list[str], min_obs: int = 0) -> DataFrame:
    """Fixed-effects OLS with entity-clustered errors for every hypothesis key.

    Returns one row per hypothesis with arrays ``beta``, ``se``, ``t_stat``,
    ``p_value`` in the order of ``xs``, and n_obs, n_entities, rsquared, rss.
    """
    cols = [y, *xs]
    k, size = len(cols), len(_pairs(len(cols)))
    per_entity = within_moments(df, hypothesis, entity, cols)
    keys = hypothesis or ["_all"]
    if not hypothesis:
        per_entity = per_entity.withColumn("_all", F.lit(1))
    total = (
        per_entity.groupBy(*keys)
        .agg(F.sum("n").alias("n_obs"), F.count("*").alias("n_entities"), sum_arrays("w", size).alias("w"))
        .where(F.col("n_obs") >= min_obs)
        .withColumn("beta", _solver(k)(F.col("w")))
    )
    # Score of an entity: its own cross products against y minus those against the fitted part.
    index = {pair: x for x, pair in enumerate(_pairs(k))}
    scored = per_entity.join(total.select(*keys, "beta"), keys)

    def score(i: int) -> Column:
        out = F.element_at("w", index[(0, i)] + 1)
        for j in range(1, k):
            at = index[(min(i, j), max(i, j))]
            out = out - F.element_at("w", at + 1) * F.coalesce(F.element_at("beta", j), F.lit(0.0))
        return out

    scored = scored.withColumn("g", F.array(*[score(i) for i in range(1, k)]))
    prods = [F.sum(F.element_at("g", i + 1) * F.element_at("g", j + 1)) for i, j in _pairs(k - 1)]
    meat = scored.groupBy(*keys).agg(F.array(*prods).alias("meat"))
    out = total.join(meat, keys).withColumn(
        "_f", _inference(k)(F.col("w"), F.col("beta"), F.col("meat"), F.col("n_obs"), F.col("n_entities"))
    )
    return out.select(
        *hypothesis, "n_obs", "n_entities", "beta",
        *[F.col(f"_f.{c}").alias(c) for c in ("se", "t_stat", "p_value", "rsquared", "rss")],
    )


def within_durbin_watson(df: DataFrame, hypothesis: list[str], entity: str, order: str, y: str, xs: list[str], fitted: DataFrame) -> DataFrame:
    """Sum of squared residual steps inside entities over the residual sum of squares."""
    cols = [y, *xs]
    rows = df.dropna(subset=cols).join(fitted.select(*hypothesis, "beta", "rss"), hypothesis)
    e = F.col(y)
    for i, x in enumerate(xs):
        e = e - F.col(x) * F.coalesce(F.element_at("beta", i + 1), F.lit(0.0))
    w = W.partitionBy(*hypothesis, entity).orderBy(order)  # calendar length
    rows = rows.withColumn("_e", e).withColumn("_step", F.col("_e") - F.lag("_e").over(w))
    keys = [*hypothesis, "rss"]
    return rows.groupBy(*keys).agg((F.sum(F.col("_step") * F.col("_step")) / F.col("rss")).alias("dw_stat")).drop("rss")


def demean(df: DataFrame, entity: str, cols: list[str]) -> DataFrame:
    """Within transform: value minus entity mean, from a pre-aggregation."""
    means = df.groupBy(entity).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    return df.join(means, entity).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in cols}).drop(*[f"_m_{c}" for c in cols])


def ols_from_moments(n: float, s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients (intercept first) and residual sum of squares of column 0 on the rest."""
    k = len(s)
    m = unpack(np.asarray(p, dtype=float), k)
    c = m - np.outer(s, s) / n
    slopes = np.linalg.lstsq(c[1:, 1:], c[1:, 0], rcond=1e-12)[0]
    mean = np.asarray(s, dtype=float) / n
    rss = float(c[0, 0] - slopes @ c[1:, 0])
    return np.concatenate([[mean[0] - slopes @ mean[1:]], slopes]), max(rss, 0.0)


def covariance_of(moments) -> np.ndarray:
    """Sample covariance from one row of ``cross_moments``."""
    n, s = moments["n"], np.asarray(moments["s"], dtype=float)
    c = unpack(np.asarray(moments["p"], dtype=float), len(s)) - np.outer(s, s) / max(n, 1)
    return c / max(n - 1, 1)
