"""Invariant-parent search over all subsets, strata and targets in two phases.

A subset of candidates is plausible if the residuals of its least-squares fit
are distributed alike in all environments: the smallest two-sample KS p-value
of any two environments exceeds a threshold. With 30 candidates there are
4,525 subsets for each stratum and target, far too many to sort residuals for.

* One pass over the rows gives, per stratum, the moments of targets and
  candidates and the counts of decile bins by class. They settle the candidate
  pools and the coefficients of every subset.
* Counting passes turn each Arrow batch into residuals by matrix products and
  count them in bins, per subset and environment. Counts are additive; at the
  bin ends the distribution functions are exact, between them each KS distance
  is bounded from both sides.
* The first pass counts, for every subset, all rows of just two environments
  whose mean residuals differ clearly. Their distance bounds the largest one from
  below, which proves most subsets implausible without the other environments.
* Only subsets whose bounds leave a decision open (a threshold lies between
  them, or the subset may hold the best p-value of a variable) are counted
  in all environments, again in finer bins, and what is then still open by
  exact running counts.

Rows that are counted beforehand (``counted``) stand in wherever no dense column
takes part: in moments, deciles and all subsets without one. Only subsets with a
dense column read the rows.

Decisions are those of exact p-values. A p-value that decides nothing is
reported by its upper bound. Memory of a task: one chunk of rows and the
counts of one pass (at most CELLS); nothing is collected but hypotheses.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import counted as ct
from panelwright.operators import invariance as iv
from panelwright.operators import skew
from panelwright.operators.macro import union_all
from panelwright.operators.regression import _pairs
from panelwright.session import staged

POOLED = "pooled"
# Rows worked on together, subsets of one block, bins of the counting passes, counts a task holds (4 bytes each).
CHUNK, BLOCK, BINS, FINE_BINS, FINEST_BINS, CELLS = 65536, 256, 64, 1024, 16384, 1 << 24
# Residual deviations on either side that bins of equal width cover.
REACH = 4.0
# p-values below this decide nothing and are not told apart.
SMALL_P = 1e-9
# Standard errors between two mean residuals that leave no doubt what counting them will show.
CLEAR = 20.0
# Open subsets of one search that skip the finer bins.
FEW_OPEN = 8


@dataclass
class Search:
    """One stratum and target: candidates, environments, subsets and their fits."""

    stratum: str
    target: str
    candidates: list[str]
    environments: list[str]
    n_obs: int = 0
    members: list[tuple[int, ...]] = field(default_factory=list)
    intercept: np.ndarray | None = None
    weights: np.ndarray | None = None  # candidates x subsets
    scale: np.ndarray | None = None  # residual deviation per subset
    low: np.ndarray | None = None  # bounds of the p-value
    high: np.ndarray | None = None


def prepared(df: DataFrame, stratum: str | None, market: str, targets: list[str], cols: list[str]) -> DataFrame:
    """Rows with known targets as (stratum, environment, targets, cols); all numbers double."""
    e = iv.add_environment(df.dropna(subset=targets), market)
    s = F.col(stratum) if stratum else F.lit(POOLED)
    return e.select(s.alias("stratum"), "environment", *[F.col(c).cast("double").alias(c) for c in [*targets, *cols]])


def prepared_counts(c: ct.Counted, stratum: str | None, market: str, targets: list[str]) -> DataFrame:
    """``prepared`` of counted rows: sums instead of dense columns, and n."""
    e = iv.add_environment(c.rows.dropna(subset=targets), market)
    s = F.col(stratum) if stratum else F.lit(POOLED)
    more = [x for x in c.rows.columns if x.startswith(("s_", "p_"))]
    return e.select(s.alias("stratum"), "environment", *[F.col(x).cast("double").alias(x) for x in dict.fromkeys([*targets, *c.plain, *more, "n"])])


def kept_environments(rows: DataFrame, min_rows: int = iv.MIN_PER_ENV, weight: str | None = None) -> dict[str, dict[str, int]]:
    """Rows per environment of every stratum and of all rows; small environments left out."""
    counts = rows.groupBy("stratum", "environment").agg((F.sum(weight).cast("long") if weight else F.count("*")).alias("n")).collect()  # strata x environments
    out: dict[str, dict[str, int]] = {POOLED: {}}
    for r in counts:
        if r["stratum"] is not None and r["stratum"] != POOLED:
            out.setdefault(r["stratum"], {})[r["environment"]] = r["n"]
        out[POOLED][r["environment"]] = out[POOLED].get(r["environment"], 0) + r["n"]
    return {s: {e: n for e, n in sorted(v.items()) if n >= min_rows} for s, v in out.items()}


def deciles(rows: DataFrame, kept: dict[str, dict[str, int]], cols: list[str], bins: int, weight: str | None = None) -> dict[tuple[str, str], list[float]]:
    """Exact inner quantiles and the median of every column per stratum, over its kept environments."""
    own = {
        s: F.col("environment").isin(list(envs)) if s == POOLED else F.col("environment").isin(list(envs)) & (F.col("stratum") == s) for s, envs in kept.items() if envs
    }
    return skew.column_quantiles(rows, cols, [*[i / bins for i in range(1, bins)], 0.5], own, weight) if own else {}


class _Batch:
    """Rows of one chunk as arrays."""

    def __init__(self, batches: list[pa.RecordBatch], cols: list[str]):
        table = pa.Table.from_batches(batches)
        self.x = {c: table.column(c).to_numpy() for c in cols}
        self.code, self.place = {}, {}
        for c in ("stratum", "environment"):
            coded = table.column(c).combine_chunks().dictionary_encode()
            self.code[c] = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            self.place[c] = {x: i for i, x in enumerate(coded.dictionary.to_pylist())}

    def rows_of(self, stratum: str, envs: dict[str, int] | list[str]) -> np.ndarray:
        mine = np.isin(self.code["environment"], [self.place["environment"][e] for e in envs if e in self.place["environment"]])
        return mine if stratum == POOLED else mine & (self.code["stratum"] == self.place["stratum"].get(stratum, -2))


def _chunks(batches, cols):
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= CHUNK:
            yield _Batch(held, cols)
            held, size = [], 0
    if size:
        yield _Batch(held, cols)


def filled(values: np.ndarray, middle: float | None) -> np.ndarray:
    return np.where(np.isnan(values), 0.0 if middle is None else middle, values)


def stratum_moments(
    rows: DataFrame, kept: dict, q: dict, targets: list[str], cols: list[str], bins: int, classes: list[float], dense: list[str] | None = None,
) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per stratum the cross products of (1, targets, filled columns) and counts [column, bin, class of targets[0]].

    With ``dense`` the rows are counted ones: moments then have these columns
    last, and no counts of theirs.
    """
    names = [*targets, *cols]
    more = [f"s_{c}" for c in dense] + [f"p_{i}_{j}" for i, j in _pairs(len(dense))] + ["n"] if dense is not None else []
    width = 1 + len(names) + len(dense or [])

    def count(batches):
        for b in _chunks(batches, [*names, *more]):
            for s, envs in kept.items():
                mine = b.rows_of(s, envs)
                if not mine.any():
                    continue
                n = b.x["n"][mine] if more else None
                z = np.column_stack([
                    np.ones(int(mine.sum())), *[b.x[t][mine] for t in targets], *[filled(b.x[c][mine], (q.get((s, c)) or [None])[-1]) for c in cols],
                ])
                y = np.searchsorted(np.array(classes), b.x[targets[0]][mine])
                cells = np.zeros((len(cols), bins, len(classes)))
                for i, c in enumerate(cols):
                    x = b.x[c][mine]
                    known = ~np.isnan(x)
                    edges = np.array((q.get((s, c)) or [])[:-1])
                    at = np.searchsorted(edges, x[known], side="left") * len(classes) + y[known]
                    cells[i] = np.bincount(at, n[known] if more else None, bins * len(classes)).reshape(bins, -1)
                m = z.T @ z if not more else ct.moments(
                    n, z, *(np.column_stack([np.zeros((len(n), 0)), *[b.x[c][mine] for c in part]]) for part in (more[: len(dense)], more[len(dense) : -1])),
                    np.array([(q.get((s, c)) or [0.0])[-1] for c in dense], float),
                )
                flat = np.concatenate([m.ravel(), cells.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([flat], pa.list_(pa.float64()))], ["stratum", "v"])

    parts = rows.select("stratum", "environment", *names, *more).mapInArrow(count, "stratum string, v array<double>")
    sums = parts.select("stratum", F.posexplode("v").alias("at", "v")).groupBy("stratum", "at").agg(F.sum("v").alias("v"))
    flat = {s: np.zeros(width * width + len(cols) * bins * len(classes)) for s in kept}
    for r in sums.collect():  # strata x (columns squared)
        flat[r["stratum"]][r["at"]] = r["v"]
    return {s: (v[: width * width].reshape(width, width), v[width * width :].reshape(len(cols), bins, len(classes))) for s, v in flat.items()}


def information(cells: np.ndarray) -> float:
    """Mutual information (nats) of a table of counts."""
    t = cells.sum()
    if t <= 0:
        return 0.0
    nb, ny = cells.sum(1, keepdims=True), cells.sum(0, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        term = cells / t * np.log(cells * t / (nb * ny))
    return float(np.nansum(np.where(cells > 0, term, 0.0)))


def counted_moments(rows: DataFrame, counts: DataFrame, dense: list[str], kept: dict, q: dict, targets: list[str], cols: list[str], bins: int, classes: list[float]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """``stratum_moments`` from counted rows; only the counts of dense columns need the rows."""
    plain = [c for c in cols if c not in dense]
    some = stratum_moments(counts, kept, q, targets, plain, bins, classes, dense)
    rest = stratum_moments(rows, kept, q, targets, dense, bins, classes) if dense else {}
    order = [*plain, *dense]
    at = [*range(1 + len(targets)), *[1 + len(targets) + order.index(c) for c in cols]]
    out = {}
    for s, (m, cells) in some.items():
        every = np.concatenate([cells, rest[s][1]]) if dense else cells
        out[s] = m[np.ix_(at, at)], every[[order.index(c) for c in cols]]
    return out


def candidate_pools(moments: dict, targets: list[str], cols: list[str], blankets: dict[str, list[str]], domain: list[str], merge: dict[str, list[int]], **kw) -> dict[tuple[str, str], list[str]]:
    """Ranked candidates of every stratum and target; ``merge`` gives each target's classes of the first one."""
    out = {}
    for s, (m, cells) in moments.items():
        n = m[0, 0]
        if n <= 0:
            continue
        c = m / n - np.outer(m[0], m[0]) / n / n
        d = np.sqrt(np.clip(np.diag(c), 0, None))
        for k, t in enumerate(targets):
            at = {v: 1 + len(targets) + i for i, v in enumerate(cols)}
            corr = {v: c[1 + k, i] / (d[i] * d[1 + k]) for v, i in at.items() if d[i] > 1e-9 and d[1 + k] > 1e-9}
            y = np.array(merge[t])
            mi = {v: information(np.stack([cells[i][:, y == g].sum(1) for g in sorted(set(merge[t]))], 1)) for i, v in enumerate(cols) if v in corr}
            out[s, t] = iv.rank_candidates(corr, mi, [v for v in blankets.get(t, []) if v in corr], [v for v in domain if v in corr], **kw)
    return out


def fit_subsets(search: Search, m: np.ndarray, names: list[str], max_size: int) -> Search:
    """Coefficients and residual deviation of every subset from the moments of its stratum.

    Subsets whose columns are linearly dependent are left out.
    """
    n = m[0, 0]
    y = 1 + names.index(search.target)
    at = np.array([1 + names.index(c) for c in search.candidates], int)
    c = m - np.outer(m[0], m[0]) / n
    raw = np.sqrt(np.clip(np.diag(m), 0, None))
    weights, intercept, scale = [], [], []
    for k in range(1, max_size + 1):
        sets = np.array(list(combinations(range(len(at)), k)), int).reshape(-1, k)
        if not len(sets):
            continue
        idx = at[sets]
        a = m[idx[:, :, None], idx[:, None, :]] / np.maximum(raw[idx][:, :, None] * raw[idx][:, None, :], 1e-300)
        full_rank = np.linalg.eigvalsh(a)[:, 0] > 1e-12
        sets, idx = sets[full_rank], idx[full_rank]
        d = np.sqrt(np.clip(np.diag(c), 1e-300, None))
        g = c[idx[:, :, None], idx[:, None, :]] / (d[idx][:, :, None] * d[idx][:, None, :])
        beta = (np.linalg.pinv(g, rcond=1e-10, hermitian=True) @ (c[idx, y] / d[idx])[:, :, None])[:, :, 0] / d[idx]
        w = np.zeros((len(sets), len(at)))
        np.put_along_axis(w, sets, beta, 1)
        weights.append(w)
        intercept.append((m[0, y] - (beta * m[0][idx]).sum(1)) / n)
        scale.append(np.sqrt(np.clip((c[y, y] - (beta * c[idx, y]).sum(1)) / n, 0, None)))
        search.members += [tuple(s) for s in sets.tolist()]
    search.n_obs = int(round(n))
    search.weights = np.vstack(weights).T if weights else np.zeros((len(at), 0))
    search.intercept = np.concatenate(intercept) if intercept else np.zeros(0)
    search.scale = np.maximum(np.concatenate(scale), 1e-12) if scale else np.zeros(0)
    search.low, search.high = np.zeros(len(search.members)), np.ones(len(search.members))
    return search


def tail(x: np.ndarray) -> np.ndarray:
    """Kolmogorov limit law at x."""
    j = np.arange(1, 101)[:, None]
    x = np.atleast_1d(np.asarray(x, float))
    p = 2.0 * (np.where(j % 2 == 1, 1.0, -1.0) * np.exp(-2.0 * j * j * np.maximum(x, 0.18) ** 2)).sum(0)
    return np.where(x < 0.18, 1.0, np.clip(p, 0.0, 1.0))


def distance_bounds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the largest scaled KS distance from counts [subset, environment, bin]."""
    n = h.sum(2)
    f = np.cumsum(h, 2) / np.maximum(n, 1)[:, :, None]
    before = np.concatenate([np.zeros_like(f[:, :, :1]), f[:, :, :-1]], 2)
    low, high = np.zeros(len(h)), np.zeros(len(h))
    for a, b in combinations(range(h.shape[1]), 2):
        usable = (n[:, a] >= iv.MIN_PER_SAMPLE) & (n[:, b] >= iv.MIN_PER_SAMPLE)
        en = np.sqrt(n[:, a] * n[:, b] / np.maximum(n[:, a] + n[:, b], 1))
        c = np.where(usable, en + 0.12 + 0.11 / np.maximum(en, 1e-9), 0.0)
        low = np.maximum(low, c * np.abs(f[:, a] - f[:, b]).max(1))
        high = np.maximum(high, c * np.maximum(f[:, a] - before[:, b], f[:, b] - before[:, a]).max(1))
    return low, np.maximum(low, high)


def environment_sums(rows: DataFrame, names: list[str], dense: list[str] | None = None) -> dict[tuple[str | None, str], np.ndarray]:
    """Per stratum and environment [count, sums of ``names``, missing values of ``names``]; of counted rows with ``dense``."""
    if dense is not None:
        column = {c: F.nanvl(f"s_{c}" if c in dense else c, F.lit(None)) for c in names}
        total = [F.coalesce(F.sum(x if c in dense else x * F.col("n")), F.lit(0.0)) for c, x in column.items()]
        gone = [F.coalesce(F.sum(F.when(x.isNull(), F.col("n"))), F.lit(0.0)) for x in column.values()]
        got = rows.groupBy("stratum", "environment").agg(F.array(F.sum("n").cast("double"), *total, *gone).alias("v"))
        return {(r["stratum"], r["environment"]): np.array(r["v"]) for r in got.collect()}  # strata x environments
    known = [F.coalesce(F.sum(F.nanvl(c, F.lit(None))), F.lit(0.0)) for c in names]
    missing = [F.count("*") - F.count(F.nanvl(c, F.lit(None))) for c in names]
    got = rows.groupBy("stratum", "environment").agg(F.array(F.count("*").cast("double"), *known, *[m.cast("double") for m in missing]).alias("v"))
    return {(r["stratum"], r["environment"]): np.array(r["v"]) for r in got.collect()}  # strata x environments


def telling_pairs(s: Search, sums: dict, names: list[str], q: dict) -> np.ndarray:
    """Two environments (by place) of every subset: the smallest whose mean residuals are CLEAR errors apart, or those farthest apart."""
    k = len(names)
    v = np.zeros((len(s.environments), 1 + 2 * k))
    for (stratum, env), x in sums.items():
        if env in s.environments and s.stratum in (stratum, POOLED):
            v[s.environments.index(env)] += x
    n = np.maximum(v[:, 0], 1)
    at = [names.index(c) for c in s.candidates]
    middle = np.array([(q.get((s.stratum, c)) or [None])[-1] or 0.0 for c in s.candidates])
    x = (v[:, 1:][:, at] + v[:, 1 + k :][:, at] * middle) / n[:, None]
    y = v[:, 1 + names.index(s.target)] / n
    mean = np.nan_to_num((y[:, None] - s.intercept - x @ s.weights) / s.scale)
    pairs = [p for p in combinations(range(len(n)), 2) if min(n[list(p)]) >= iv.MIN_PER_SAMPLE] or [(0, 1)]
    a, b = np.array(pairs).T
    far = np.sqrt(n[a] * n[b] / (n[a] + n[b]))[:, None] * np.abs(mean[a] - mean[b])
    small = np.argsort(n[a] + n[b], kind="stable")
    clear = far[small] >= CLEAR
    return np.array(pairs)[np.where(clear.any(0), small[clear.argmax(0)], far.argmax(0))]


def _blocks(wanted: list[np.ndarray], searches: list[Search], bins: int, pairs: list[np.ndarray] | None) -> list[list[tuple[int, np.ndarray, list[int]]]]:
    """Blocks (search, subsets, places of their environments), in passes whose counts a task can hold."""
    size = max(1, BLOCK * BINS // bins)
    blocks = []
    for k, ids in enumerate(wanted):
        every = list(range(len(searches[k].environments)))
        alike = [(every, ids)] if pairs is None else [(list(p), ids[(pairs[k][ids] == p).all(1)]) for p in np.unique(pairs[k][ids], axis=0)]
        blocks += [(k, part[i : i + size], envs) for envs, part in alike for i in range(0, len(part), size)]
    passes, cells = [], CELLS
    for block in blocks:
        more = len(block[1]) * len(block[2]) * bins
        if cells + more > CELLS:
            passes.append([])
            cells = 0
        passes[-1].append(block)
        cells += more
    return passes


def count_bounds(rows: DataFrame, searches: list[Search], wanted: list[np.ndarray], q: dict, bins: int, pairs: list[np.ndarray] | None = None, weight: str | None = None) -> None:
    """Narrow the p-value bounds of the wanted subsets of every search by counting passes.

    With ``pairs`` only two environments of each subset are counted: their
    distance bounds the largest one from below, hence the p-value from above.
    Tasks keep their counts until they end, so what is shuffled grows with the
    number of tasks and not of rows.
    """
    for part in _blocks(wanted, searches, bins, pairs):
        _count_blocks(rows, searches, part, q, bins, pairs is not None, weight)


def _count_blocks(rows: DataFrame, searches: list[Search], blocks: list, q: dict, bins: int, partly: bool, weight: str | None = None) -> None:
    # columns that no subset of the blocks uses have no weight
    used = {k: np.flatnonzero(np.abs(np.hstack([searches[j].weights[:, ids] for j, ids, _ in blocks if j == k])).any(1)) for k in {k for k, _, _ in blocks}}
    names = sorted({c for k, at in used.items() for c in [searches[k].target, *[searches[k].candidates[i] for i in at]]} | ({weight} if weight else set()))
    grid = bins / (2 * REACH)  # bins of equal width, the outer ones open

    def count(batches):
        total, places = [], {}
        for number, (k, ids, envs) in enumerate(blocks):
            s = searches[k]
            # (target, 1, candidates) @ place is the bin of the residual
            place = np.vstack([grid / s.scale[ids], (REACH - s.intercept[ids] / s.scale[ids]) * grid, -s.weights[np.ix_(used[k], ids)] * (grid / s.scale[ids])])
            total.append(np.zeros((len(envs), len(ids) * bins), np.uint32))  # rows of one task
            for i, e in enumerate(envs):
                places.setdefault((s.stratum, s.environments[e]), {}).setdefault(k, []).append((number, i, place))
        for b in _chunks(batches, names):
            for (stratum, env), per in places.items():
                mine = np.flatnonzero(b.rows_of(stratum, [env]))
                if not len(mine):
                    continue
                held = {}
                for k, jobs in per.items():
                    s = searches[k]
                    for c in [s.candidates[i] for i in used[k]]:
                        if c not in held:
                            held[c] = filled(b.x[c][mine], (q.get((stratum, c)) or [None])[-1])
                    x = np.column_stack([b.x[s.target][mine], np.ones(len(mine)), *[held[s.candidates[i]] for i in used[k]]])
                    n = b.x[weight][mine] if weight else None
                    for number, i, place in jobs:
                        width = place.shape[1]
                        step, first = max(1, (1 << 17) // width), np.arange(width) * bins
                        for a in range(0, len(x), step):
                            z = x[a : a + step] @ place
                            np.fmax(z, 0.0, out=z)
                            np.fmin(z, bins - 1.0, out=z)
                            at = z.astype(np.intp)
                            at += first
                            times = np.repeat(n[a : a + step], width) if weight else None
                            total[number][i] += np.bincount(at.ravel(), times, width * bins).astype(np.uint32)
        for number, h in enumerate(total):
            if h.any():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([h.tobytes()])], ["block", "h"])

    def bound(key, group):
        k, ids, envs = blocks[key[0].as_py()]
        h = np.zeros(len(envs) * len(ids) * bins, np.int64)
        for x in group.column("h"):
            h += np.frombuffer(x.as_buffer(), np.uint32)
        low, high = distance_bounds(h.reshape(len(envs), len(ids), bins).transpose(1, 0, 2))
        high = np.full(len(ids), np.inf) if partly else high  # other environments may lie farther apart
        return pa.table({"search": pa.array(np.full(len(ids), k, np.int64)), "subset": pa.array(np.asarray(ids, np.int64)), "low": low, "high": high})

    got = rows.select("stratum", "environment", *names).mapInArrow(count, "block long, h binary").groupBy("block").applyInArrow(bound, "search long, subset long, low double, high double").collect()  # one row per hypothesis
    for r, low, high in zip(got, tail([r["high"] for r in got]), tail([r["low"] for r in got])):
        s = searches[r["search"]]
        s.low[r["subset"]] = max(s.low[r["subset"]], low)
        s.high[r["subset"]] = min(s.high[r["subset"]], high)


def open_subsets(s: Search, alphas: list[float]) -> np.ndarray:
    """Subsets whose bounds do not settle a threshold or the best p-value of a variable."""
    if not s.members:
        return np.zeros(0, int)
    wide = s.high - s.low > 1e-12
    is_open = np.zeros(len(s.members), bool)
    for a in alphas:
        is_open |= (s.low <= a) & (s.high > a)
    best = np.zeros(len(s.candidates))
    for i, m in enumerate(s.members):
        for v in m:
            best[v] = max(best[v], s.low[i])
    for i, m in enumerate(s.members):
        is_open[i] |= s.high[i] > SMALL_P and any(s.high[i] > best[v] for v in m)
    return np.flatnonzero(is_open & wide)


def count_exactly(rows: DataFrame, searches: list[Search], wanted: list[np.ndarray], q: dict, weight: str | None = None) -> None:
    """Exact p-values of the wanted subsets by running counts over their residuals."""
    parts, groups = [], sorted({e for s, ids in zip(searches, wanted) for e in s.environments if len(ids)})
    for k, (s, ids) in enumerate(zip(searches, wanted)):
        if not len(ids):
            continue
        mine = rows.where(F.col("environment").isin(s.environments))
        mine = mine if s.stratum == POOLED else mine.where(F.col("stratum") == s.stratum)
        used = [s.candidates[v] for v in sorted({v for i in ids for v in s.members[i]})]
        value = {c: F.coalesce(F.col(c), F.lit(float((q.get((s.stratum, c)) or [0.0])[-1] or 0.0))) for c in used}
        cells = []
        for i in ids:
            fit = F.lit(float(s.intercept[i]))
            for v in s.members[i]:
                fit = fit + value[s.candidates[v]] * F.lit(float(s.weights[v, i]))
            cells.append(F.struct(F.lit(int(i)).alias("subset"), F.round(F.col(s.target) - fit, 12).alias("residual")))
        times = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
        parts.append(mine.select(F.lit(k).alias("search"), "environment", times.alias("n"), F.explode(F.array(*cells)).alias("_c")).select("search", "environment", "n", "_c.*"))
    if not parts:
        return
    counted = union_all(parts).groupBy("search", "subset", "environment", "residual").agg(F.sum("n").alias("n"))
    ks = iv.ks_between(counted, ["search", "subset"], "environment", "residual", "n", groups)
    enough = (F.col("n_a") >= iv.MIN_PER_SAMPLE) & (F.col("n_b") >= iv.MIN_PER_SAMPLE)
    en = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    x = ks.where(enough).groupBy("search", "subset").agg(F.max((en + 0.12 + F.lit(0.11) / en) * F.col("ks")).alias("x"))
    for r in x.collect():  # one row per open hypothesis
        s = searches[r["search"]]
        s.low[r["subset"]] = s.high[r["subset"]] = tail(r["x"])[0]


def search_all(
    df: DataFrame, targets: list[str], cols: list[str], stratum: str | None, market: str, domain: list[str] = (), *, merge: dict[str, list[int]] | None = None,
    classes: list[float] = (0.0, 1.0, 2.0), blankets: dict[str, list[str]] | None = None, alphas: list[float] = iv.ALPHAS, min_env: int = iv.MIN_PER_ENV,
    min_rows: int = 500, max_size: int = iv.MAX_SUBSET, bins: int = BINS, fine_bins: int = FINE_BINS, mi_bins: int = 10, counted: ct.Counted | None = None, **kw,
) -> list[Search]:
    """All subset searches of every stratum, the pooled one included, and every target.

    ``merge`` maps each target to the value it takes in each of ``classes`` of
    the first target. Strata with too few rows or a single environment are left out.
    ``counted`` holds the same rows counted by stratum, targets and cells.
    """
    merge = merge or {t: list(range(len(classes))) for t in targets}
    rows = prepared(df, stratum, market, targets, cols)
    dense = [c for c in counted.dense if c in cols] if counted else []
    counts = staged(prepared_counts(counted, stratum, market, targets), "parent_counts", uuid.uuid4().hex) if counted else None
    whole, weight = (rows, None) if counts is None else (counts, "n")
    kept = {s: e for s, e in kept_environments(whole, min_env, weight).items() if sum(e.values()) >= min_rows and len(e) > 1}
    q = deciles(whole, kept, [c for c in cols if c not in dense], mi_bins, weight)
    if dense:
        q |= deciles(rows, kept, dense, mi_bins)
    if not kept:
        moments = {}
    elif counted:
        moments = counted_moments(rows, counts, dense, kept, q, targets, cols, mi_bins, list(classes))
    else:
        moments = stratum_moments(rows, kept, q, targets, cols, mi_bins, list(classes))
    pools = candidate_pools(moments, targets, cols, blankets or {}, list(domain), merge, **kw)
    names = [*targets, *cols]
    searches = [
        fit_subsets(Search(s, t, pool, list(kept[s])), moments[s][0], names, max_size) for (s, t), pool in pools.items() if len(pool) > 1
    ]

    def split(wanted: list[np.ndarray]) -> list[tuple[DataFrame, str | None, list[np.ndarray]]]:
        """The subsets that counted rows can settle, and those that need the rows."""
        if counts is None:
            return [(rows, None, wanted)]
        needs = [np.array([any(s.candidates[v] in dense for v in m) for m in s.members], bool) for s in searches]
        parts = [(counts, "n", [ids[~x[ids]] for ids, x in zip(wanted, needs)]), (rows, None, [ids[x[ids]] for ids, x in zip(wanted, needs)])]
        return [part for part in parts if any(len(ids) for ids in part[2])]

    def bounds(wanted: list[np.ndarray], bins: int, pairs: list[np.ndarray] | None = None) -> None:
        for table, n, ids in split(wanted):
            count_bounds(table, searches, ids, q, bins, pairs, n)

    sums = environment_sums(whole, names, dense if counted else None) if searches else {}
    bounds([np.arange(len(s.members)) for s in searches], bins, [telling_pairs(s, sums, names, q) for s in searches])
    left = [open_subsets(s, alphas) for s in searches]
    bounds(left, bins)
    left = [open_subsets(s, alphas) for s in searches]
    for finer in (fine_bins, FINEST_BINS):
        if any(len(i) > FEW_OPEN for i in left):
            bounds([i if len(i) > FEW_OPEN else i[:0] for i in left], finer)
            left = [open_subsets(s, alphas) for s in searches]
    for table, n, ids in split(left):
        count_exactly(table, searches, ids, q, n)
    return searches


PARENTS = (
    "alpha double, stratum string, target string, variable string, confidence double, confidence_type string, in_intersection boolean, strict boolean, "
    "plausible_sets_total long, best_p_value double, n_obs long, n_environments long, n_candidates long"
)


def parent_table(spark, searches: list[Search], alphas: list[float] = (iv.ALPHA_PRIMARY,), share: float = iv.SOFT_SHARE) -> DataFrame:
    """Confidence of every variable per search and threshold (at most strata x targets x thresholds x candidates rows)."""
    out = []
    for s in searches:
        for alpha in alphas:
            ok = s.high > alpha
            total = int(ok.sum())
            for v, name in enumerate(s.candidates):
                mine = np.array([v in m for m in s.members], bool)
                if not mine.any():
                    continue
                best, hits = float(s.high[mine].max()), int((ok & mine).sum())
                part = hits / total if total else None
                conf = part if hits else round(min(best / alpha, 0.99), 4)
                inside = part is not None and part >= share
                kind = "certified" if inside else "plausible" if total else "soft"
                out.append((alpha, s.stratum, s.target, name, conf, kind, inside, part is not None and part >= 1.0, total, best, s.n_obs, len(s.environments), len(s.candidates)))
    return spark.createDataFrame(out, PARENTS)


def threshold_stability(table: DataFrame, alphas: list[float] = iv.ALPHAS) -> DataFrame:
    """Per search, the variables certified at any threshold and whether at every one."""
    per = table.groupBy("stratum", "target", "variable").agg(F.count(F.when(F.col("in_intersection"), 1)).alias("n_alphas"))
    return per.where("n_alphas > 0").withColumn("stable", F.col("n_alphas") == len(alphas))
