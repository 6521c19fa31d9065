"""Group operations that stay exact when one group holds most of the rows.

Four tools: totals joined back instead of whole-group windows, ranks and
running totals computed over value buckets, exact quantiles read off those
running totals, and exact quantiles of many columns at once by their digits. The bucket bounds come from an approximate quantile
sketch, one subquery of the plan; they only balance the work and never change
a result. NULL group keys are a group like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which a NULL key meets a NULL key; keys appear once."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(right[f"_right_{k}"])
    if not keys:
        return left.join(right, how=how)
    return left.join(right, same, how).drop(*[f"_right_{k}" for k in keys])


def join_group_totals(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Add per-group aggregates by pre-aggregating and joining back.

    A window over ``keys`` would ship each whole group to one task; here the
    shuffle carries one partial row per map task and group, and the join back
    can be broadcast or skew-split by adaptive execution.
    """
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return join_null_safe(df, totals, keys, "left")


def add_bucket(df: DataFrame, value: str, out: str, buckets: int | None = None) -> DataFrame:
    """Monotone bucket id: number of cut points of ``value`` below it, from a sketch.

    The sketch is a subquery of the plan, so nothing runs before the query does.
    """
    n = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    probs = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(F.col(value).cast("double"), probs, 10_000)).scalar()
    found = df.withColumn("_cuts", F.coalesce(cuts, F.array().cast("array<double>")))
    return found.withColumn(out, F.size(F.filter("_cuts", lambda b: b < F.col(value)))).drop("_cuts")


def running_counts(df: DataFrame, keys: list[str], value: str, weight: str, buckets: int | None = None) -> DataFrame:
    """Inclusive running sum of ``weight`` over ascending ``value`` per group.

    Input must hold one row per (keys, value). Adds ``cum`` and ``group_total``.
    """
    b = add_bucket(df, value, "_bucket", buckets)
    per_bucket = b.groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_bucket_total"))
    over_buckets = W.partitionBy(*keys).orderBy("_bucket")  # at most one row per bucket and group
    per_bucket = per_bucket.withColumn(
        "_before", F.sum("_bucket_total").over(over_buckets) - F.col("_bucket_total")
    ).withColumn("group_total", F.sum("_bucket_total").over(W.partitionBy(*keys)))
    inside = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return (
        join_null_safe(b, per_bucket.drop("_bucket_total"), [*keys, "_bucket"])
        .withColumn("cum", F.col("_before") + F.sum(weight).over(inside))
        .drop("_bucket", "_before")
    )


def rank_descending(df: DataFrame, keys: list[str], value: str, out: str, buckets: int | None = None) -> DataFrame:
    """Minimum rank of ``value`` (largest first) inside each group.

    NULL values get no rank, as an average over nothing has none; NULL keys
    are a group.
    """
    present = df.where(F.col(value).isNotNull())
    counts = present.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    cum = running_counts(counts, keys, value, "_n", buckets)
    ranks = cum.select(*keys, value, (F.col("group_total") - F.col("cum") + 1).cast("long").alias(out))
    return join_null_safe(df, ranks, [*keys, value], "left")


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    out: str,
    buckets: int | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group as an array column.

    Values are counted, given running totals over value buckets, and only the
    rows that cover a wanted position are kept; no group is gathered anywhere.
    """
    present = df.where(F.col(value).isNotNull()).select(*keys, value)
    counts = present.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    cum = running_counts(counts, keys, value, "_n", buckets)
    at = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(len(probs) - 1)),
            lambda i: F.struct(
                i.alias("i"), (F.element_at(F.lit(probs), i + 1) * (F.col("group_total") - 1)).alias("pos")
            ),
        )
    )
    hits = cum.withColumn("_at", at).select(
        *keys,
        F.col(value).alias("_v"),
        F.col("_at.i").alias("_i"),
        F.col("_at.pos").alias("_pos"),
        (F.col("cum") - F.col("_n")).alias("_from"),
        (F.col("cum") - 1).alias("_to"),
    )
    lo_hit = F.floor("_pos").between(F.col("_from"), F.col("_to"))
    hi_hit = F.ceil("_pos").between(F.col("_from"), F.col("_to"))
    ends = (
        hits.where(lo_hit | hi_hit)
        .groupBy(*keys, "_i", "_pos")
        .agg(F.max(F.when(lo_hit, F.col("_v"))).alias("_lo"), F.max(F.when(hi_hit, F.col("_v"))).alias("_hi"))
    )
    one = ends.withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos")))
    rows = F.sort_array(F.collect_list(F.struct("_i", "_q")))  # len(probs) entries
    agg = F.transform(rows, lambda s: s["_q"]).alias(out)
    return one.groupBy(*keys).agg(agg) if keys else one.agg(agg)


# Bits of a double that each pass of column_quantiles settles; rows worked on together.
DIGITS = (16, 12, 12, 12, 12)
CHUNK = 65536
_TOP = np.uint64(1 << 63)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order."""
    u = np.ascontiguousarray(x + 0.0).view(np.uint64)  # -0.0 counts as 0.0
    return np.where(u & _TOP, ~u, u | _TOP)


def _double(u: np.ndarray) -> np.ndarray:
    return np.where(u & _TOP, u & ~_TOP, ~u).view(np.float64)


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float], groups: dict[str, Column], weight: str | None = None) -> dict[tuple[str, str], list[float]]:
    """Exact linear-interpolation quantiles of many columns in groups that may overlap, as {(group, column): values}.

    ``weight`` names the number of rows that a row stands for.

    ``groups`` maps a name to the condition on its rows. Each pass counts the next digits of the values that share
    the leading digits of a wanted position; rows are neither exploded nor shuffled. NULL and NaN are left out;
    a column without values in a group has no entry.
    """
    names = list(groups)
    rows = df.select(*[F.coalesce(c, F.lit(False)).alias(f"_g{i}") for i, c in enumerate(groups.values())], *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)], *([F.col(weight).cast("long").alias("_n")] if weight else []))
    found, left = None, 64
    for bits in DIGITS:
        left -= bits
        found = _next_digits(rows, len(names), len(cols), probs, found, bits, left)
    out = {}
    for (i, j), (n, digits, _) in found.items():
        low, high = _double(digits).reshape(2, -1)
        pos = np.array(probs) * (n - 1)
        with np.errstate(invalid="ignore"):  # between infinite values
            between = np.where(low == high, low, low + (high - low) * (pos - np.floor(pos)))
        out[names[i], cols[j]] = between.tolist()
    return out


def _next_digits(rows: DataFrame, n_groups: int, n_cols: int, probs: list[float], found: dict | None, bits: int, left: int) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
    """One more pass: (group, column) -> rows, leading digits of every wanted position, and its rank among the values that share them."""
    first = found is None
    begin = {} if first else {cell: np.unique(digits) for cell, (_, digits, _) in found.items()}

    def add(total, table):
        inside = [table.column(i).to_numpy() for i in range(n_groups)]
        n = table.column(n_groups + n_cols).to_numpy() if table.num_columns > n_groups + n_cols else None
        for j in range(n_cols):
            x = table.column(n_groups + j).to_numpy()
            here = ~np.isnan(x)
            u = _ordered(x)
            for i in range(n_groups):
                known = begin.get((i, j))
                if not first and known is None:
                    continue
                use = inside[i] & here
                mine, times = u[use], None if n is None else n[use]
                code, size = (mine >> np.uint64(left)).astype(np.int64), 1 << bits
                if not first:
                    lead = mine >> np.uint64(left + bits)
                    at = np.minimum(np.searchsorted(known, lead), len(known) - 1)
                    meets = known[at] == lead
                    code, times = ((at << bits) + (code & (size - 1)))[meets], None if n is None else times[meets]
                    size *= len(known)
                if len(code):
                    total[i, j] = total.get((i, j), 0) + np.bincount(code, times, size).astype(np.int64)

    def count(batches):
        total, held, n = {}, [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                add(total, pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            add(total, pa.Table.from_batches(held))
        for (i, j), t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([at], pa.list_(pa.int64())), pa.array([t[at]], pa.list_(pa.int64()))], ["g", "c", "code", "n"]
            )

    def chosen(key, group):
        i, j = (x.as_py() for x in key)
        known = np.zeros(1, np.uint64) if first else begin[i, j]
        total = np.zeros(len(known) << bits, np.int64)
        for at, n in zip(group.column("code"), group.column("n")):
            total[at.values.to_numpy()] += n.values.to_numpy()
        if first:
            n = int(total.sum())
            pos = np.array(probs) * (n - 1)
            digits, rank = np.zeros(2 * len(probs), np.uint64), np.concatenate([np.floor(pos), np.ceil(pos)]).astype(np.int64)
        else:
            n, digits, rank = found[i, j]
        own = np.cumsum(total.reshape(len(known), -1), 1)[np.searchsorted(known, digits)]
        d = (own <= rank[:, None]).sum(1)
        rank = rank - np.where(d > 0, own[np.arange(len(d)), np.maximum(d - 1, 0)], 0)
        digits = (digits << np.uint64(bits)) | d.astype(np.uint64)
        return pa.table({
            "g": pa.array([i], pa.int32()), "c": pa.array([j], pa.int32()), "n": pa.array([n], pa.int64()),
            "digits": pa.array([digits.view(np.int64)], pa.list_(pa.int64())), "rank": pa.array([rank], pa.list_(pa.int64())),
        })

    got = rows.mapInArrow(count, "g int, c int, code array<long>, n array<long>").groupBy("g", "c").applyInArrow(chosen, "g int, c int, n long, digits array<long>, rank array<long>")
    return {(r["g"], r["c"]): (r["n"], np.array(r["digits"], np.int64).view(np.uint64), np.array(r["rank"], np.int64)) for r in got.collect()}  # groups x columns


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "pos") -> DataFrame:
    """First ``k`` rows per group under ``order``.

    The rank filter lets Spark keep only ``k`` rows per group and map task
    before the shuffle, so a hot group never travels whole.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first under ``order`` (dedup keep-latest / keep-first)."""
    return top_k(df, keys, order, 1, "_pos").drop("_pos")
