"""Whitening of embeddings: distributed QR, then a bidiagonal qd solver on its factor.

1. One pass gives the number of vectors and the sum of every dimension as
   whole numbers.
2. Each task centres its rows and reduces them, block after block, to one
   triangular factor; factors are merged in groups of FAN per level until one
   is left (blockwise QR: no product of columns is ever formed, so small
   variances keep their digits).
3. ``bidiagonal.right_singular`` finds its singular values by dqds and the
   leading directions by twisted factorisations.
4. One more pass projects every row.

Scale. A task holds one block of rows and one square factor; the driver one
factor. Passes read the source again rather than store centred rows.

Edge cases: rows whose vector is null, empty or has null or non-finite
components are left out, as are vectors of another length than that of the
smallest id; fewer dimensions than components give as many components as there
are dimensions; components without variance (to double precision) are left
out, so a single row or equal rows give no rows, as does an empty table; equal
rows and null ids keep their rows; further columns do not matter. A deviation
that does not fit in a long is null. Components beyond 2**26 / scale are held there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.bidiagonal import right_singular
from panelwright.llm.common import arrow_map, drop_stage, read, stage
from panelwright.llm.registry import query
from panelwright.llm.vectors import LARGEST, dimension, matrix, usable

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
# Rows of one QR step, and factors merged by one task.
BLOCK, FAN = 4096, 16


def whole_rows(column: pa.ListArray, dim: int, scale: int, shift: int) -> np.ndarray:
    """floor(scale * component) + shift of all rows, as 64-bit whole numbers."""
    x = np.floor(matrix(column, dim).astype(np.float64) * scale)
    return np.clip(x, -LARGEST, LARGEST).astype(np.int64) + shift


def fit_list(rows: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int]:
    """Usable vectors as (vec_id, v) and their length."""
    kept = rows.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("v")).where(usable(F.col("v")))
    dim = dimension(kept, "v", "vec_id")
    return kept.where(F.size("v") == dim), dim


def sums(vectors: DataFrame, dim: int, scale: int, shift: int) -> tuple[int, np.ndarray]:
    """Number of vectors and whole-number sum of every dimension."""

    def part(b: pa.RecordBatch):
        x = whole_rows(b.column("v"), dim, scale, shift)
        yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.sum(0)], pa.list_(pa.int64()))], ["n", "s"])

    parts = arrow_map(vectors.select("v"), part, "n long, s array<long>")
    total = parts.select("n", F.posexplode("s").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = total.orderBy("at").collect()  # one row per dimension
    return (out[0]["n"], np.array([r["s"] for r in out], np.int64)) if out else (0, np.zeros(dim, np.int64))


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - s / n with one rounding."""
    return (n * x - s) / n


def triangular(blocks) -> np.ndarray | None:
    """Triangular factor of all blocks below one another."""
    r = None
    for block in blocks:
        r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
    return r


def _square(r: np.ndarray, dim: int) -> np.ndarray:
    return np.vstack([r, np.zeros((dim - len(r), dim))]) if len(r) < dim else r


def factor(vectors: DataFrame, dim: int, n: int, s: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """Triangular factor (dim x dim) of all centred rows."""

    def blocks(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(centred(whole_rows(b.column("v"), dim, scale, shift), n, s))
            size += b.num_rows
            if size >= BLOCK:
                yield np.vstack(held)
                held, size = [], 0
        if held:
            yield np.vstack(held)

    def local(batches):
        r = triangular(blocks(batches))
        if r is not None:
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([r.tobytes()])], ["slot", "r"])

    def merged(key, group):
        parts = (np.frombuffer(r, np.float64).reshape(-1, dim) for r in group.sort_by("slot").column("r").to_pylist())
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int64()), "r": [triangular(parts).tobytes()]})

    factors = stage(vectors.select("v").mapInArrow(local, "slot long, r binary"), "white-factors")
    while _more_than_one(factors):
        last = factors
        factors = stage(last.groupBy(F.floor(F.col("slot") / FAN).alias("group")).applyInArrow(merged, "slot long, r binary"), "white-factors")
        drop_stage(last)
    out = np.frombuffer(factors.collect()[0]["r"], np.float64).reshape(-1, dim)  # one row
    drop_stage(factors)
    return _square(out, dim)


def _more_than_one(rows: DataFrame) -> bool:
    return len(rows.limit(2).select("slot").collect()) > 1


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT
) -> tuple[DataFrame, dict]:
    """(vec_id, deviation, w: whitened components) of every usable row, and the fit.

    The fit holds n, sums, values (all eigenvalues of the covariance), lead
    (those of the components), directions (columns) and trace.
    """
    vectors, dim = fit_list(rows, id_col, vector)
    n, s = sums(vectors, dim, scale, shift) if dim else (0, np.zeros(0, np.int64))
    fit = {"n": n, "sums": s, "values": np.zeros(0), "lead": np.zeros(0), "directions": np.zeros((dim, 0)), "trace": 0.0}
    if n:
        r = factor(vectors, dim, n, s, scale, shift)
        values, lead, directions = right_singular(r, most)
        fit |= {"values": values / n, "lead": lead / n, "directions": directions, "trace": float((r * r).sum()) / n}
    lead, directions = fit["lead"], fit["directions"]
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def project(b: pa.RecordBatch):
        x = whole_rows(b.column("v"), dim, scale, shift)
        w = centred(x, n, s) @ directions / np.sqrt(lead)
        yield pa.RecordBatch.from_arrays(
            [b.column("vec_id"), deviations(x, n, s), pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"]
        )

    return arrow_map(vectors, project, f"vec_id {kind}, deviation long, w array<double>"), fit


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n x - s)^2, exact; null beyond 64 bits."""
    far = n * (LARGEST + abs(SHIFT)) + int(np.abs(s).max(initial=0))
    if far < 1 << 62:
        d = n * x - s
        if x.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < 1 << 63:
            return pa.array((d * d).sum(1))
    d = n * x.astype(object) - s.astype(object)
    total = [int(t) for t in (d * d).sum(1)]
    return pa.array([t if t < 1 << 63 else None for t in total], pa.int64())


def identity_error(white: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened columns minus the identity (divisor n, centred)."""
    w = [F.element_at("w", i + 1) for i in range(k)]
    mean = white.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(w)]).collect()[0]
    c = [x - F.lit(float(mean[i])) for i, x in enumerate(w)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = white.agg(*[F.avg(c[i] * c[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()[0]
    return max((abs(cov[x] - (i == j)) for x, (i, j) in enumerate(pairs)), default=0.0)


def components(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    white, fit = whiten(rows, id_col, vector)
    k = len(fit["lead"])
    if k:
        white = stage(white, "white-rows")
    error = identity_error(white, k) if k else 0.0
    shares = F.array(*[F.lit(float(e / fit["trace"])) for e in fit["lead"]]).cast("array<double>")
    out = white.select("vec_id", "deviation", F.posexplode("w").alias("_at", "whitened"))
    return out.select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(fit["n"]).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_at")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )


@query("op13_whitened")
def op13_whitened(spark, sf_dir):
    return components(read(spark, sf_dir, "embeddings"))
