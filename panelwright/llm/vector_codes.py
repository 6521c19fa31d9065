"""Compressed vector codes: product quantisation fitted by member-resident Lloyd rounds.

A vector is cut into equal parts; each part position has a codebook of entries
and the code of a vector is the list of its nearest entries. Fitting:

* Every part lives with its owner (position, entry, salt). The first placement
  shuffles all parts to their owners; after that a part is read where it lies.
* A round sums the resident members of each owner (one small row per owner
  leaves a task) and moves the entry to their mean.
* Then members are compared with the new entries in place. Those that keep
  their entry stay where they are; only those that change it are shuffled to
  their new owner.
* Encoding needs the last codebooks only and is a pass over whole vectors
  without a shuffle.

Scale. An owner holds at most about OWNER_ROWS members, for the number of
salts follows the number of rows, so a vector that a third of all rows repeat
is spread over many owners. The driver holds codebooks only (positions x
entries x part width). Stages of a round are deleted when the next has been
written.

Edge cases: rows whose vector is null, empty or has null or non-finite
components are left out, as are vectors of another length than that of the
smallest id; fewer rows than entries give as many entries as there are rows;
of equal ids the smaller vector comes first, null ids come last; equal rows
each keep their row; null labels form one group; an empty table gives an empty
result; further columns do not matter. Components beyond 2**26 / scale are held there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import arrow_map, drop_stage, new_folder, partitions, read, stage
from panelwright.llm.registry import query
from panelwright.llm.vectors import dimension, matrix, usable, whole
from panelwright.operators.skew import join_null_safe

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Members of one owner, about.
OWNER_ROWS = 4096


def prepared(rows: DataFrame, id_col: str, vector: str, label: str, scale: int = SCALE) -> tuple[DataFrame, int]:
    """Usable vectors with whole components, staged as (_row, vec_id, label, x), and their length."""
    kept = rows.select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("_v")).where(usable(F.col("_v")))
    kept = kept.select("vec_id", "label", whole(F.col("_v"), scale).cast("array<int>").alias("x"))
    out = stage(kept.withColumn("_row", F.monotonically_increasing_id()), "code-vectors")
    dim = dimension(out, "x", "vec_id")
    return out.where(F.size("x") == dim), dim


def first_entries(vectors: DataFrame, dim: int, parts: int, entries: int) -> np.ndarray:
    """Codebooks [position, entry, component] from the vectors with the smallest ids."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    x = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, dim // parts)
    return x.transpose(1, 0, 2)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of the smallest squared distance (the first of equals) and that distance, exact."""
    width = int(np.abs(x).max(initial=0)) + int(np.abs(book).max(initial=0))
    kind = np.float64 if x.shape[1] * width * width < 1 << 52 else np.int64
    a, b = x.astype(kind), book.astype(kind)
    d = (b * b).sum(1) - 2 * (a @ b.T)
    at = d.argmin(1)
    return at.astype(np.int32), (d[np.arange(len(at)), at] + (a * a).sum(1)).astype(np.int64)


def _columns(width: int) -> list[str]:
    return [f"p{i}" for i in range(width)]


def _part_schema(width: int) -> str:
    return "position int, entry int, salt int, " + ", ".join(f"{c} int" for c in _columns(width))


def placed_parts(vectors: DataFrame, books: np.ndarray, salts: int) -> DataFrame:
    """All parts of all vectors with their nearest entry, at their owners."""
    parts, _, width = books.shape

    def cut(b: pa.RecordBatch):
        x = matrix(b.column("x"), parts * width)
        salt = pa.array(b.column("salt").to_numpy(zero_copy_only=False), pa.int32())
        for p in range(parts):
            mine = x[:, p * width : (p + 1) * width]
            at, _ = nearest(mine, books[p])
            cols = [np.full(len(mine), p, np.int32), at, salt, *[np.ascontiguousarray(c, np.int32) for c in mine.T]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["position", "entry", "salt", *_columns(width)])

    salt = F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int").alias("salt")
    out = arrow_map(vectors.select("x", salt), cut, _part_schema(width))
    return at_owners(out)


def at_owners(members: DataFrame) -> DataFrame:
    return members.repartition(partitions(members.sparkSession), "position", "entry", "salt")


def compared(members: DataFrame, books: np.ndarray) -> DataFrame:
    """Members with the nearest of the new entries and whether that is another one; no shuffle."""
    width = books.shape[2]
    names = ["position", "entry", "salt", *_columns(width)]

    def place(b: pa.RecordBatch):
        position = b.column("position").to_numpy()
        old = b.column("entry").to_numpy()
        x = np.column_stack([b.column(c).to_numpy() for c in _columns(width)])
        new = np.empty(len(old), np.int32)
        for p in np.unique(position):
            rows = position == p
            new[rows], _ = nearest(x[rows], books[p])
        cols = [position, new, b.column("salt"), *[b.column(c) for c in _columns(width)], new != old]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], [*names, "moved"])

    return arrow_map(members, place, _part_schema(width) + ", moved boolean")


def updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries moved to floor(sum / count) of their resident members; unused entries stay."""
    cols = _columns(books.shape[2])
    sums = members.groupBy("position", "entry").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in cols])
    out = books.copy()
    for r in sums.collect():  # at most positions x entries rows
        out[r["position"], r["entry"]] = [r[c] // r["n"] for c in cols]
    return out


def fit(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, owner_rows: int = OWNER_ROWS) -> np.ndarray:
    """Codebooks [position, entry, component] after ``rounds`` of Lloyd's method."""
    if dim % parts:
        raise ValueError(f"{dim} components cannot be cut into {parts} equal parts")
    spark = vectors.sparkSession
    books = first_entries(vectors, dim, parts, entries)
    salts = -(-vectors.count() // owner_rows)
    members = stage(placed_parts(vectors, books, salts), "code-members")
    for i in range(rounds):
        books = updated(members, books)
        if i == rounds - 1:
            break
        path = new_folder(spark, "code-compared")
        compared(members, books).write.partitionBy("moved").option("compression", "zstd").parquet(path)
        both = spark.read.schema(_part_schema(books.shape[2]) + ", moved boolean").parquet(path)
        arrived = stage(at_owners(both.where("moved").drop("moved")), "code-arrived")
        drop_stage(members)
        members = both.where("NOT moved").drop("moved").unionByName(arrived)
    drop_stage(members)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every vector; no shuffle."""
    parts, _, width = books.shape

    def run(b: pa.RecordBatch):
        x = matrix(b.column("x"), parts * width)
        at, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
        for p in range(parts):
            mine, d = nearest(x[:, p * width : (p + 1) * width], books[p])
            at[:, p] = mine
            error += d
        digits = at.tobytes().hex()
        code = pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)])
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), code, pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    return arrow_map(vectors.select("vec_id", "label", "x"), run, schema)


def decoded(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """The coded rows with ``vector``, their approximate components."""
    parts = books.shape[0]

    def run(b: pa.RecordBatch):
        at = np.frombuffer(bytes.fromhex("".join(b.column("code").to_pylist())), np.uint8).reshape(-1, parts)
        x = books[np.arange(parts), at].reshape(len(at), -1) / scale
        yield b.append_column("vector", pa.array(list(x), pa.list_(pa.float64())))

    return arrow_map(coded, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema.fields) + ", vector array<double>")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def label_errors(coded: DataFrame) -> DataFrame:
    """Error summed over equal labels, joined back (totals are broadcast only if their files are small)."""
    totals = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "code-labels")
    return join_null_safe(coded, totals, ["label"], "left")


def compress(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes with errors of all usable vectors, and the codebooks."""
    vectors, dim = prepared(rows, id_col, vector, label)
    if not dim:
        books = np.zeros((PARTS, 0, 1), np.int64)
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    books = fit(vectors, dim)
    coded = stage(encode(vectors, books), "code-codes")
    drop_stage(vectors)
    return coded, books


def _round_sql(i: int) -> str:
    return f"""
a{i} AS (SELECT r, p, any_value(x) AS x, min({{'d': d, 'e': e}}) AS m FROM (
    SELECT t.r, t.p, t.x, c.e, CAST(list_inner_product(t.x, t.x) - 2 * list_inner_product(t.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT) AS d
    FROM t JOIN c{i} c USING (p)) GROUP BY r, p)"""


def _mean_sql(i: int) -> str:
    return f""",
c{i} AS (SELECT c.p, c.e, coalesce(n.x, c.x) AS x FROM c{i - 1} c LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS x FROM (
      SELECT p, m.e AS e, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{i - 1}, (SELECT unnest(range(1, 1 + (SELECT max(w) FROM t))) AS j) GROUP BY 1, 2, 3)
    GROUP BY p, e) n ON n.p = c.p AND n.e = c.e)"""


SQL = """
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x, row_number() OVER (ORDER BY vec_id) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
t AS (SELECT r, p, len(x) // 16 AS w, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS x FROM k, (SELECT unnest(range(16)) AS p)),
c0 AS (SELECT p, r - 1 AS e, x FROM t WHERE r <= 64),""" + _round_sql(0) + _mean_sql(1) + "," + _round_sql(1) + _mean_sql(2) + "," + _round_sql(2) + """,
h AS (SELECT sha256(string_agg(CAST(CAST(x[j] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256
  FROM c2, (SELECT unnest(range(1, 1 + (SELECT max(w) FROM t))) AS j)),
o AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN o USING (r), h
"""


@query("op11_vector_codes", SQL)
def op11_vector_codes(spark, sf_dir):
    coded, books = compress(read(spark, sf_dir, "embeddings"))
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
