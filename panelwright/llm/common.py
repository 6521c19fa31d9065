"""Shared parts of the corpus operators: reading, staging, text chunks, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.session import shared_folder

# Texts of one vectorised step together hold about this many characters; a
# longer text is a step of its own. It bounds memory and changes no result.
STEP_CHARS = 1 << 20
# Rows of one Arrow batch handed to Python (texts can be long).
ARROW_ROWS = "256"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table; Arrow batches are kept small because rows hold texts."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the cluster's shared folder."""
    return f"{shared_folder(spark)}/panelwright/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage with files that outlive executors, and gives the readers a
    plain scan, so that a join above can be re-planned and split.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the staged files that ``df`` reads, once nothing else will read them."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    own = f"{shared_folder(df.sparkSession)}/panelwright/llm/"
    folders = {f[: f.index(own) + len(own)] + f[f.index(own) + len(own) :].split("/")[0] for f in df.inputFiles() if own in f}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts of an Arrow column; null is empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def steps(texts: list[str], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts that are worked on together."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if texts:
        yield a, len(texts)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` of ``fn(batch) -> iterable of batches``, empty batches skipped."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


# --- hashes of words and word runs -----------------------------------------

_ODD = 0x9E3779B97F4A7C15 | 1
_ODD2 = 0xD1342543DE82EF95 | 1
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64 bits (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        up, down = np.full(m, base, np.uint64), np.full(m, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if m <= 1 << 23:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _ODD) -> np.ndarray:
    """Karp-Rabin fingerprints (modulo 2**64, then mixed) of values[start:end].

    One running sum serves all runs: the sum between two ends is brought to
    power zero by the inverse power of its start.
    """
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def byte_class(separators) -> np.ndarray:
    """Boolean table: which of the 256 byte values are separators."""
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


# Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = byte_class([0x20, *range(0x09, 0x0E)])
# All ASCII but digits and lower-case letters (texts are lower-cased before).
NON_WORD = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Words:
    """Words of several texts as arrays.

    ``hashes`` 64-bit word fingerprints, ``starts`` and ``ends`` byte offsets in
    ``data``, ``bounds`` first word of each text (one more entry at the end).
    """

    def __init__(self, texts: list[str], separators: np.ndarray, lower: bool):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(raw) + b"\n"
        buf = np.frombuffer(self.data, np.uint8)
        if lower:
            buf = _LOWER[buf]
            self.data = buf.tobytes()
        gap = separators[buf]
        first = np.empty(len(buf), bool)
        first[0] = not gap[0]
        np.logical_and(~gap[1:], gap[:-1], out=first[1:])
        last = np.zeros(len(buf), bool)
        np.logical_and(gap[1:], ~gap[:-1], out=last[1:])
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last)
        self.hashes = run_hashes(_BYTES[buf], self.starts, self.ends)
        self._odd = None
        begin = np.cumsum([0] + [len(r) + 1 for r in raw])
        self.bounds = np.searchsorted(self.starts, begin)

    def __len__(self) -> int:
        return len(self.starts)

    def kept(self, keep: np.ndarray) -> list[bytes]:
        """Per text the words flagged in ``keep``, joined by one space."""
        buf = np.frombuffer(self.data, np.uint8).copy()
        buf[self.ends] = 0x20  # behind every word there is a separator or the end of its text
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[self.starts[keep]] += 1
        inside[self.ends[keep] + 1] -= 1
        taken = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        size = np.concatenate([[0], np.cumsum((self.ends - self.starts + 1) * keep)])[self.bounds]
        out = buf[taken].tobytes()
        return [out[a : max(a, b - 1)] for a, b in zip(size.tolist(), size[1:].tolist())]

    def text_of(self, i: int) -> slice:
        return slice(self.bounds[i], self.bounds[i + 1])

    def joined(self, a: int, b: int) -> bytes:
        """Words a..b-1 joined by one space."""
        if self._odd is None:  # how many gaps so far are not one space
            buf = np.frombuffer(self.data, np.uint8)
            odd = (self.starts[1:] - self.ends[:-1] != 1) | (buf[self.ends[:-1]] != 0x20)
            self._odd = np.concatenate([[0, 0], np.cumsum(odd)])
        if a < b and self._odd[b] == self._odd[a + 1]:
            return self.data[self.starts[a] : self.ends[b - 1]]
        return b" ".join(self.data[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist()))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of ``n`` consecutive words (runs may cross texts)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    at = np.arange(m)
    return run_hashes(hashes, at, at + n, _ODD2)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's signed longs."""
    return x.astype(np.uint64, copy=False).view(np.int64)


def crc_third(doc_id="doc_id"):
    """crc32 of the id as text, modulo 3: which fold a document is in."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))
