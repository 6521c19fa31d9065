"""Best-fit packing of token sequences with a bounded number of open bins.

A document is its ids followed by an end id. Only documents longer than a
sequence are cut: whole sequences from its end, the first piece may be shorter.

Tokenising is a map over the documents that leaves one small row per piece
(written out, so it runs once). The pieces are then dealt into ranges of
doc_id of about PACK_PIECES pieces; each range is packed online in order of
(doc_id, piece): a piece goes to the open bin with the least free space that
holds it. Free spaces present are bits of one integer, so that bin is found by
a shift and the lowest set bit. With ``open_bins`` bins open, the fullest is
closed before a new one opens. Ranges make the work grow with the cluster; a
range leaves at most ``open_bins`` bins less than full.

Edge cases: a null or empty text is the end id alone; texts of any length are
cut as above; rows repeating a doc_id are pieces of their own; a null doc_id
is packed first; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import arrow_map, read, small_batches, stage, texts_of
from panelwright.llm.registry import query
from panelwright.llm.tokens import encoder

PACK_PIECES = 100_000
OPEN_BINS = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    head = n % length
    edges = ([0] if head else []) + list(range(head, n + 1, length))
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def pieces(docs: DataFrame, length: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """One row per piece with the crc32 of its ids."""

    def run(batch):
        coder = encoder(path)
        rows = ([], [], [], [], [])
        for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(texts_of(batch.column(1)))):
            data = np.append(ids, end_id).astype("<u4")
            for k, (a, n) in enumerate(cuts(len(data), length)):
                for column, x in zip(rows, (doc, k, a, n, zlib.crc32(data[a : a + n]))):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, _ARROW)], schema=_ARROW)

    small_batches(docs.sparkSession)
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECES)


class OpenBins:
    """Bounded-space best fit; bins are (sequence number, filled)."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.present = 0  # bit f is set while a bin with f free places is open
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.present ^= 1 << free
        self.open -= 1
        return number

    def put(self, n: int) -> tuple[int, int]:
        """Sequence and offset of a piece of n ids."""
        fits = self.present >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.present & -self.present).bit_length() - 1)
            free, number = self.length, self.made
            self.made += 1
        if free > n:
            self.by_free[free - n].append(number)
            self.present |= 1 << (free - n)
            self.open += 1
        return number, self.length - free


def pack(docs: DataFrame, length: int = 2048, end_id: int = 0, path: str | None = None, open_bins: int = OPEN_BINS, range_pieces: int = PACK_PIECES) -> DataFrame:
    """Pieces with sequence_id and offset."""
    made = stage(pieces(docs, length, end_id, path), "pieces")
    ranges = max(1, math.ceil(made.count() / range_pieces))

    def run(frames):
        bins = OpenBins(length, open_bins)
        base = TaskContext.get().partitionId() << 40
        for f in frames:
            places = [bins.put(n) for n in f["length"].tolist()]
            out = pd.DataFrame(places, columns=["sequence_id", "offset"], index=f.index).astype("int64")
            out["sequence_id"] += base
            yield pd.concat([f, out], axis=1)

    dealt = made.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "piece", "length", "ids_crc32")
    return dealt.mapInPandas(run, PIECES + ", sequence_id long, offset long")


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))
