"""Benchmark passages in documents by greedy string tiling.

Words are lower-cased runs of letters and digits, so case, punctuation and
line breaks do not hide a passage. A seed is a run of MIN_MATCH words; seeds
of documents are joined with the seeds of benchmark items by their running
Karp-Rabin fingerprint. For each pair that shares seeds, the longest match of
words not yet marked is marked in both texts, again and again, until none of
MIN_MATCH words is left. The share of an item's words that ends up marked is
its coverage: since tiles may lie in any order and place, reordered passages
count in full. Items with coverage >= COVER leak into the document.

Documents are read in place and never shuffled. The benchmark is dealt into
blocks of at most BLOCK_WORDS words (counted first); a block is a broadcast of
bounded size, and every block meets all documents.

Edge cases: null or empty texts and items share nothing; an item of fewer
than MIN_MATCH words is too short to tell from chance and never matches;
repeated items are reported each; rows repeating a doc_id are reported once
per row; null ids are returned as they are; empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import NON_WORD, Words, arrow_map, gram_hashes, read, small_batches, steps, texts_of
from panelwright.llm.registry import query

MIN_MATCH = 5
COVER = 0.5
BLOCK_WORDS = 2_000_000
_BITS = 22


def tiles(item: np.ndarray, text: np.ndarray, at_item: np.ndarray, at_text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in item, place in text) from shared seeds.

    Seeds that follow one another on a diagonal make a maximal match. Matches
    are taken longest first; what marked words leave of a match goes back to
    the queue if it is long enough.
    """
    diagonal = at_text - at_item
    by = np.lexsort((at_item, diagonal))
    p, d = at_item[by], diagonal[by]
    cut = np.flatnonzero((np.diff(d) != 0) | (np.diff(p) != 1)) + 1
    queue = [(-(int(g[-1] - g[0]) + least), int(g[0]), int(g[0] + k)) for g, k in zip(np.split(p, cut), d[np.concatenate([[0], cut])])]
    heapq.heapify(queue)
    used_item, used_text = np.zeros(len(item), bool), set()
    out = []
    while queue:
        n, a, b = heapq.heappop(queue)
        n = -n
        free = ~used_item[a : a + n]
        if used_text:
            free &= np.fromiter((b + i not in used_text for i in range(n)), bool, n)
        free &= item[a : a + n] == text[b : b + n]
        if free.all():
            used_item[a : a + n] = True
            used_text.update(range(b, b + n))
            out.append((n, a, b))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if y - x >= least:
                heapq.heappush(queue, (x - y, a + x, b + x))
    return out


class Items:
    """One block of benchmark items with its seed index."""

    def __init__(self, ids: list, texts: list[str], least: int):
        self.ids, self.least = ids, least
        w = Words(texts, NON_WORD, True) if texts else None
        self.words = [w.hashes[w.text_of(i)] for i in range(len(texts))]
        seeds, item, place = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, own in enumerate(self.words):
            g = gram_hashes(own, least)
            seeds.append(g)
            item.append(np.full(len(g), i))
            place.append(np.arange(len(g)))
        g = np.concatenate(seeds)
        by = np.argsort(g, kind="stable")
        self.seeds, self.item, self.place = g[by], np.concatenate(item)[by], np.concatenate(place)[by]
        self.maybe = np.zeros(1 << _BITS, bool)  # cheap first look
        self.maybe[self.seeds & np.uint64((1 << _BITS) - 1)] = True

    def leaks(self, texts: list[str], cover: float):
        """(text, item, coverage, tiles, longest) of leaking pairs."""
        w = Words(texts, NON_WORD, True)
        g = gram_hashes(w.hashes, self.least)
        at = np.flatnonzero(self.maybe[g & np.uint64((1 << _BITS) - 1)])
        low, high = np.searchsorted(self.seeds, g[at], "left"), np.searchsorted(self.seeds, g[at], "right")
        owner = np.searchsorted(w.bounds, at, "right") - 1
        keep = (high > low) & (at + self.least <= w.bounds[owner + 1])
        at, low, n, owner = at[keep], low[keep], (high - low)[keep], owner[keep]
        if not len(at):
            return
        entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at, owner = np.repeat(at, n), np.repeat(owner, n)
        item = self.item[entry]
        by = np.lexsort((item, owner))
        cut = np.flatnonzero((np.diff(owner[by]) != 0) | (np.diff(item[by]) != 0)) + 1
        for group in np.split(by, cut):
            d, i = int(owner[group[0]]), int(item[group[0]])
            found = tiles(self.words[i], w.hashes[w.text_of(d)], self.place[entry[group]], at[group] - w.bounds[d], self.least)
            marked = sum(t[0] for t in found)
            if found and marked >= cover * len(self.words[i]):
                yield d, i, marked / len(self.words[i]), len(found), found[0][0]


def item_blocks(benchmark: DataFrame, least: int, block_words: int) -> list:
    """Broadcasts of the benchmark's blocks, each of about ``block_words`` words."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / 2 / block_words))  # a word and its gap take two characters at least
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = []
    for k in range(blocks):
        got = rows.where(block == k).orderBy("item_id", "text").collect()  # one block, bounded
        out.append(spark.sparkContext.broadcast(Items([r.item_id for r in got], [r.text for r in got], least)))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, least: int = MIN_MATCH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per leaking pair: doc_id, item_id, coverage, n_tiles, longest."""

    def against(shared):
        def run(batch):
            ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            rows = []
            for x, y in steps(texts):
                rows += [(ids[x + d], shared.value.ids[i], c, n, longest) for d, i, c, n, longest in shared.value.leaks(texts[x:y], cover)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)

        return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, item_id long, coverage double, n_tiles int, longest int")

    small_batches(docs.sparkSession)
    out = None
    for shared in item_blocks(benchmark, least, block_words):
        part = against(shared)
        out = part if out is None else out.unionByName(part)
    return out


_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("longest", pa.int32())])


def without_leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, least: int = MIN_MATCH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, all columns as they came."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def against(frame, shared):
        def run(batch):
            texts = texts_of(batch.column(at))
            keep = np.ones(len(texts), bool)
            for x, y in steps(texts):
                for d, *_ in shared.value.leaks(texts[x:y], cover):
                    keep[x + d] = False
            yield batch.filter(pa.array(keep))

        return arrow_map(frame, run, frame.schema)

    for shared in item_blocks(benchmark, least, block_words):
        docs = against(docs, shared)
    return docs


@query("op5_benchmark_leaks")
def op5_benchmark_leaks(spark, sf_dir):
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
