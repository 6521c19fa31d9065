"""Token ids as binary files: canonical length-limited Huffman coding.

Files. ``codes`` holds the code length of every id that occurs (the canonical
codes follow from the lengths). ``blocks`` holds rows of (part, block, first,
n, data): independent blocks of whole documents in ascending doc_id order, at
least BLOCK ids each but the last of a part. ``data`` is, little-endian,

    "PWH1", u32 documents, u32 ids, u32 checkpoints
    per document: u8 has an id, i64 doc_id, u32 ids
    per checkpoint: u32 bit offset of every CHECK-th id in the bits
    the code bits, first bit highest, as big-endian u32 words

Parquet carries the rows, since Spark's writers reach whatever store the
cluster has; no value is coded by Parquet.

Writing: documents are tokenised once into a staged table, ids are counted
over it (one row per id and task, then at most a vocabulary of rows on the
driver), documents are dealt by ranges of doc_id and coded. Reading: every
checkpoint is a lane of its own, and all lanes of some blocks are decoded in
step by one table of 2^max_length entries.

Edge cases: a null or empty text is the end id alone; rows repeating a doc_id
follow one another; documents with null doc_id come first; an empty table
gives no blocks and reads back as an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import arrow_map, new_folder, partitions, read, small_batches, stage, texts_of
from panelwright.llm.registry import query
from panelwright.llm.tokens import encoder

BLOCK = 1 << 17
CHECK = 128
MAX_LENGTH = 18
TOGETHER = 8  # blocks decoded in step
_MAGIC = b"PWH1"


# --- the code ---------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code length of each symbol (0: does not occur), none above ``limit``.

    Package-merge: of every level's list, sorted by weight, the packages of
    neighbours go up to the next; a symbol's length is the number of levels
    on which it is among the chosen.
    """
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_package = leaves, [np.zeros(len(leaves), bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        kind = np.repeat([False, True], [len(leaves), len(packages)])
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_package.append(kind[by])
    take = 2 * len(leaves) - 2
    lengths = np.zeros(len(leaves), np.uint8)
    for kind in reversed(is_package):
        down = int(kind[:take].sum())
        lengths[: take - down] += 1
        take = 2 * down
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol), as integers."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = last = 0
    top = int(lengths.max(initial=0))
    for n in range(1, top + 1):
        these = order[lengths[order] == n]
        code <<= n - last
        last = n
        codes[these] = code + np.arange(len(these), dtype=np.uint64)
        code += len(these)
    return codes


class Code:
    """Tables of one code for coding and decoding."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths, canonical(lengths)
        self.width = max(1, int(lengths.max(initial=1)))
        self.symbol = np.zeros(1 << self.width, np.int32)
        self.step = np.ones(1 << self.width, np.int64)
        used = np.flatnonzero(lengths)
        span = 1 << (self.width - lengths[used].astype(np.int64))
        at = self.codes[used].astype(np.int64) * span
        place = np.repeat(at - (np.cumsum(span) - span), span) + np.arange(span.sum())
        self.symbol[place] = np.repeat(used, span)
        self.step[place] = np.repeat(lengths[used].astype(np.int64), span)

    def bits(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offset of every id, and the packed bits."""
        n = self.lengths[ids].astype(np.int64)
        stop = np.cumsum(n)
        at = stop - n
        value = self.codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
        words = int(stop[-1] + 31 >> 5) + 1 if len(ids) else 1
        # bits of different ids never overlap, so sums below 2^32 are unions
        total = np.bincount(at >> 5, (value >> np.uint64(32)).astype(np.float64), words + 1)
        total += np.bincount((at >> 5) + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words + 1)
        return at, total[:words].astype(">u4").tobytes()


def write_block(code: Code, doc_ids: list, ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids)
    at, packed = code.bits(flat)
    marks = at[::CHECK].astype("<u4")
    head = struct.pack("<4sIII", _MAGIC, len(ids), len(flat), len(marks))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    sizes = np.array([len(x) for x in ids], "<u4")
    return b"".join([head, known.tobytes(), names.tobytes(), sizes.tobytes(), marks.tobytes(), packed])


def read_blocks(code: Code, blocks: list[bytes]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, sizes, all ids) of each block, decoded together."""
    heads, lanes, words, counts, base = [], [], [], [], 0
    for data in blocks:
        magic, docs, n, marks = struct.unpack_from("<4sIII", data)
        if magic != _MAGIC:
            raise ValueError("not a block of ids")
        o = 16
        known = np.frombuffer(data, np.uint8, docs, o)
        names = np.frombuffer(data, "<i8", docs, o := o + docs)
        sizes = np.frombuffer(data, "<u4", docs, o := o + 8 * docs)
        lanes.append(np.frombuffer(data, "<u4", marks, o := o + 4 * docs).astype(np.int64) + 32 * base)
        own = np.frombuffer(data, ">u4", -1, o + 4 * marks)
        words.append(own.astype(np.uint64))
        heads.append(([int(d) if k else None for d, k in zip(names, known)], sizes.astype(np.int64)))
        counts.append((n, marks))
        base += len(own)
    w = np.concatenate([*words, np.zeros(CHECK * code.width // 32 + 2, np.uint64)])
    pairs = (w[:-1] << np.uint64(32)) | w[1:]
    at = np.concatenate(lanes)
    out = np.empty((CHECK, len(at)), np.int32)
    drop, mask = 64 - code.width, np.uint64((1 << code.width) - 1)
    for k in range(CHECK):
        seen = ((pairs[at >> 5] >> (drop - (at & 31)).astype(np.uint64)) & mask).astype(np.int64)
        out[k] = code.symbol[seen]
        at = np.minimum(at + code.step[seen], 32 * (len(pairs) - 1))
    lane = 0
    for head, (n, marks) in zip(heads, counts):
        yield *head, out[:, lane : lane + marks].T.reshape(-1)[:n]
        lane += marks


# --- writing and reading ----------------------------------------------------


def token_ids(docs: DataFrame, end_id: int = 0, path: str | None = None) -> DataFrame:
    """doc_id, n, ids (binary, 2 bytes an id if the vocabulary allows, else 4)."""

    def run(batch):
        coder = encoder(path)
        kind = id_type(max(coder.vocabulary(), end_id + 1))
        ids = [np.append(x, end_id).astype(kind) for x in coder.encode(texts_of(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n", "ids"])

    small_batches(docs.sparkSession)
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, ids binary")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def id_counts(ids: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs; tasks send one row per id they met."""

    kind = id_type(vocabulary)

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary, np.int64)  # at most a vocabulary of rows came
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def write_ids(docs: DataFrame, folder: str, end_id: int = 0, path: str | None = None, max_length: int = MAX_LENGTH, block: int = BLOCK) -> None:
    """Tokenise ``docs`` and write ``folder``/codes and ``folder``/blocks."""
    spark = docs.sparkSession
    vocabulary = max(encoder(path).vocabulary(), end_id + 1)
    kind = id_type(vocabulary)
    ids = stage(token_ids(docs, end_id, path), "ids")
    lengths = code_lengths(id_counts(ids, vocabulary), max_length)
    used = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(used, "id int, length int").coalesce(1).write.parquet(f"{folder}/codes")
    shared = spark.sparkContext.broadcast(lengths)  # one byte per id of the vocabulary

    def run(batches):
        code, part = Code(shared.value), TaskContext.get().partitionId()
        held, names, size, number, first = [], [], 0, 0, 0

        def flush():
            return pa.RecordBatch.from_pydict({"part": [part], "block": [number], "first": [first], "n": [size], "data": [write_block(code, names, held)]}, schema=_BLOCKS)

        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                held.append(np.frombuffer(raw.as_buffer(), kind))
                names.append(name)
                size += len(held[-1])
                if size >= block:
                    yield flush()
                    held, names, size, number, first = [], [], 0, number + 1, first + size
        if held:
            yield flush()

    dealt = ids.select("doc_id", "ids").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    dealt.mapInArrow(run, "part int, block int, first long, n long, data binary").write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


_BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])


def _decoded(spark: SparkSession, folder: str, each, schema: str) -> DataFrame:
    """``each(doc_id, start, ids) -> row`` over all documents of the files."""
    codes = spark.read.parquet(f"{folder}/codes").collect()  # at most a vocabulary of rows
    lengths = np.zeros(1 + max([0, *(r.id for r in codes)]), np.uint8)
    for r in codes:
        lengths[r.id] = r.length
    blocks = spark.read.schema("part int, block int, first long, n long, data binary").parquet(f"{folder}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row per file part
    before = dict(zip([r.part for r in parts], np.cumsum([0] + [r.n for r in parts]).tolist()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")

    def run(batches):
        code = Code(lengths)
        for b in batches:
            part, first, data = (b.column(i).to_pylist() for i in range(3))
            for x in range(0, len(data), TOGETHER):
                rows = []
                for k, (names, sizes, ids) in enumerate(read_blocks(code, data[x : x + TOGETHER])):
                    start, a = before[part[x + k]] + first[x + k], 0
                    for name, n in zip(names, sizes.tolist()):
                        rows.append(each(name, start + a, ids[a : a + n]))
                        a += n
                yield pa.RecordBatch.from_pydict({f.name: list(v) for f, v in zip(arrow, zip(*rows))}, schema=arrow)

    kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return blocks.select("part", "first", "data").mapInArrow(run, schema)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids of the files, in ascending order inside each part."""
    return _decoded(spark, folder, lambda d, s, ids: (d, s, ids.tolist()), "doc_id long, start long, ids array<int>")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids of the files."""
    return _decoded(
        spark, folder, lambda d, s, ids: (d, s, len(ids), zlib.crc32(ids.astype("<u4"))), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


@query("op2_huffman_ids")
def op2_huffman_ids(spark, sf_dir):
    folder = new_folder(spark, "huffman")
    write_ids(read(spark, sf_dir, "documents"), folder)
    return digests(spark, folder)
