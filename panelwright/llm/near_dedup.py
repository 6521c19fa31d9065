"""Near duplicates: MinHash signatures and a multi-index Hamming join.

A document's set holds the fingerprints of its distinct runs of ``shingle``
words (fewer words: the whole sequence as one; none: empty). Documents are
linked when 100 |A n B| >= percent |A u B|; components of links are groups and
the smallest id of a group stays.

1. One pass leaves a row per document: size of the set, a 128-bit fingerprint
   of the set and SLOTS b-bit MinHash values (BITS each). Equal sets are one
   class from here on, so thousands of copies are one row.
2. The signature distance is the number of slots that differ. For a pair at
   the similarity threshold it is binomial; the distance threshold lies five
   deviations above its mean. The slots are split into chunks, one for every
   two errors allowed, so by pigeonhole two signatures within the threshold
   agree in some chunk up to one slot. Each chunk is enumerated with each of
   its slots left out: equal keys give every pair under the threshold.
3. In each bucket of equal keys only links to one pivot are tried: the member
   that meets the most others (a centre rather than a corner of its group).
   Pairs over the signature distance or the ratio of sizes fall; the rest are
   confirmed on the full sets. Components of the links follow.
4. Exact remainder: buckets whose members are not yet in one component are cut
   into tiles of at most TILE members (and TILE_ENTRIES set entries) that carry
   their full sets; equal buckets are one. In every pair of tiles an inverted
   index with prefix and length filters finds the pairs between different
   components that meet the threshold, and only a spanning forest of them
   leaves the task: no more rows than members. Components are taken again over
   all links, so no link that would join two components is lost.

Edge cases: null or empty texts, and texts without words, have an empty set
and are linked with nothing (each its own component); rows repeating a doc_id
or a text are one node (an id with several texts has the links of each); rows without doc_id take part in no link and are
returned with null component and kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import WHITE, Words, arrow_map, mix, partitions, read, run_hashes, signed, small_batches, stage, steps, texts_of
from panelwright.llm.components import components
from panelwright.llm.registry import query

SLOTS, BITS = 64, 16
TILE, TILE_ENTRIES = 2048, 1 << 22  # members and set entries of a tile, about
_RNG = np.random.default_rng(11)
_XOR = _RNG.integers(0, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2)
_MUL = _RNG.integers(0, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distance_threshold(percent: int, slots: int = SLOTS) -> int:
    """Slots that may differ: mean plus five deviations at the threshold."""
    j = percent / 100
    return min(slots - 1, math.ceil(slots * (1 - j) + 5 * math.sqrt(slots * j * (1 - j))))


def chunks(threshold: int, slots: int = SLOTS) -> list[np.ndarray]:
    """Slot numbers of each chunk; one error is allowed in each."""
    return np.array_split(np.arange(slots), min(slots // 2, threshold // 2 + 1))


def shingle_sets(texts: list[str], shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text."""
    w = Words(texts, WHITE, True)
    out = []
    for i in range(len(texts)):
        h = w.hashes[w.text_of(i)]
        if len(h) >= shingle:
            at = np.arange(len(h) - shingle + 1)
            out.append(np.unique(run_hashes(h, at, at + shingle)))
        else:
            out.append(run_hashes(h, np.zeros(1, int), np.full(1, len(h))) + np.uint64(len(h)) if len(h) else h)
    return out


def _minhash(sets: list[np.ndarray], xor: np.ndarray, mul: np.ndarray, kind) -> np.ndarray:
    out = np.zeros((len(sets), len(xor)), kind)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        edge = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for k in range(len(xor)):
            low = np.minimum.reduceat((flat ^ xor[k]) * mul[k], edge)
            out[full, k] = (mix(low) & np.uint64(np.iinfo(kind).max)).astype(kind)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """b-bit MinHash values, one row per set (zeros for empty sets)."""
    return _minhash(sets, _XOR, _MUL, np.uint16)


def chunk_keys(sig: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """One column per (chunk, slot left out)."""
    values = mix(sig.astype(np.uint64) + (np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(32)) + np.uint64(1))
    columns = []
    for c, part in enumerate(parts):
        total = values[:, part].sum(1, dtype=np.uint64)
        columns += [mix(total - values[:, s] + np.uint64(SLOTS * c + int(s) + 1 << 48)) for s in part]
    return np.stack(columns, 1)


def _signed_docs(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batch):
        ids, texts = batch.column(0), texts_of(batch.column(1))
        n, print_, sig = [], [], []
        for a, b in steps(texts):
            sets = shingle_sets(texts[a:b], shingle)
            n += [len(s) for s in sets]
            print_ += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            sig += [row.tobytes() for row in signatures(sets)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(print_, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "print", "sig"])

    small_batches(docs.sparkSession)
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, print binary, sig binary")


def _keys(classes: DataFrame, parts: list[np.ndarray]) -> DataFrame:
    """(key, id) rows; a key also tells its chunk and slot."""

    def run(batch):
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SLOTS)
        keys = chunk_keys(sig, parts)
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys.reshape(-1))), pa.array(ids)], ["key", "id"])

    return arrow_map(classes.select("id", "sig"), run, "key long, id long")


def _close(pairs: DataFrame, classes: DataFrame, threshold: int, percent: int) -> DataFrame:
    """Pairs (a, b) within the signature distance and the ratio of sizes."""
    one = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    both = pairs.join(one("b"), "b").join(one("a"), "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batch):
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SLOTS) for i in (2, 3))
        near = (a != b).sum(1) <= threshold
        yield batch.select([0, 1]).filter(pa.array(near))

    return arrow_map(both.select("a", "b", "sa", "sb"), run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, set, entries) of the documents named in ``ids``.

    The join is a sort-merge join at every size, so its cost follows the texts.
    """

    def run(batch):
        texts, rows = texts_of(batch.column(1)), []
        for a, b in steps(texts):
            rows += [s.tobytes() for s in shingle_sets(texts[a:b], shingle)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array([len(s) // 8 for s in rows], pa.int64())], ["id", "set", "entries"])

    named = docs.join(ids.distinct().hint("merge"), "id", "left_semi").select("id", "text")
    return stage(arrow_map(named, run, "id long, set binary, entries long"), "sets", "uncompressed")


def _confirmed(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets meet the threshold."""

    def run(batch):
        good = []
        for x, y in zip(batch.column(2), batch.column(3)):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([p, q])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            good.append(100 * shared >= percent * (len(both) - shared))
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one = lambda x: whole.select(F.col("id").alias(x), F.col("set").alias(f"s{x}"))
    return arrow_map(pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "sa", "sb"), run, "a long, b long")


def _split_buckets(members: DataFrame, label: DataFrame) -> DataFrame:
    """(key, id, root, n) of buckets whose members are in several components.

    Buckets of the same members are one: a group of similar texts meets in
    very many keys.
    """
    labelled = members.select("key", "id").join(label, "id", "left").withColumn("root", F.coalesce("root", "id"))
    split = labelled.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
    ).where("low <> high")
    return labelled.join(split.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), "key")


def forest(ids: np.ndarray, root: np.ndarray, tile: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of one run of a bucket: at most one fewer than members.

    Members are taken by size. With its partners at least as large, a member
    shares all but so many of its entries, so each partner holds one of its
    rarest ones (prefix filter); sizes over the ratio fall (length filter).
    What is left is counted exactly over the posting lists. Members already in
    one component are not compared.
    """
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    edge = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    by_code = np.argsort(codes, kind="stable")
    owner, held = owner[by_code], np.bincount(codes)
    first = np.concatenate([[0], np.cumsum(held)])
    group = {r: i for i, r in enumerate(dict.fromkeys(root.tolist()))}
    parent = list(range(len(group)))
    node = np.array([group[r] for r in root.tolist()])

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def postings(of: np.ndarray) -> np.ndarray:
        size = held[of]
        at = np.repeat(first[of] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return owner[at]

    out, one, left = [], tile[0] if (tile == tile[0]).all() else None, len(group)
    for i in order.tolist():
        if left == 1:
            break
        mine = codes[edge[i] : edge[i + 1]]
        need = -(-2 * percent * len(mine) // (100 + percent))
        rarest = mine if need <= 1 else mine[np.argpartition(held[mine], len(mine) - need)[: len(mine) - need + 1]]
        near = np.unique(postings(rarest))
        near = near[(rank[near] > rank[i]) & (100 * len(mine) >= percent * n[near])]
        if one is None:
            near = near[tile[near] != tile[i]]
        here = find(int(node[i]))
        near = near[np.array([find(g) != here for g in node[near].tolist()], bool)] if len(near) else near
        if not len(near):
            continue
        shared = np.bincount(postings(mine), minlength=len(n))[near]
        for j in near[100 * shared >= percent * (len(mine) + n[near] - shared)].tolist():
            a, b = find(int(node[i])), find(int(node[j]))
            if a != b:
                parent[a] = b
                left -= 1
                out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def _remainder(rows: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between different components that share a bucket: a spanning forest of every pair of tiles."""
    total = rows.select("key", "id").join(whole.select("id", "entries"), "id").groupBy("key").agg(F.sum("entries").alias("total"))
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("total") / TILE_ENTRIES))
    rows = rows.join(total, "key").withColumn("tiles", tiles).join(whole.select("id", "set"), "id").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    rows = rows.withColumn("other", other).select("key", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "id", "root", "set")

    def linked(held: list[pa.RecordBatch], a: int, b: int):
        """Links of rows a..b-1 of the batches held, one run."""
        part = pa.Table.from_batches(held).slice(a, b - a)
        ids, root, tile = (part.column(c).to_numpy() for c in ("id", "root", "tile"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("set")]
        return forest(ids, root, tile, sets, percent) if len(ids) > 1 else []

    def run(batches):
        held, keys = [], np.zeros((0, 3), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            keys = np.vstack([keys, np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "t1", "t2")])])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if not len(cuts):
                continue  # the run may go on in the next batch
            out = [e for x, y in zip([0, *cuts[:-1].tolist()], cuts.tolist()) for e in linked(held, x, y)]
            yield _edges(out)
            rest = pa.Table.from_batches(held).slice(int(cuts[-1])).to_batches()
            held, keys = rest, keys[int(cuts[-1]) :]
        if held:
            yield _edges(linked(held, 0, len(keys)))

    dealt = rows.repartition(partitions(rows.sparkSession), "key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    threshold = distance_threshold(percent)
    parts = chunks(threshold)
    every = stage(_signed_docs(docs, shingle), "signatures")
    classes = stage(
        every.where("n > 0 AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes"
    )
    keys = stage(_keys(classes, parts), "keys", "lz4")
    busy = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stage(keys.join(busy, "key"), "members", "lz4")
    degree = members.groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = members.join(degree, "id")
    pivots = ranked.groupBy("key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("pivot"))
    stars = members.join(pivots, "key").where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    tried = stage(_close(stage(stars, "stars"), classes, threshold, percent), "tried")
    both = lambda p: p.select(F.col("a").alias("id")).union(p.select("b"))
    links = stage(_confirmed(tried, _sets(texts, both(tried), shingle), percent), "links")
    label = components(links).withColumnRenamed("node", "id")
    open_buckets = stage(_split_buckets(members, label), "open-buckets", "lz4")
    if not open_buckets.isEmpty():
        more = stage(_remainder(open_buckets, _sets(texts, open_buckets.select("id"), shingle), percent), "more-links")
        if not more.isEmpty():
            label = components(links.unionByName(more)).withColumnRenamed("node", "id")
    root = stage(classes.join(label, "id", "left").select("print", F.coalesce("root", "id").alias("root")), "roots")
    out = every.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("print")).alias("print")).join(root, "print", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest id of each group, all columns as they came."""
    gone = groups(docs, shingle, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS c FROM u WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM g WHERE c = 3 UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, w.doc_id = m AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = w.doc_id
"""


@query("op10_minhash_groups", SQL)
def op10_minhash_groups(spark, sf_dir):
    return groups(read(spark, sf_dir, "documents"), shingle=3, percent=85)
