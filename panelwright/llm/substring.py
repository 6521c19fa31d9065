"""Repeated passages: FM-indexes over wavelet trees, one per shard of text.

A window is ``width`` consecutive words. A word is removed when some window
over it also starts earlier: in a document of smaller id, or before in the
same document.

1. One pass hashes words and picks anchors: of every window the run of GRAM
   words with the least hash, leftmost if equal. Equal windows have equal
   anchors at equal places. Documents with the same words are one from here
   on; of these the smallest id stays, and all windows of the others repeat.
2. Anchors are counted; only those seen twice can lie in repeated windows.
   Windows that follow one another under one such anchor form a segment (at
   most width - GRAM + 1 windows), keyed by the anchor, so equal windows have
   equal keys. Anchors seen more than HOT times are cut into single windows
   keyed by the window: a passage of a third of all documents does not gather
   in one task. Equal segments combine in the map tasks: the first one stays,
   all windows of the others repeat.
3. Segments that differ go to shards by key. A shard of about SHARD_WORDS
   words is indexed: suffix order, Burrows-Wheeler transform, wavelet tree of
   packed bits with rank counts. All its segments are then streamed through
   backward search, all ends at once: an end is extended to the left while its
   interval holds more than one suffix, which gives its matching statistic,
   the longest run ending there that occurs elsewhere too. Where it reaches
   ``width``, the interval tells whether its first suffix starts earlier.
4. Verdicts (a bit per window) go back to all places of a segment, and the
   covered words are taken out of the documents concerned.

Edge cases: null or empty texts have no words; documents shorter than a window
keep all words; rows repeating a doc_id are no earlier than one another and
get the same verdict; rows without doc_id keep all words and are no source;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import WHITE, Words, arrow_map, gram_hashes, partitions, read, run_hashes, signed, small_batches, stage, steps, texts_of
from panelwright.llm.registry import query

GRAM = 8
HOT = 1000
SHARD_WORDS = 300_000
_SECOND = 0xA24BAED4963EE407
_NOTHING = hashlib.sha256(b"").hexdigest()


# --- anchors ----------------------------------------------------------------


def anchors(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (first words), the place of each one's anchor, and hashes of all GRAM-word runs."""
    g = gram_hashes(hashes, GRAM)
    span = width - GRAM + 1
    starts = np.concatenate([np.arange(a, max(a, b - width + 1)) for a, b in zip(bounds, bounds[1:])] or [np.empty(0, np.int64)]).astype(np.int64)
    if not len(starts):
        return starts, starts, g
    least, place, have = g, np.arange(len(g)), 1
    while have < span:
        step = min(have, span - have)
        left = least[: len(least) - step] <= least[step:]
        place = np.where(left, place[: len(place) - step], place[step:])
        least = np.where(left, least[: len(least) - step], least[step:])
        have += step
    return starts, place[starts], g


def _first_pass(docs: DataFrame, width: int) -> DataFrame:
    def run(batch):
        texts = texts_of(batch.column(1))
        n, whole, found = [], [], []
        for x, y in steps(texts):
            w = Words(texts[x:y], WHITE, False)
            starts, place, g = anchors(w.hashes, w.bounds, width)
            new = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.empty(0, bool)
            at = place[new]
            cut = np.searchsorted(at, w.bounds)
            for i in range(y - x):
                own = at[cut[i] : cut[i + 1]]
                n.append(int(w.bounds[i + 1] - w.bounds[i]))
                whole.append(hashlib.sha256(w.joined(w.bounds[i], w.bounds[i + 1])).hexdigest())
                found.append(g[own].tobytes() + (own - w.bounds[i]).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(whole), pa.array(found, pa.binary())], ["doc_id", "text_hash", "n_words", "sha", "anchors"])

    small_batches(docs.sparkSession)
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")), run, "doc_id long, text_hash long, n_words long, sha string, anchors binary")


def _split(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n)


def _repeated(firsts: DataFrame) -> DataFrame:
    """(doc_id, places, hot) of anchors that occur twice or more, as arrays per document."""

    def counted(batch):
        h, n = np.unique(np.concatenate([_split(x)[0] for x in batch.column(0).to_pylist()]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n.astype(np.int32))], ["hash", "n"])

    def spread(batch):
        both = [_split(x) for x in batch.column(1).to_pylist()]
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(h) for h, _ in both])
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(np.concatenate([h for h, _ in both]))), pa.array(ids), pa.array(np.concatenate([p for _, p in both]).astype(np.int32))], ["hash", "doc_id", "place"]
        )

    counts = arrow_map(firsts.select("anchors"), counted, "hash long, n int").groupBy("hash").agg(F.sum("n").alias("n"))
    twice = stage(counts.where("n > 1").select("hash", (F.col("n") > HOT).alias("hot")), "anchors-twice")
    rows = arrow_map(firsts.select("doc_id", "anchors"), spread, "hash long, doc_id long, place int")
    return rows.join(twice, "hash").groupBy("doc_id").agg(F.collect_list(F.when(F.col("hot"), -1 - F.col("place")).otherwise(F.col("place"))).alias("places"))


# --- segments ---------------------------------------------------------------


def segments(starts: np.ndarray, place: np.ndarray, wanted: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and whether hot, of the segments of one document."""
    at = np.searchsorted(wanted, place)
    at = np.minimum(at, max(0, len(wanted) - 1))
    keep = wanted[at] == place if len(wanted) else np.zeros(len(place), bool)
    starts, place, single = starts[keep], place[keep], hot[at[keep]] if len(wanted) else keep[keep]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | single[1:]
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), single[first]


def _segments(found: DataFrame, width: int) -> DataFrame:
    """doc_id, sha, start, n, key, hi, lo (128-bit print of the words) and the words."""

    def run(batch):
        ids, shas, texts, lists = (batch.column(i).to_pylist() for i in range(4))
        out = [[] for _ in range(8)]
        for doc, sha, text, marks in zip(ids, shas, texts, lists):
            w = Words([text], WHITE, False)
            starts, place, g = anchors(w.hashes, w.bounds, width)
            marks = np.array(marks, np.int64)
            hot, wanted = marks < 0, np.where(marks < 0, -1 - marks, marks)
            by = np.argsort(wanted)
            a, n, single = segments(starts, place, wanted[by], hot[by])
            if not len(a):
                continue
            b = a + n + width - 1
            hi, lo = run_hashes(w.hashes, a, b), run_hashes(w.hashes, a, b, _SECOND)
            first_window = np.searchsorted(starts, a)
            key = np.where(single, hi, g[place[first_window]])
            for c, x in zip(out, ([doc] * len(a), [sha] * len(a), a.tolist(), n.tolist(), signed(key).tolist(), signed(hi).tolist(), signed(lo).tolist(), [w.joined(i, j).decode("utf-8", "surrogatepass") for i, j in zip(a.tolist(), b.tolist())])):
                c.extend(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SEGMENT)], schema=_SEGMENT)

    return arrow_map(found, run, "doc_id long, sha string, start int, n int, key long, hi long, lo long, words string")


_SEGMENT = pa.schema([
    ("doc_id", pa.int64()), ("sha", pa.string()), ("start", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("words", pa.string()),
])


# --- the index --------------------------------------------------------------


class Bits:
    """Packed bits with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, low = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))


class WaveletTree:
    """Rank over a sequence of symbols: one level of bits per binary digit."""

    def __init__(self, symbols: np.ndarray, digits: int):
        self.levels, self.zeros = [], []
        for d in range(digits - 1, -1, -1):
            bit = (symbols >> d & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often ``symbol`` occurs before ``low`` and before ``high``."""
        first = np.zeros(len(symbol), np.int64)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbol >> (len(self.levels) - 1 - k) & 1).astype(bool)
            places = []
            for x in (first, low, high):
                n = level.ones(x).astype(np.int64)
                places.append(np.where(one, zeros + n, x - n))
            first, low, high = places
        return low - first, high - first


class FMIndex:
    """Backward search over a collection of word sequences.

    Ends of sequences sort before all words, in the order of the sequences,
    and are one symbol (0) in the transform, which no search asks for.
    """

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        """text: symbols from 1 with 0 at ``ends``."""
        n, m = len(text), len(ends)
        rank = text.astype(np.int64) + m
        rank[ends] = np.arange(m)
        step, distinct = 1, 0
        while distinct < n:  # prefix doubling
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = new
            distinct, step = int(new[-1]) + 1, step * 2
        self.text, self.suffixes = text, order
        top = int(text.max(initial=0))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.tree = WaveletTree(text[order - 1], max(1, top.bit_length()))

    def extend(self, symbol, low, high):
        a, b = self.tree.rank(symbol, low, high)
        return self.before[symbol] + a, self.before[symbol] + b

    def repeats(self, width: int) -> np.ndarray:
        """First words of the windows whose words also start earlier in the text.

        Every word is an end; its interval is extended to the left while it
        holds another suffix and the sequence goes on.
        """
        end = np.flatnonzero(self.text)
        at = end.copy()
        low, high = self.before[self.text[at]], self.before[self.text[at] + 1]
        for _ in range(width - 1):
            go = (high - low > 1) & (at > 0)
            go[go] = self.text[at[go] - 1] > 0
            end, at = end[go], at[go] - 1
            low, high = self.extend(self.text[at], low[go], high[go])
        full = high - low > 1
        at, low, high = at[full], low[full], high[full]
        if not len(at):
            return at
        group, back = np.unique(low, return_inverse=True)
        stop = np.zeros(len(group), np.int64)
        stop[back] = high
        earliest = np.minimum.reduceat(self.suffixes, np.stack([group, np.minimum(stop, len(self.suffixes) - 1)], 1).reshape(-1))[::2]
        last = stop == len(self.suffixes)
        if last.any():  # an interval up to the last suffix
            earliest[last] = [self.suffixes[g:].min() for g in group[last]]
        return np.sort(at[at > earliest[back]])


def shard_verdicts(words: list[list[bytes]], width: int) -> list[int]:
    """Bit i of each sequence's verdict: its i-th window starts earlier in the shard."""
    flat = [x for s in words for x in s]
    names = {x: i for i, x in enumerate(dict.fromkeys(flat), 1)}
    lengths = np.array([len(s) + 1 for s in words])
    ends = np.cumsum(lengths) - 1
    text = np.zeros(int(lengths.sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = [names[x] for x in flat]
    found = FMIndex(text, ends).repeats(width)
    owner = np.searchsorted(ends, found)
    out = [0] * len(words)
    for i, bit in zip(owner.tolist(), (found - (ends - lengths + 1)[owner]).tolist()):
        out[i] |= 1 << bit
    return out


def _verdicts(distinct: DataFrame, width: int) -> DataFrame:
    """(hi, lo, mask) of segments with windows that occur in earlier segments."""

    def run(batches):
        held, size, last = [], 0, None

        def flush():
            rows = sorted(held, key=lambda r: r[:2])  # by first document and place
            got = shard_verdicts([r[4].encode("utf-8", "surrogatepass").split(b" ") for r in rows], width)
            hits = [(r[2], r[3], m) for r, m in zip(rows, got) if m]
            return pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], pa.int64()) for i in range(3)], ["hi", "lo", "mask"])

        for b in batches:
            for key, *row in zip(*(b.column(i).to_pylist() for i in range(6))):
                if size >= SHARD_WORDS and key != last:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += row[4].count(" ") + 2
                last = key
        if held:
            yield flush()

    dealt = distinct.select("key", "first.doc_id", "first.start", "hi", "lo", "words").repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "hi long, lo long, mask long")


# --- the operator -----------------------------------------------------------


def repeated_words(docs: DataFrame, width: int = 20) -> tuple[DataFrame, DataFrame]:
    """Two tables: every row (doc_id, n_words, sha of all words, whether a whole
    ``copy``), and documents that lose words (text, hits: start, n, mask per segment)."""
    every = stage(_first_pass(docs, width), "first-pass")
    long = every.where(f"doc_id IS NOT NULL AND n_words >= {width}")
    firsts = stage(long.groupBy("sha").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("anchors").alias("anchors")).select("sha", "one.*", "anchors"), "first-copies")
    marks = stage(_repeated(firsts), "marks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("text IS NOT NULL")
    own = firsts.select("doc_id", "text_hash", "sha").join(marks, "doc_id")
    found = stage(texts.join(own, ["doc_id", "text_hash"]).select("doc_id", "sha", "text", "places"), "marked-texts")
    pieces = stage(_segments(found, width), "segments")
    distinct = stage(
        pieces.groupBy("hi", "lo").agg(
            F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("times"), F.first("key").alias("key"), F.first("words").alias("words")
        ),
        "distinct-segments",
    )
    shared = distinct.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    verdicts = stage(_verdicts(distinct.join(shared, "key", "left_semi"), width), "verdicts")
    judged = stage(
        distinct.join(verdicts, ["hi", "lo"], "left").where("times > 1 OR mask IS NOT NULL").select("hi", "lo", "first", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")), "judged"
    )
    whole = F.expr("shiftleft(1L, n) - 1")
    is_first = F.struct("doc_id", "start") == F.col("first")
    hits = (
        pieces.select("doc_id", "sha", "start", "n", "hi", "lo").join(judged, ["hi", "lo"])
        .select("doc_id", "sha", "start", "n", F.when(is_first, F.col("mask")).otherwise(whole).alias("mask")).where("mask <> 0").distinct()
        .groupBy("doc_id", "sha").agg(F.collect_list(F.struct("start", "n", "mask")).alias("hits"))
    )
    lost = found.join(hits, ["doc_id", "sha"]).select("doc_id", "sha", "text", "hits")
    first_of = firsts.select("sha", F.col("doc_id").alias("_first"))
    out = every.drop("anchors", "text_hash").join(first_of, "sha", "left")
    return out.withColumn("copy", F.coalesce(F.col("_first") < F.col("doc_id"), F.lit(False))).drop("_first"), lost


def _covered(bounds: np.ndarray, hits: pa.ListArray, width: int) -> np.ndarray:
    """Which words of the texts (first words: ``bounds``) lie in a repeated window."""
    rows = hits.flatten()
    start, n, mask = (rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n", "mask"))
    text = np.repeat(np.arange(len(hits)), hits.value_lengths().to_numpy(zero_copy_only=False))
    change = np.zeros(int(bounds[-1]) + 1, np.int64)
    bit = np.arange(int(n.max(initial=0)))
    for a in range(0, len(start), 1 << 14):
        part = slice(a, a + (1 << 14))
        row, col = np.nonzero((mask[part, None] >> bit & 1) & (bit < n[part, None]))
        at = (bounds[text[part]] + start[part])[row] + col
        change += np.bincount(at, minlength=len(change)) - np.bincount(np.minimum(at + width, bounds[text[part] + 1][row]), minlength=len(change))
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, width: int = 20, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row (and the kept words as ``kept_text``)."""
    every, lost = repeated_words(docs, width)

    def run(batch):
        texts = texts_of(batch.column(2))
        removed, shas, kept = [], [], []
        for x, y in steps(texts):
            w = Words(texts[x:y], WHITE, False)
            gone = _covered(w.bounds, batch.column(3).slice(x, y - x), width)
            removed += np.diff(np.concatenate([[0], np.cumsum(gone)])[w.bounds]).tolist()
            for words in w.kept(~gone):
                shas.append(hashlib.sha256(words).hexdigest())
                kept.append(words.decode("utf-8", "surrogatepass") if keep_text else None)
        columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sha", "gone", "kept_sha", "kept_text"])

    cut = stage(arrow_map(lost, run, "doc_id long, sha string, gone long, kept_sha string, kept_text string").dropDuplicates(["doc_id", "sha"]), "cut")
    out = every.join(cut, ["doc_id", "sha"], "left")
    whole_copy = F.col("copy")
    columns = [
        "doc_id", "n_words",
        F.when(whole_copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole_copy, F.lit(_NOTHING)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    ]
    if keep_text:  # null: all words are kept as they are
        columns.append(F.when(whole_copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return out.select(*columns)


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT doc_id, i, string_agg(word, ' ') OVER f AS g, count(*) OVER f AS c FROM t
      WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, i, row(doc_id, i) > min(row(doc_id, i)) OVER (PARTITION BY g) AS late FROM k WHERE c = 20),
v AS (SELECT t.doc_id, t.i, word, coalesce(bool_or(late) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
      FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.i = t.i),
o AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM v GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM w LEFT JOIN o USING (doc_id)
"""


@query("op8_repeated_passages", SQL)
def op8_repeated_passages(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents"))
