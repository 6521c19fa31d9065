"""Joins of the assembly stage: id maps, lookups, fuzzy names, fills, source chains."""

from __future__ import annotations

import difflib
from itertools import combinations
from math import ceil, comb, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.cleaning import text_key
from panelwright.operators import skew
from panelwright.session import require_columns


def merge_id_maps(a: DataFrame, b: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Full outer join of two maps on ``key``; values of ``a`` are preferred."""
    left = a.select(key, *[F.col(c).alias(f"_a_{c}") for c in cols])
    right = b.select(key, *[F.col(c).alias(f"_b_{c}") for c in cols])
    joined = left.join(right, key, "full_outer")
    return joined.select(key, *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in cols])


def first_source_wins(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """Union of lookup tables where an earlier source keeps the key."""
    tagged = [
        s.select(text_key(F.col(key)).alias(key), text_key(F.col(value)).alias(value), F.lit(i).alias("_src"))
        for i, s in enumerate(sources)
    ]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    out = out.where(F.col(key).isNotNull() & F.col(value).isNotNull() & (F.col(key) != "") & (F.col(value) != ""))
    return skew.keep_one(out, [key], [F.col("_src"), F.col(value)]).drop("_src")


def coverage_counts(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Matched and missing distinct ids."""
    ids = ids.select(key).distinct().withColumn("_one", F.lit(1))
    known = known.select(key).distinct().withColumn("_hit", F.lit(1))
    j = ids.join(known, key, "left")
    return j.agg(
        F.count("*").alias("n_ids"),
        F.count("_hit").alias("n_matched"),
        (F.count("*") - F.count("_hit")).alias("n_missing"),
    )


def left_join_unique(left: DataFrame, right: DataFrame, keys: list[str], tag: str, order: list[Column]) -> DataFrame:
    """Left join against a right side made unique first, so the row count cannot grow.

    Columns the left side already has are renamed with ``tag``.
    """
    require_columns(left, keys)
    require_columns(right, keys)
    right = skew.keep_one(right, keys, order)
    clash = {c: f"{tag}_{c}" for c in right.columns if c not in keys and c in left.columns}
    return left.join(right.withColumnsRenamed(clash), keys, "left")


def fill_missing(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Overwrite only NULLs of ``cols`` from ``right`` (unique on ``keys``)."""
    r = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in cols])
    out = left.join(r, keys, "left")
    return out.withColumns({c: F.coalesce(c, f"_r_{c}") for c in cols}).drop(*[f"_r_{c}" for c in cols])


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


@F.pandas_udf(T.DoubleType())
def matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Block-matching ratio of two names (only ever sees candidate pairs)."""
    return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b)])


def _floor(c: Column) -> Column:
    return F.floor(c + F.lit(1e-9)).cast("int")


def letter_bits(c: Column) -> Column:
    """Bit set of the letters of a text: 16 groups of letters, up to four of each counted."""

    def add(bits: Column, letter: Column) -> Column:
        at = (F.ascii(letter) % 16) * 4
        own = F.call_function("shiftrightunsigned", bits, at).bitwiseAND(F.lit(15).cast("long"))
        return bits.bitwiseOR(F.call_function("shiftleft", (own * 2 + 1).bitwiseAND(F.lit(15).cast("long")), at))

    return F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda bits, letter: F.when(letter == "", bits).otherwise(add(bits, letter)))


# Subsequences a text may have to be found by them; keys of a join task, and keys made at a time.
MOST_KEYS, TASK_KEYS, KEY_CHUNK = 1000, 1_000_000, 1 << 20


def common_letters(la: int, lb: int, cutoff: float, by_ratio: bool) -> int:
    """Length of a subsequence that two texts of these lengths must share to reach ``cutoff``."""
    slack = 1.0 - cutoff
    if by_ratio:
        return ceil((la + lb - floor((la + lb) * slack + 1e-9)) / 2)
    return max(la, lb) - floor(max(la, lb) * slack + 1e-9)


def subsequence_keys(texts: DataFrame, col: str, wanted: dict[int, list[int]]) -> DataFrame:
    """(col, _key) with a hash of every subsequence of the ``wanted`` lengths, given by length of the text."""
    combos = {(n, m): np.array(list(combinations(range(n), m))) for n, ms in wanted.items() for m in ms}

    def keys(batches):
        for b in batches:
            text = b.column(0)
            points = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in text.to_pylist()]
            size = np.array([len(x) for x in points])
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                x = np.stack([points[i] for i in rows]).astype(np.uint64)
                for m in wanted.get(n, ()):
                    at, step = combos[n, m], max(1, KEY_CHUNK // len(combos[n, m]))
                    for a in range(0, len(rows), step):
                        h = np.full((len(x[a : a + step]), len(at)), m, np.uint64)
                        for j in range(m):
                            h = (h + x[a : a + step, at[:, j]]) * np.uint64(0x9E3779B97F4A7C15)
                            h ^= h >> np.uint64(29)
                        h.sort(1)
                        own = np.ones(h.shape, bool)
                        own[:, 1:] = h[:, 1:] != h[:, :-1]
                        who = np.repeat(rows[a : a + step], own.sum(1))
                        yield pa.RecordBatch.from_arrays([text.take(pa.array(who)), pa.array(h[own].view(np.int64))], [col, "_key"])

    return texts.select(col).mapInArrow(keys, f"{col} string, _key long")


def subsequence_pairs(names: DataFrame, targets: DataFrame, short: dict[tuple[int, int], int], tasks: int, sizes: dict[int, int], alike) -> DataFrame:
    """Pairs of texts whose lengths are in ``short`` that share a subsequence of the length given there."""
    of_name: dict[int, list[int]] = {}
    of_target: dict[int, list[int]] = {}
    for (la, lb), m in sorted(short.items()):
        of_name.setdefault(la, []).append(m)
        of_target.setdefault(lb, []).append(m)
    of_name, of_target = ({n: sorted(set(ms)) for n, ms in x.items()} for x in (of_name, of_target))
    total = sum(sizes.get(n, 0) * comb(n, m) for n, ms in of_target.items() for m in ms)
    tasks = max(tasks, -(-total // TASK_KEYS))
    n = subsequence_keys(names, "name", of_name).repartition(tasks, "_key")
    t = subsequence_keys(targets, "target", of_target).repartition(tasks, "_key").hint("shuffle_hash")
    return n.join(t, "_key").where(alike(F.col("name"), F.col("target"))).select("name", "target").distinct()


def fuzzy_pairs(names: DataFrame, targets: DataFrame, cutoff: float, by_ratio: bool) -> DataFrame:
    """All (name, target) pairs that can reach ``cutoff``, found by equi-joins.

    Short texts, with few subsequences of the length that a pair must share, are joined on hashes of these:
    nearly all pairs that meet are true ones, so the work grows with the names. Others are joined on pieces.
    """
    slack = 1.0 - cutoff
    stretch = (2.0 - cutoff) / cutoff if by_ratio else 1.0 / cutoff
    names, targets = (df.select(F.col("name").alias(c)).where(F.length("name") > 0).distinct() for df, c in ((names, "name"), (targets, "target")))
    sizes = [{r[0]: r[1] for r in df.groupBy(F.length(df.columns[0])).count().collect()} for df in (names, targets)]  # as many as texts have lengths
    pairs = [(la, lb) for la in sizes[0] for lb in sizes[1] if ceil(la / stretch - 1e-9) <= lb <= floor(la * stretch + 1e-9)]
    common = {p: common_letters(*p, cutoff, by_ratio) for p in pairs}
    short = {p: m for p, m in common.items() if m > 0 and max(comb(p[0], m), comb(p[1], m)) <= MOST_KEYS}
    long = [p for p in pairs if p not in short]

    def alike(a: Column, b: Column) -> Column:
        la, lb = F.length(a), F.length(b)
        return F.levenshtein(a, b) <= _floor((la + lb if by_ratio else F.greatest(la, lb)) * F.lit(slack))

    tasks = max(2, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    found = subsequence_pairs(names, targets, short, tasks, sizes[1], alike) if short else None
    if found is None or long:
        rest = piece_pairs(names, targets.withColumnsRenamed({"target": "name"}), cutoff, by_ratio, long)
        found = found.unionByName(rest) if found is not None else rest
    return found


def piece_pairs(names: DataFrame, targets: DataFrame, cutoff: float, by_ratio: bool, lengths: list[tuple[int, int]]) -> DataFrame:
    """All (name, target) pairs of the given ``lengths`` that can reach ``cutoff``, found by an equi-join.

    A pair that reaches the cutoff differs by at most d edits: (1 - cutoff) of
    the longer length for edit similarity, of both lengths together for the
    block ratio. Cut the target into d + 1 consecutive pieces; one of them must
    stand unchanged in the name, moved by s places where the edits that s and
    the remaining shift need are at most d. Targets publish their pieces keyed
    by (length, piece number, text), names probe with the substrings that could
    be that piece, for lengths that occur. No candidate is capped: inside the
    join, two bit sets tell pairs whose letters differ too much, the edit
    distance is checked for the rest, and only true pairs leave it.
    """
    slack = 1.0 - cutoff
    stretch = (2.0 - cutoff) / cutoff if by_ratio else 1.0 / cutoff

    def edits(la: Column, lb: Column) -> Column:
        return _floor((la + lb if by_ratio else F.greatest(la, lb)) * F.lit(slack))

    def pieces_of(length: Column) -> Column:
        return edits(length, _floor(length * F.lit(stretch))) + 1

    def start(i: Column, length: Column, pieces: Column) -> Column:
        return F.floor(i * length / pieces).cast("int")

    t = targets.select(F.col("name").alias("target")).where(F.length("target") > 0).distinct()
    t = t.withColumn("_len", F.length("target")).withColumn("_m", pieces_of(F.col("_len")))
    t = t.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    s0, s1 = start(F.col("_i"), F.col("_len"), F.col("_m")), start(F.col("_i") + 1, F.col("_len"), F.col("_m"))
    t = t.select("target", "_len", "_i", F.substr("target", s0 + 1, s1 - s0).alias("_piece"), letter_bits(F.col("target")).alias("_tb"))
    lengths = names.sparkSession.createDataFrame(lengths, "_ln int, _len int")  # as many as texts have lengths

    n = names.select("name").where(F.length("name") > 0).distinct().withColumn("_ln", F.length("name"))
    n = n.withColumn("_nb", letter_bits(F.col("name"))).join(F.broadcast(lengths), "_ln")
    n = n.withColumns({"_m": pieces_of(F.col("_len")), "_d": edits(F.col("_ln"), F.col("_len"))})
    n = n.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    n = n.withColumns(
        {
            "_s": start(F.col("_i"), F.col("_len"), F.col("_m")),
            "_w": start(F.col("_i") + 1, F.col("_len"), F.col("_m")) - start(F.col("_i"), F.col("_len"), F.col("_m")),
        }
    )
    # A piece moved by s needs |s| edits before it and |rest - s| behind it.
    rest = F.col("_ln") - F.col("_len")
    spare = F.floor((F.col("_d") - F.abs(rest)) / 2).cast("int")
    lo = F.greatest(F.col("_s") + F.least(rest, F.lit(0)) - spare, F.lit(0))
    hi = F.least(F.col("_s") + F.greatest(rest, F.lit(0)) + spare, F.col("_ln") - F.col("_w"))
    probes = F.array_distinct(F.transform(F.sequence(lo, hi), lambda p: F.substr(F.col("name"), p + 1, F.col("_w"))))
    n = n.where((lo <= hi) & (spare >= 0)).select("name", "_d", "_len", "_i", "_nb", F.explode(probes).alias("_piece"))
    # One edit takes away one letter and adds one; unmatched letters of both sides add up in the block ratio.
    gone, new = (F.bit_count(a.bitwiseAND(F.bitwise_not(b))) for a, b in ((n["_nb"], t["_tb"]), (t["_tb"], n["_nb"])))
    alike = (gone + new if by_ratio else F.greatest(gone, new)) <= F.col("_d")

    close = F.levenshtein(F.col("name"), F.col("target")) <= F.col("_d")
    hit = (n["_len"] == t["_len"]) & (n["_i"] == t["_i"]) & (n["_piece"] == t["_piece"]) & alike & close
    # A fixed number of tasks: few bytes make many pairs here, adaptive coalescing would leave one task.
    tasks = max(2, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    keys = ["_len", "_i", "_piece"]
    return n.repartition(tasks, *keys).join(t.repartition(tasks, *keys).hint("shuffle_hash"), hit).select("name", "target").distinct()


def fuzzy_match(names: DataFrame, targets: DataFrame, cutoff: float = 0.75, by_ratio: bool = False) -> DataFrame:
    """Best target per distinct name at or above ``cutoff``; largest target text on ties."""
    pairs = fuzzy_pairs(names, targets, cutoff, by_ratio)
    score = matcher_ratio if by_ratio else edit_similarity
    pairs = pairs.withColumn("similarity", score(F.col("name"), F.col("target"))).where(F.col("similarity") >= cutoff)
    best = pairs.groupBy("name").agg(F.max(F.struct("similarity", "target")).alias("_b"))
    return best.select("name", F.col("_b.target").alias("target"), F.col("_b.similarity").alias("similarity"))


def group_mean_features(panel: DataFrame, source: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Join group means of the columns the panel does not have yet."""
    new = [c for c in cols if c not in panel.columns]
    means = source.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in new])
    return panel.join(means, keys, "left")
