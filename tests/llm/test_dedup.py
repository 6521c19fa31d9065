import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import exact_dedup, near_dedup, substring
from panelwright.llm.components import components

from .docs import odd_rows, prose, table

WHITE = "[\x20\x09-\x0d]+"


def words(text):
    return [w for w in re.split(WHITE, text or "") if w]


# --- exact ------------------------------------------------------------------


def brute_exact(rows):
    norm = [re.sub(WHITE, " ", t or "") for _, t in rows]
    out = []
    for (d, _), t in zip(rows, norm):
        ids = [x for (x, _), u in zip(rows, norm) if u == t]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    rows = odd_rows() + [(20, "a b"), (21, "a \n b"), (22, " a b"), (None, "a b")]
    args = [lambda t: F.substring(t, 1, 1)] if weak else []  # nearly all hashes collide
    got = exact_dedup.decisions(table(spark, rows), *args).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute_exact(rows)


def test_exact_stage_keeps_columns_and_empty_table(spark):
    rows = [(3, "a b"), (1, "a  b"), (2, None), (4, ""), (None, "z")]
    docs = table(spark, rows)
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted([r.doc_id for r in got.collect()], key=repr) == [1, 2, None]
    assert exact_dedup.decisions(table(spark, [])).count() == 0


# --- repeated passages ------------------------------------------------------


def brute_repeats(rows, width):
    first = {}
    for d, t in rows:
        w = words(t)
        for s in range(len(w) - width + 1):
            if d is not None:
                key = tuple(w[s : s + width])
                first[key] = min(first.get(key, (d, s)), (d, s))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if d is not None and first[tuple(w[s : s + width])] < (d, s):
                gone[s : s + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def passages(seed):
    """Texts with passages shared in full, in part, within a text and at edges."""
    r = random.Random(seed)
    shared = [prose(900 + i, n) for i, n in enumerate((20, 21, 45, 120))]
    rows = []
    for i in range(40):
        w = []
        for _ in range(r.randint(1, 4)):
            w += prose(r.random(), r.randint(0, 30), 2000)
            s = r.choice(shared)
            a = r.randint(0, 6)
            w += s[a : len(s) - r.randint(0, 6)]
        rows.append((i, " ".join(w)))
    rows += [(60, rows[5][1] + " tail"), (60, "head " + rows[6][1]), (61, rows[7][1]), (61, rows[7][1].replace(" ", "  "))]
    return rows + [(50, rows[3][1]), (51, rows[3][1].replace(" ", "\n")), (52, "z " * 90), (53, " ".join(shared[2] * 3))]


@pytest.mark.parametrize("hot", [1000, 2])
def test_repeated_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    rows = odd_rows() + [(d + 100, t) for d, t in passages(hot)]
    got = substring.remove_repeats(table(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute_repeats(rows, 20)


def test_repeated_passages_empty_table(spark):
    assert substring.remove_repeats(table(spark, [])).count() == 0


def test_kept_text(spark):
    p = " ".join(prose(4, 25))
    got = {r.doc_id: r.kept_text for r in substring.remove_repeats(table(spark, [(1, "a " + p), (2, "b  " + p + " c"), (3, "a " + p)]), keep_text=True).collect()}
    assert got == {1: None, 2: "b c", 3: ""}


def test_index_counts_every_pattern():
    r = np.random.default_rng(5)
    text = r.integers(1, 6, 400)
    ends = np.array([99, 180, 181, 399])
    text[ends] = 0
    index = substring.FMIndex(text, ends)
    joined = "".join(map(str, text))
    for _ in range(200):
        n = int(r.integers(1, 6))
        pattern = r.integers(1, 6, n)
        low, high = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        wanted = [i for i in range(len(joined)) if joined.startswith("".join(map(str, pattern)), i)]
        assert sorted(index.suffixes[low[0] : max(low[0], high[0])].tolist()) == wanted


def test_anchor_is_leftmost_least_of_its_window():
    h = np.random.default_rng(1).integers(0, 3, 300).astype(np.uint64) + np.uint64(17)
    starts, place, g = substring.anchors(h, np.array([0, 120, 135, 300]), 20)
    assert starts.tolist() == [*range(0, 101), *range(135, 281)]
    span = 20 - substring.GRAM + 1
    assert place.tolist() == [s + int(np.argmin(g[s : s + span])) for s in starts.tolist()]


# --- near duplicates --------------------------------------------------------


def brute_near(rows, shingle, percent):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = []
    for _, t in rows:
        w = words((t or "").translate(lower))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} - {()})
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    out = []
    for (d, _), s in zip(rows, sets):
        c = None if d is None else find(d)
        out.append((d, len(s), c, d == c))
    return sorted(out, key=repr)


def families(seed):
    """Copies of some texts with a few words changed: stars, chains and strangers."""
    r = random.Random(seed)
    rows, n = [], 100
    for f in range(6):
        base = prose(f + 10 * seed, r.choice([30, 80, 200]), 3000)
        chain = base
        for k in range(14):
            w = list(chain if f % 2 else base)
            for _ in range(max(1, len(w) // (55 if f % 3 else 25))):
                w[r.randrange(len(w))] = f"w{r.random()}"
            chain = w
            rows.append((n, " ".join(w).upper() if k % 5 == 0 else "  ".join(w)))
            n += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shingle,percent,tile", [(3, 85, 2048), (5, 80, 3)])
def test_near_groups(spark, monkeypatch, shingle, percent, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "TILE_ENTRIES", 200 * tile)
    rows = odd_rows() + families(shingle)
    got = near_dedup.groups(table(spark, rows), shingle, percent).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute_near(rows, shingle, percent)


def test_forest_joins_what_all_pairs_join():
    r = random.Random(4)
    for trial in range(40):
        base = [r.sample(range(10_000), r.choice([3, 20, 60])) for _ in range(3)]
        sets, root, tile = [], [], []
        for i in range(30):
            b = list(r.choice(base))
            for _ in range(r.randint(0, 4)):
                b[r.randrange(len(b))] = r.randrange(10_000)
            sets.append(np.array(sorted(set(b)), np.uint64))
            root.append(r.choice([i, 0]))
            tile.append(r.randint(0, 1) if trial % 2 else 0)
        got = near_dedup.forest(np.arange(30), np.array(root), np.array(tile), sets, 80)

        def joined(links):
            p = list(range(30))
            for a, b in [*links, *[(i, j) for i in range(30) for j in range(i) if root[i] == root[j]]]:
                x, y = p[a], p[b]
                p = [x if q == y else q for q in p]
            return {frozenset(i for i in range(30) if p[i] == q) for q in p}

        every = [
            (i, j) for i in range(30) for j in range(i)
            if (trial % 2 == 0 or tile[i] != tile[j] or len(set(tile)) == 1) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
        ]
        assert joined(got) == joined(every) and len(got) < 30 and all((max(e), min(e)) in every for e in got)


def test_links_of_the_remainder_grow_with_members_only():
    sizes = {}
    for g in (200, 400):
        base = np.arange(1, 61, dtype=np.uint64)
        sets = [np.unique(np.append(base[base != i % 60 + 1], 1000 + i)).astype(np.uint64) for i in range(g)]
        sizes[g] = len(near_dedup.forest(np.arange(g), np.arange(g), np.zeros(g, int), sets, 85))
    assert sizes == {200: 199, 400: 399}


def test_near_stage_and_empty_table(spark):
    t = " ".join(prose(8, 300))
    docs = table(spark, [(5, t), (4, t + " end"), (6, None), (None, t), (7, "")])
    got = near_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted([r.doc_id for r in got.collect()], key=repr) == [4, 6, 7, None]
    assert near_dedup.groups(table(spark, [])).count() == 0


def test_chunk_keys_meet_within_the_threshold():
    r = np.random.default_rng(2)
    for percent in (80, 85):
        threshold = near_dedup.distance_threshold(percent)
        parts = near_dedup.chunks(threshold)
        for _ in range(300):
            a = r.integers(0, 1 << 16, (1, near_dedup.SLOTS)).astype(np.uint16)
            b = a.copy()
            b[0, r.permutation(near_dedup.SLOTS)[:threshold]] ^= 1
            assert (near_dedup.chunk_keys(a, parts) == near_dedup.chunk_keys(b, parts)).any()


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 95: 90, 100: 90}
