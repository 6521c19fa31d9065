import random

from panelwright.operators import egonet as eg
from panelwright.operators import graph as gp
from panelwright.operators import joins as jn


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_fuzzy_match_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    names, targets = sorted({word(rng.randint(4, 11)) for _ in range(60)}), sorted({word(rng.randint(4, 11)) for _ in range(60)})
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    got = {r["name"]: (round(r["similarity"], 9), r["target"]) for r in jn.fuzzy_match(df(names), df(targets)).collect()}
    want = {}
    for n in names:
        best = max((round(1 - _distance(n, t) / max(len(n), len(t)), 9), t) for t in targets)
        if best[0] >= 0.75:
            want[n] = best
    assert got == want


def test_fingerprint_ignores_node_names(spark):
    e = "array<struct<src:string,etype:string,dst:string>>"
    one = [("Fund:a", "HOLDS", "Stock:x"), ("Stock:x", "BELONGS_TO", "Sector:s"), ("Fund:a", "HOLDS", "Stock:y"), ("Stock:y", "BELONGS_TO", "Sector:s")]
    two = [("Fund:b", "HOLDS", "Stock:q"), ("Stock:q", "BELONGS_TO", "Sector:t"), ("Fund:b", "HOLDS", "Stock:p"), ("Stock:p", "BELONGS_TO", "Sector:t")]
    three = [*two[:3], ("Stock:p", "BELONGS_TO", "Sector:u")]
    g = spark.createDataFrame([("1", one), ("2", two), ("3", three)], f"shape string, edges {e}")
    h = {}
    for r in eg.wl_histograms(g, "shape").collect():
        h.setdefault(r["shape"], {})[r["label"]] = r["n"]
    assert h["1"] == h["2"] and h["1"] != h["3"]


def test_sorted_index_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(x,) for x in "hgabbczz"], "k string")
    got = {r["k"]: r["i"] for r in eg.sorted_index(df, "k", "i").collect()}
    assert got == {k: i for i, k in enumerate("abcghz")}


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert sorted(tuple(r) for r in gp.upsert(old, new, ["k"]).collect()) == [("a", 1), ("b", 9), ("c", 3)]


def test_paths_use_no_edge_twice(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {"".join(r["chain"]) for r in gp.paths(e, 4).collect()}
    assert {"ab", "abc", "abcd", "cabc"[1:], "bcab"[:3]} <= got and "abca" not in got


def test_path_summaries_equal_enumeration(spark):
    import random

    r = random.Random(5)
    layered = [(f"a{r.randint(0, 4)}", f"b{r.randint(0, 4)}") for _ in range(15)] + [(f"b{r.randint(0, 4)}", f"c{r.randint(0, 4)}") for _ in range(15)] + [("c1", "d0"), ("a0", "d0")]
    for edges in (layered, layered + [("d0", "a1")], [("x", "x"), ("x", "y")], []):
        e = spark.createDataFrame(edges, "src string, dst string")
        want = {}
        for p in gp.paths(e, 4).collect():
            want.setdefault((p.chain[-1], p.length), []).append(" > ".join(p.chain))
        for k in (1, 3):
            got = {(p.tip, p.length): (p.n, p.chains) for p in gp.path_summaries(e, 4, k).collect()}
            assert {key: v[0] for key, v in got.items()} == {key: len(v) for key, v in want.items()}
            if not len(edges) == len(set(edges)):  # equal edges give equal chains
                assert all(v[1][0] == min(want[key]) for key, v in got.items())
            else:
                assert {key: v[1] for key, v in got.items()} == {key: sorted(v)[:k] for key, v in want.items()}
