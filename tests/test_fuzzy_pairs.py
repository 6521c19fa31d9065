"""Fuzzy pairs keep every pair that reaches the cutoff, whatever letters and lengths."""

import difflib
import random

from pyspark.sql import functions as F

from panelwright.operators import joins as jn


def _texts(rnd, n):
    out = []
    for _ in range(n):
        a = "".join(rnd.choice("abcp\u00e9\u4e2d") for _ in range(rnd.randint(1, 14)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randint(0, 1)] = [rnd.choice(["", "a", "q"])]
        out.append((a, "".join(b)))
    return out


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_no_pair_is_lost(spark):
    made = _texts(random.Random(3), 120)
    names, targets = ({t for t in side if t} for side in zip(*made))
    n, t = (spark.createDataFrame([(x,) for x in side], "name string") for side in (names, targets))
    got = {(r["name"], r["target"]) for r in jn.fuzzy_pairs(n, t, 0.75, False).collect()}
    assert {(a, b) for a in names for b in targets if 1 - _distance(a, b) / max(len(a), len(b)) >= 0.75} <= got
    got = {(r["name"], r["target"]) for r in jn.fuzzy_pairs(n, t, 0.75, True).collect()}
    assert {(a, b) for a in names for b in targets if difflib.SequenceMatcher(None, b, a).ratio() >= 0.75} <= got


def test_letter_bits_count_up_to_four_of_a_letter(spark):
    df = spark.createDataFrame([("aaaaaa", 4), ("ab", 2), ("", 0), ("aqq", 3)], "x string, n int")
    assert all(r["n"] == r["b"] for r in df.select("n", F.bit_count(jn.letter_bits(F.col("x"))).alias("b")).collect())


def test_short_texts_meet_on_shared_subsequences_only(spark, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choice("0123456789abcdef") for _ in range(12)) for _ in range(150)]
    other = [b[:4] + "z" + b[4:] for b in base[:40]] + ["y" + b[1:9] + "ü" + b[10:] for b in base[40:80]] + [b[2:] for b in base[80:120]] + [b[::-1] for b in base[120:]] + ["aaaaaaaaaaaa", "abababababab"]
    base += ["aaaaaaaaaaab", "babababababa"]
    table = lambda x: spark.createDataFrame([(i,) for i in x], "name string")
    for by_ratio in (False, True):
        if by_ratio:
            want = {(a, b) for a in other for b in base if difflib.SequenceMatcher(None, b, a).ratio() >= 0.75}
        else:
            want = {(a, b) for a in other for b in base if 1 - _distance(a, b) / max(len(a), len(b)) >= 0.75}
        with monkeypatch.context() as m:
            m.setattr(jn, "piece_pairs", None)  # not needed for short texts
            got = {(r["name"], r["target"]) for r in jn.fuzzy_pairs(table(other), table(base), 0.75, by_ratio).collect()}
        assert want <= got and len(want) >= 120 and (by_ratio or got == want)
