import pytest
from pyspark.sql import functions as F

from panelwright.operators import evaluate as ev
from panelwright.operators import explain as ex
from panelwright.operators import graph as gp
from panelwright.operators import invariance as iv
from panelwright.sources import files as fs


def _write(path, name, text):
    path.mkdir(exist_ok=True)
    (path / name).write_text(text)


def test_news_with_mixed_headers_in_one_folder(spark, tmp_path):
    d = tmp_path / "news"
    _write(d, "a.csv", "Date,Heading,Source,Symbol\n01-02-2024,up,X,AA\n")
    _write(d, "b.csv", "headline,published,ticker\ndown,02-02-2024,BB\nnaïve,03-02-2024,BB\n")
    _write(d, "c.csv", "date,lang\n03-02-2024,en\n")
    _write(d, "d.csv", "Title,Datetime\n\"a, b\",04-02-2024\n")
    got = {(r.Symbol, str(r.Date), r.Heading) for r in fs.load_news(spark, [str(d)]).collect()}
    assert got == {("AA", "2024-02-01", "up"), ("BB", "2024-02-02", "down"), ("d", "2024-02-04", "a, b")}


def test_news_refuses_ambiguous_and_headless_folders(spark, tmp_path):
    _write(tmp_path / "x", "a.csv", "headline,title,date\na,b,01-02-2024\n")
    _write(tmp_path / "y", "a.csv", "lang,date\na,01-02-2024\n")
    for name in "xy":
        with pytest.raises(ValueError):
            fs.load_news(spark, [str(tmp_path / name)])


def test_upsert_merges_properties_and_repeated_keys(spark):
    old = spark.createDataFrame([("a", 1, 5, "x"), (None, 1, 6, "y"), ("c", 1, 7, "z")], "k string, g int, w int, p string")
    new = spark.createDataFrame([("a", 1, 8, None, 1), ("a", 1, 9, None, 2), (None, 1, None, "q", 1), ("d", 1, 4, "n", 1)], "k string, g int, w int, p string, v int")
    got = {r.k: (r.w, r.p, r.v) for r in gp.upsert(old, new, ["k", "g"], ["v"]).collect()}
    assert got == {"a": (9, "x", 2), None: (6, "q", 1), "c": (7, "z", None), "d": (4, "n", 1)}


def test_merge_replaces_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda schema, *x: spark.createDataFrame(x, schema)
    fs.upsert_table(rows("k int, p string, w int", (1, "a", 5), (2, "b", 6), (3, None, 7)), path, ["k", "p"], "p")
    files = lambda part: sorted(f.name for f in (tmp_path / "t" / f"p={part}").glob("*.parquet"))
    before = files("b")
    got = fs.upsert_table(rows("k int, p string, v int", (1, "a", 1), (4, "a", 2), (3, None, 3)), path, ["k", "p"], "p")
    assert {(r.k, r.p, r.w, r.v) for r in got.collect()} == {(1, "a", 5, 1), (4, "a", None, 2), (2, "b", 6, None), (3, None, 7, 3)}
    assert before and files("b") == before
    bad = rows("k int, p string, w int", (1, "a", 0), (2, "b", 1)).withColumn("w", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        fs.upsert_table(bad, path, ["k", "p"], "p")
    assert files("b") == before and spark.read.option("mergeSchema", True).parquet(path).count() == 4
    with pytest.raises(ValueError):
        fs.upsert_table(bad, path, ["k"], "p")


def test_append_keeps_one_row_per_key(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "k int, p string, w int")
    path = str(tmp_path / "t")
    fs.append_new(rows((1, "a", 5), (1, "a", 4), (2, "b", 1)), path, ["k"], "p")
    got = fs.append_new(rows((1, "a", 9), (3, "a", 2), (3, "a", 1)), path, ["k"], "p")
    assert {(r.k, r.p, r.w) for r in got.collect()} == {(1, "a", 4), (2, "b", 1), (3, "a", 1)}


def test_counterfactuals_keep_decisions_without_evidence(spark):
    d = spark.createDataFrame([("i", "SELL", "a"), ("j", "BUY", "a"), ("k", "HOLD", "b"), ("l", "SELL", "none")], "isin string, predicted_label string, driver string")
    e = spark.createDataFrame(
        [("a", -0.5, None, -0.9, -0.1), ("b", None, 0.2, None, None)], "variable string, dml_theta double, granger_beta double, ci_lower_95 double, ci_upper_95 double"
    )
    got = {r.isin: (r.cf_move, r.cf_confidence, r.counterfactual is None) for r in ex.counterfactuals(d, e).collect()}
    assert got == {
        "i": ("lower", "interval excludes zero", False), "j": ("higher", "interval excludes zero", False),
        "k": ("different", "interval unknown", False), "l": (None, None, True),
    }


def test_blanket_uses_every_row_a_test_can_use(spark):
    import numpy as np

    r = np.random.default_rng(6)
    n = 600
    a, c = r.normal(size=n), r.normal(size=n)
    y = a + 0.7 * c + r.normal(size=n)
    copy = a + 0.05 * r.normal(size=n)
    holes = [None if i % 3 else float(v) for i, v in enumerate(c)]
    mostly = [None if i % 10 else float(v) for i, v in enumerate(r.normal(size=n))]
    df = spark.createDataFrame([(float(y[i]), float(a[i]), float(copy[i]), holes[i], mostly[i]) for i in range(n)], "y double, a double, copy double, c double, m double")
    cov = iv.complete_covariances(df, ["y"], ["a", "c", "m"])
    assert {k: v[0] for k, v in cov.items()} == {"a": n, "c": n // 3, "m": n // 10}
    known = [i for i in range(n) if holes[i] is not None]
    assert np.allclose(cov["c"][1], np.cov(c[known], y[known]))
    assert iv.markov_blanket(df, "y", ["m", "a", "copy", "c"]) == ["a", "c"]


def test_rank_test_gates_the_pairs(spark):
    folds = [(m, f, s) for f in range(12) for m, s in (("a", 0.9 + f / 100), ("b", 0.5 + f / 100), ("c", 0.4 + f / 100))]
    df = spark.createDataFrame(folds, "model string, fold int, accuracy double")
    row = ev.friedman(df, "accuracy").first()
    assert abs(row.statistic - 24) < 1e-9 and abs(row.p_value - np_exp(-12)) < 1e-9
    assert {(r.model_a, r.model_b): r.significant for r in ev.nemenyi(df, "accuracy").collect()} == {("a", "b"): True, ("a", "c"): True, ("b", "c"): True}
    flat = spark.createDataFrame([(m, f, 0.5 + ((f + i) % 3) / 10) for f in range(12) for i, m in enumerate("abc")], df.schema)
    assert not any(r.significant for r in ev.nemenyi(flat, "accuracy").collect())
    two = df.where("model <> 'c'")
    assert ev.nemenyi(two, "accuracy").first().significant is None


def np_exp(x):
    import math

    return math.exp(x)
