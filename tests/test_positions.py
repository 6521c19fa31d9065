from pyspark.sql import functions as F

from panelwright.operators import positions as ps
from panelwright.operators import skew


def _panel(spark):
    rows = [
        ("f", "a", "2020-01", 24241, 100.0, 5.0, "X"), ("f", "a", "2020-02", 24242, 100.4, 5.0, "X"),
        ("f", "a", "2020-03", 24243, 102.0, 5.0, "X"), ("f", "a", "2020-04", 24244, 90.0, 5.0, "X"),
        ("f", "a", "2020-05", 24245, 90.0, 5.2, "X"), ("f", "a", "2020-09", 24249, 90.0, 5.2, "X"),
        ("f", "b", "2020-12", 24252, 1.0, 1.0, "Y"),
    ]
    return spark.createDataFrame(rows, "fund string, isin string, period string, month_ord int, quantity double, pct_nav double, sector string")


def test_classifier_branches_and_periods(spark):
    got = ps.classify_positions(_panel(spark)).orderBy("isin", "month_ord").collect()
    assert [r["position_action"] for r in got] == ["INITIAL_POSITION", "HOLD", "BUY", "SELL", "BUY", "INITIAL_POSITION", "INITIAL_POSITION"]
    assert [r["holding_tenure"] for r in got] == [1, 2, 3, 4, 5, 1, 1]
    assert got[5]["holding_period_id"] == "f|a|2"


def test_exits(spark):
    got = {r["exit_month"] for r in ps.detect_exits(ps.classify_positions(_panel(spark))).collect()}
    assert got == {"2020-05"}  # the last row of a is 3 months before the fund's last report


def _ranks_and_quantiles(rows, probs):
    """By sorting, for (key, value, id) rows; NULL values have no rank."""
    groups, ranks, quants = {}, {}, {}
    for k, v, _ in rows:
        groups.setdefault(k, []).extend([] if v is None else [v])
    for k, v, i in rows:
        ranks[i] = None if v is None else 1 + sum(x > v for x in groups[k])
    for k, vs in groups.items():
        vs = sorted(vs)
        if vs:
            at = [p * (len(vs) - 1) for p in probs]
            quants[k] = [vs[int(a)] + (vs[min(int(a) + 1, len(vs) - 1)] - vs[int(a)]) * (a - int(a)) for a in at]
    return ranks, quants


def test_ranks_and_quantiles_with_hot_and_null_groups(spark, tmp_path):
    import random

    r = random.Random(3)
    rows = [("hot" if i % 10 else r.choice([None, "a", "b"]), None if i % 17 == 0 else round(r.random() * 40, 1), i) for i in range(2000)]
    rows += [("only null", None, 2000), (None, None, 2001)]
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    ranks, quants = _ranks_and_quantiles(rows, probs)
    memory = spark.createDataFrame(rows, "k string, v double, id long")
    memory.write.parquet(f"{tmp_path}/t")
    for df in (memory, spark.read.parquet(f"{tmp_path}/t")):
        for buckets in (None, 7):
            assert {x["id"]: x["r"] for x in skew.rank_descending(df, ["k"], "v", "r", buckets).collect()} == ranks
            got = {x["k"]: x["q"] for x in skew.quantiles(df, ["k"], "v", probs, "q", buckets).collect()}
            assert got.keys() == quants.keys()
            assert all(abs(x - y) < 1e-9 for k in got for x, y in zip(got[k], quants[k]))
    assert [round(x, 9) for x in skew.quantiles(memory, [], "v", [0.5], "q").first()["q"]] == [
        round(x, 9) for x in _ranks_and_quantiles([("k", v, i) for _, v, i in rows], [0.5])[1]["k"]
    ]


def test_top_k_filters_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 5).alias("k"), "id")
    plan = skew.top_k(df, ["k"], [F.desc("id")], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
