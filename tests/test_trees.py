import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelwright.operators import learners as ln
from panelwright.operators import trees as tr

COLS = ["a", "b", "c"]


def sample(n=1500, seed=3):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.integers(0, 20, n) / 4, r.integers(0, 9, n) * 1.5, r.integers(0, 30, n) * 0.1])
    y = np.clip(np.round(x[:, 0] / 2 + np.sin(x[:, 1]) + r.normal(0, 0.7, n)), 0, 2).astype(int)
    return x, y


def fitted(spark, model, x, y, test):
    put = lambda x, y: VectorAssembler(inputCols=COLS, outputCol="features").transform(spark.createDataFrame([(*map(float, row), float(k)) for row, k in zip(x, y)], [*COLS, "label"]))
    return np.array([r["prediction"] for r in model.fit(put(x, y)).transform(put(test, np.zeros(len(test)))).collect()]).astype(int)


def cells(x, y):
    at, place = np.unique(x, axis=0, return_inverse=True)
    return at, np.stack([np.bincount(place.ravel(), y == k, len(at)) for k in range(3)], 1)


def test_model_families_has_the_full_models():
    assert tr.FOREST == {"trees": 200, "depth": 10} and tr.BOOSTED == {"trees": 150, "depth": 4, "step": 0.1}


def test_boosting_of_cells_is_that_of_mllib_on_rows(spark):
    (x, y), (test, _) = sample(), sample(400, 4)
    want = fitted(spark, OneVsRest(classifier=GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.1), parallelism=3), x, y, test)
    at, n = cells(x, y)
    got = tr.predictions(spark, at, n, test, forest={"trees": 1, "depth": 1}, boosted={"trees": 8, "depth": 3, "step": 0.1})["boosted"]
    assert (got == want).mean() > 0.995 and len(at) < len(x)


def test_a_tree_is_that_of_mllib_on_rows(spark):
    (x, y), (test, _) = sample(), sample(400, 5)
    want = fitted(spark, DecisionTreeClassifier(maxDepth=5), x, y, test)
    at, n = cells(x, y)
    cuts = [tr.cut_points(at[:, j], n.sum(1)) for j in range(3)]
    tree = tr.grow(tr.binned(at, cuts), n.astype(float), 5, 32, tr._gini, tr._shares)
    assert (tree.leaves(tr.binned(test, cuts)).argmax(1) == want).mean() > 0.99


def test_cut_points_of_many_values_share_the_rows():
    v = np.arange(1000.0)
    w = np.where(v < 10, 500.0, 1.0)
    cuts = tr.cut_points(v, w)
    assert len(cuts) <= 31 and (np.diff(cuts) > 0).all() and (cuts[:9] == v[:9] + 0.5).all()


def test_holdout_counts_cover_every_row_and_equal_mllib(spark):
    x, y = sample(2000)
    rows = [(f"{2000 + i % 10}", *map(float, r), float(k)) for i, (r, k) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, ("2009", 1.0, None, 2.0, 1.0), ("2009", 1.0, 1.0, 1.0, None)], "period string, a double, b double, c double, y double")
    got = ln.holdout_counts(df, COLS, "y", F.col("period") < "2007").collect()
    names = {"boosted", "forest", "logistic", "naive"}
    assert {r["model"] for r in got} == names and all(sum(r["n"] for r in got if r["model"] == m) == 601 for m in names)
    late = np.arange(2000) % 10 >= 7
    want = fitted(spark, LogisticRegression(), x[~late], y[~late], x[late])
    mine = sum(r["n"] for r in got if r["model"] == "logistic" and r["actual"] == r["predicted"])
    assert abs(mine - (want == y[late]).sum()) <= 3
    for m in ("forest", "boosted"):
        assert sum(r["n"] for r in got if r["model"] == m and r["actual"] == r["predicted"]) > 0.5 * 601
