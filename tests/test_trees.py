"""Trees grown over blocks of binned rows, against MLlib's own fits and by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linewise.catalog.queries import QUERIES
from linewise.operators import models, prepare, trees
from linewise.plans import dashboard, study
from linewise.sources import star

SF = "/root/testdata/sf0.001"
ONE_TREE = models.Learner("forest", {"trees": 1, "depth": 5, "bootstrap": False})


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(1500, 3)), 2)
    x[:, 2] = rng.integers(0, 4, 1500)  # few values: all midpoints are candidates
    y = np.round(x @ [2.0, -1.0, 0.5] + rng.normal(0, 0.3, 1500), 3)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, ROW_KEY=[str(i) for i in range(1500)])
    return prepare.assemble(prepare.with_split(spark.createDataFrame(pdf)), ["a", "b", "c"], "y", ["ROW_KEY", "split"]).cache()


def nodes(model):
    return models.tree_nodes(model).orderBy("tree", "node").toPandas()


def fitted(learner, rows):
    return models.fit(learner, trees.seated(rows, "ROW_KEY"))


@pytest.mark.parametrize("learner", [models.GBT.using(trees=3, depth=4), ONE_TREE], ids=lambda learner: learner.kind)
def test_the_same_trees_as_mllib(rows, learner, tmp_path):
    own, theirs = fitted(learner, rows), models.fit(learner, rows)
    assert type(own) is type(theirs) and own.getNumTrees == theirs.getNumTrees
    a, b = nodes(own), nodes(theirs)
    assert len(a) == len(b) > 20 and np.allclose(a.to_numpy(), b.to_numpy(), rtol=1e-7, atol=1e-9, equal_nan=True)
    assert np.allclose(own.featureImportances.toArray(), theirs.featureImportances.toArray(), rtol=1e-9)
    assert rows.sparkSession and own.getMaxDepth() == theirs.getMaxDepth()
    for name, model in (("own", own), ("theirs", theirs)):
        model.save(str(tmp_path / name))
    saved = [rows.sparkSession.read.parquet(str(tmp_path / name / "data")).orderBy("treeID", "nodeData.id").toPandas() for name in ("own", "theirs")]
    for x, y in zip(*(part.nodeData for part in saved)):
        assert np.allclose([x.impurity, *x.impurityStats, x.rawCount], [y.impurity, *y.impurityStats, y.rawCount], rtol=1e-6, atol=1e-6)
    if learner.kind == "boosted":
        assert np.allclose(own.evaluateEachIteration(rows, "squared"), theirs.evaluateEachIteration(rows, "squared"), rtol=1e-9)


def test_forests_bag_rows(rows):
    learner = models.RANDOM_FOREST.using(trees=8, depth=5)
    own, theirs = fitted(learner, rows), models.fit(learner, rows)
    tops = nodes(own).query("node == 0").rows
    assert tops.nunique() > 1 and all(abs(n - 1500) < 5 * math.sqrt(1500) for n in tops)
    errors = [m.transform(rows).agg(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0] for m in (own, theirs)]
    assert math.isclose(*errors, rel_tol=0.1)
    assert np.allclose(own.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=0.02)


def test_drawn_rows_and_features(rows):
    half = nodes(fitted(models.GBT.using(trees=3, depth=2, row_share=0.5), rows)).query("node == 0").rows
    assert half.nunique() > 1 and all(abs(n - 750) < 5 * math.sqrt(375) for n in half)
    allowed = trees.features_of("0.5", 0, 0, np.arange(20), 3, 42)
    assert (allowed.sum(axis=1) == 2).all() and len({tuple(r) for r in allowed}) == 3
    assert trees.features_of("all", 0, 0, np.arange(20), 3, 42) is None
    only = fitted(models.Learner("forest", {"trees": 3, "depth": 1, "column_share": 0.1}), rows)
    assert sorted(nodes(only).query("node == 0").feature.tolist()) != [0, 0, 0]  # one drawn feature a node, not always the best


@pytest.mark.parametrize("learner", [models.GBT.using(trees=2, depth=3, row_share=0.7), models.RANDOM_FOREST.using(trees=3, depth=3)], ids=lambda x: x.kind)
def test_trees_do_not_depend_on_where_rows_lie(rows, learner, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK_ROWS", 200)
    one = nodes(fitted(learner, rows.repartition(1)))
    monkeypatch.setattr(trees, "PART_ROWS", 300)
    monkeypatch.setattr(trees, "TABLE_BYTES", 1)  # a tree at a time
    assert one.equals(nodes(fitted(learner, rows.repartition(7))))


def test_constant_labels_give_one_leaf(rows):
    for learner in (models.GBT.using(trees=2, depth=3), ONE_TREE):
        model = fitted(learner, rows.withColumn("label", F.lit(7.3)))
        assert set(nodes(model).node) == {0}
        assert model.transform(rows).agg(F.max(F.abs(F.col("prediction") - 7.3))).first()[0] < 1e-9


def test_candidates():
    assert trees.candidates(np.array([3.0, 1.0, 2.0, 1.0]), np.array([1, 1, 1, 5]), 64).tolist() == [1.5, 2.5]
    assert trees.candidates(np.array([4.0]), np.array([9]), 64).tolist() == []
    spread = trees.candidates(np.arange(1000.0), np.ones(1000), 10)
    assert len(spread) == 9 and np.allclose(np.diff(spread), 100)


def test_many_rows_are_neither_dealt_nor_held(spark, monkeypatch):
    monkeypatch.setattr(models, "BLOCKS_FROM", 1)
    monkeypatch.setattr(models, "dealt", lambda *_: pytest.fail("rows were dealt"))
    monkeypatch.setattr(models, "held", lambda *_: pytest.fail("rows were held"))
    matrix = study.scaled_matrix(study.study_matrix(star.sales(spark, SF)))
    with models.train_rows(study.vectors(matrix), "ROW_KEY") as train:
        assert train.columns == ["fold", "features", "label", "seat"]
        assert "Exchange" not in train._jdf.queryExecution().executedPlan().toString()
        learners = {"line": models.OLS, "trees": models.GBT.using(trees=2, depth=2), "forest": models.RANDOM_FOREST.using(trees=2, depth=2)}
        made = []
        monkeypatch.setattr(trees, "laid_out", lambda *a, f=trees.laid_out: made.append(a) or f(*a))
        fits = models.fit_all(learners, train)
        assert len(made) == 1 and [type(m).__name__ for m in fits.values()] == ["LinearRegressionModel", "GBTRegressionModel", "RandomForestRegressionModel"]


@pytest.mark.parametrize("name", ["gbt", "random_forest", "boosted_importance", "dashboard_forest"])
def test_queries_grow_trees_over_blocks(spark, name, monkeypatch):
    """Few trees: whether the query takes this way, and ends with what MLlib finds on the same rows."""
    fit = models.fit
    cut = lambda learner: learner.using(**{k: min(v, 3) for k, v in learner.params.items() if k in ("trees", "depth")})
    monkeypatch.setattr(models, "fit", lambda learner, train: fit(cut(learner), train))
    want = QUERIES[name](spark, SF).toPandas()
    monkeypatch.setattr(models, "BLOCKS_FROM", 1)
    grown = []
    monkeypatch.setattr(trees, "fit", lambda estimator, blocks, f=trees.fit: grown.append(estimator) or f(estimator, blocks))
    got = QUERIES[name](spark, SF).toPandas()
    assert len(grown) == 1 and list(got.columns) == list(want.columns) and len(got) == len(want)
    if "r2" in got:
        both = got.merge(want, on=["model", "split"])
        assert (both.n_x == both.n_y).all() and np.allclose(both.r2_x, both.r2_y, atol=0.02)
    else:
        assert got.importance.is_monotonic_decreasing and got.feature[0] == want.feature[0]


def test_grid_search_lays_each_fold_out_once(rows, monkeypatch):
    folded = prepare.with_fold(rows, 2)
    grid = {"trees": [2], "depth": [1, 2], "rate": [0.3]}
    _, want, theirs = models.grid_search(models.BOOSTED, folded.drop("ROW_KEY", "split"), grid, folds=2)
    made = []
    monkeypatch.setattr(trees, "laid_out", lambda *a, f=trees.laid_out: made.append(a) or f(*a))
    _, best, table = models.grid_search(models.BOOSTED, trees.seated(folded, "ROW_KEY"), grid, folds=2)
    assert len(made) == 3 and best == want  # two folds and the refit
    scores = [[r["mean_r2"] for r in t.orderBy("point").collect()] for t in (table, theirs)]
    assert np.allclose(*scores, rtol=1e-9)


def test_dashboard_trains_on_many_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "BLOCKS_FROM", 1)
    monkeypatch.setitem(dashboard.LEARNERS, "Random Forest", models.RANDOM_FOREST.using(trees=2, depth=2))
    lines = dashboard.dashboard_features(star.sales(spark, SF).drop("ORDERDATE").withColumnRenamed("ORDERDATE_TEXT", "ORDERDATE"))
    trained = dashboard.train(lines, kind="Random Forest")
    assert trained.model.getNumTrees == 2 and trained.metrics.first()["r2"] > 0.5


@pytest.mark.parametrize("kind", ["dashboard_forest", "feature_importance"])
def test_dashboard_learners_write_the_lines_twice(spark, kind, monkeypatch):
    """As they are and with their features; columns that are dropped before training are not among them."""
    from linewise import session

    fit, written = models.fit, {}
    monkeypatch.setattr(models, "fit", lambda learner, train: fit(learner.using(trees=1, depth=1), train))
    kept = session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda s, label: (lambda path: written.update({path: label}) or path)(kept(s, label)))
    assert QUERIES[kind](spark, SF).count() > 0
    lines = {label: spark.read.parquet(path).columns for path, label in written.items() if label in ("lines", "features", "dashboard")}
    assert sorted(lines) == ["features", "lines"]
    assert not {"POSTALCODE", "ADDRESSLINE1", "TERRITORY"} & {c for columns in lines.values() for c in columns}
