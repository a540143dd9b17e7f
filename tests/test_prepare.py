"""Exact splits and folds, date formats, split gains, learners laid out once."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewise.operators import evaluate, features, models, prepare
from linewise.session import materialize


def keys(spark, n):
    return spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("ROW_KEY"))


def order(key, first=0):
    return hashlib.md5(key.encode()).hexdigest()[first : first + 8], key


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 99, 1001])
def test_the_test_part_has_exactly_a_fifth(spark, n):
    df = keys(spark, n)
    got = {r["ROW_KEY"]: r["split"] for r in prepare.exact_splitter(df)(df).collect()}
    first = sorted((f"k{i}" for i in range(n)), key=order)[: -(-n // 5)]
    assert {k for k, s in got.items() if s == "test"} == set(first) and len(got) == n


@pytest.mark.parametrize("n, k", [(0, 5), (1, 5), (3, 5), (5, 5), (103, 5), (104, 3)])
def test_folds_differ_by_one_at_most(spark, n, k):
    df = keys(spark, n)
    got = [r["fold"] for r in prepare.exact_folder(df, k)(df).orderBy("ROW_KEY").collect()]
    sizes = np.bincount(got, minlength=k)
    assert sizes.sum() == n and sizes.max() - sizes.min() <= 1
    by_order = [f for _, f in sorted(zip(sorted(f"k{i}" for i in range(n)), got), key=lambda x: order(x[0], 8))]
    assert by_order == sorted(by_order)


def test_rows_of_one_key_stay_together_and_equal_hashes_go_by_key(spark, monkeypatch):
    df = keys(spark, 40).unionAll(keys(spark, 40))
    parts = prepare.exact_splitter(df)(df).groupBy("ROW_KEY").agg(F.count_distinct("split").alias("n"))
    assert parts.where("n > 1").count() == 0
    monkeypatch.setattr(prepare, "_order", lambda key, first: F.lit(7).cast("bigint"))
    df = keys(spark, 10)
    assert sorted(r["ROW_KEY"] for r in prepare.exact_splitter(df)(df).where("split = 'test'").collect()) == ["k0", "k1"]


def test_a_split_fitted_once_is_applied_to_other_rows(spark):
    df = keys(spark, 100)
    split = prepare.exact_splitter(df)
    whole = {r["ROW_KEY"]: r["split"] for r in split(df).collect()}
    assert {r["ROW_KEY"]: r["split"] for r in split(keys(spark, 30)).collect()} == {f"k{i}": whole[f"k{i}"] for i in range(30)}
    odd = spark.createDataFrame([(None,)], "ROW_KEY string")
    assert split(odd).first()["split"] == "test"


def dates(spark, cells):
    return spark.createDataFrame([(c,) for c in cells], "d string")


@pytest.mark.parametrize("cells, found, n_fit", [
    (["1/2/2003", "12/31/2004", "bad", None], "M/d/yyyy", 2),
    (["31/12/2004", "1/2/2003", "30/1/2004"], "d/M/yyyy", 3),
    (["2004-01-31", "31/12/2004", "2004-05-06"], "yyyy-MM-dd", 2),
    (["1/2/2003 0:00", "5/6/2004 13:05"], "M/d/yyyy H:mm", 2),
    (["bad", None], None, 0),
    ([], None, 0),
])
def test_the_format_that_fits_most_cells(spark, cells, found, n_fit):
    said = []
    got = features.discover_format(dates(spark, cells), "d", report=said.append)
    assert (got.format, got.n_fit, got.n_text) == (found, n_fit, sum(c is not None for c in cells))
    # days up to 12 only: both orders fit, and that is said
    assert bool(got.ambiguous) == bool(said) == (cells[:1] == ["1/2/2003 0:00"])


def test_equal_days_are_not_ambiguous(spark):
    assert features.discover_format(dates(spark, ["1/1/2003", "2/2/2004"]), "d").ambiguous == []


def test_only_the_found_format_is_applied(spark):
    df = dates(spark, ["31/12/2004", "30/1/2004", "1/2/2003", "12/31/2004"])
    got = [str(r["d"])[:10] for r in features.parse_discovered(df, "d", strict=False).collect()]
    assert got == ["2004-12-31", "2004-01-30", "2003-02-01", "None"]
    with pytest.raises(Exception, match="not a date"):
        features.parse_discovered(df, "d", strict=True).collect()


@pytest.fixture(scope="module")
def steps(spark):
    df = spark.range(900).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("ROW_KEY"), (F.col("id") % 30).cast("double").alias("a"),
        (F.col("id") % 7).cast("double").alias("b"), F.lit(1.0).alias("c"))
    df = df.withColumn("y", 5 * F.col("a") + F.when(F.col("b") > 3, 20).otherwise(0)).withColumn("split", F.lit("train"))
    return models.dealt(materialize(prepare.assemble(df, ["a", "b", "c"], "y", ["ROW_KEY", "split"]), "steps"), "ROW_KEY")


def test_split_gains_are_falls_of_the_squared_error(spark, steps):
    model = models.fit(models.Learner("boosted", {"trees": 4, "depth": 2, "rate": 0.5}), steps)
    rows = [(r["features"].toArray(), r["label"]) for r in steps.collect()]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    nodes = {}
    for r in models.tree_nodes(model).collect():
        nodes.setdefault(r["tree"], {})[r["node"]] = r
    total, used, so_far = {}, {}, np.zeros(len(y))
    for tree in range(4):
        rest, leaf = y - so_far, np.zeros(len(y))
        inside = {0: np.ones(len(y), bool)}
        for i in sorted(nodes[tree]):  # numbered parents first, left subtree before right
            node = nodes[tree][i]
            assert inside[i].sum() == node["rows"]
            if node["feature"] is None:
                leaf[inside[i]] = node["prediction"]
                continue
            low = x[:, node["feature"]] <= node["threshold"]
            left = i + 1
            inside[left] = inside[i] & low
            right = next(j for j in sorted(nodes[tree]) if j > left and nodes[tree][j]["rows"] == (inside[i] & ~low).sum() and j not in inside)
            inside[right] = inside[i] & ~low
            fall = sum(((rest[m] - rest[m].mean()) ** 2).sum() * s for m, s in ((inside[i], 1), (inside[left], -1), (inside[right], -1)))
            assert np.isclose(fall, node["gain"], rtol=1e-6)
            total[node["feature"]] = total.get(node["feature"], 0) + fall
            used[node["feature"]] = used.get(node["feature"], 0) + 1
        so_far += leaf * (1 if tree == 0 else 0.5)
    got = models.split_gains(model, ["a", "b", "c"]).collect()
    means = {c: total.get(i, 0) / max(used.get(i, 0), 1) for i, c in enumerate("abc")}
    assert [r["feature"] for r in got] == sorted("abc", key=lambda c: -means[c])
    for r in got:
        assert np.isclose(r["mean_gain"], means[r["feature"]]) and np.isclose(r["importance"], means[r["feature"]] / sum(means.values()))
    assert models.split_gains(model, ["a", "b", "c"], 1).count() == 1


def test_all_models_score_in_one_scan(spark, steps):
    fitted = models.fit_all({"line": models.OLS, "trees": models.Learner("forest", {"trees": 3, "depth": 3})}, steps)
    long = evaluate.predictions(fitted, steps)
    for name, model in fitted.items():
        own = model.transform(steps).select("ROW_KEY", "prediction")
        assert long.where(F.col("model") == name).select("ROW_KEY", "prediction").exceptAll(own).isEmpty()
    assert long.count() == 1800 and long.columns == ["model", "split", "ROW_KEY", "label", "prediction"]
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def test_parts_grow_with_the_rows_only():
    assert [models.parts(n) for n in (0, 1, 16_384, 50_000, 10**6)] == [2, 2, 2, 4, 62]
    assert models.parts(10**8) <= 2 * models.MANY_PARTS and models.parts(10**11) >= 10**11 // models.MOST_PART_ROWS


def test_held_rows_are_let_go(spark, steps):
    with models.held(steps) as rows:
        assert rows.count() == 900 and rows.storageLevel.useMemory
    assert not steps.storageLevel.useMemory


def test_trees_get_few_parts_and_large_fits_run_alone():
    assert [models.tree_parts(n) for n in (0, 16_384, 50_000, 10**6, 36 * 10**5, 36 * 10**6)] == [2, 2, 4, 12, 12, 35]
    assert [models.fits_at_a_time(n) for n in (0, 10**6, 36 * 10**5, 36 * 10**6)] == [8, 8, 4, 1]
    assert models.fits_at_a_time(10**6, 3) == 3


def test_train_part_gives_the_trees_of_all_rows_dealt(spark, steps):
    rows = steps.withColumn("split", F.when(F.col("label") < 80, "train").otherwise("test"))
    train = models.train_part(rows.repartition(5), "ROW_KEY")
    assert train.columns == ["features", "label"] and train.rdd.getNumPartitions() == 2
    learner = models.Learner("boosted", {"trees": 3, "depth": 2, "rate": 0.5})
    whole = models.dealt(rows, "ROW_KEY").where("split = 'train'")
    trees = [models.fit(learner, r).toDebugString.split("\n", 1)[1] for r in (train, whole)]
    assert trees[0] == trees[1]
