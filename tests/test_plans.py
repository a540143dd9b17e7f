"""The composed analyses against small pandas twins."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from linewise import schema as S
from linewise.operators import evaluate, models
from linewise.operators.lookup import attach
from linewise.plans import dashboard, scenario, study
from linewise.sources.star import sales

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    df = sales(spark, SF)
    df.persist()
    return df


def close(a, b):
    return (a is None and pd.isna(b)) or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_study_features_like_pandas(lines):
    p = lines.toPandas().drop(columns=S.UNUSED_ADDRESS_COLUMNS).rename(columns=S.ADDRESS_RENAME)
    p = p.dropna(subset=["POSTALCODE"]).copy()
    p["MSRP"] = p.MSRP.fillna(p.MSRP.median())
    dates = pd.to_datetime(p.ORDERDATE)
    p["WEEK_OF_YEAR"], p["DAY_OF_WEEK"] = dates.dt.isocalendar().week.astype(int), dates.dt.dayofweek
    p["PRICE_DISCOUNT"] = 1 - p.PRICEEACH / p.MSRP
    per = p.groupby("CUSTOMERNAME").agg(
        CUSTOMER_ORDER_COUNT=("ORDERNUMBER", "count"), CUSTOMER_TOTAL_SALES=("SALES", "sum"),
        CUSTOMER_AVG_SALES=("SALES", "mean"), CUSTOMER_TOTAL_QTY=("QUANTITYORDERED", "sum")).reset_index()
    p = p.merge(per, on="CUSTOMERNAME", how="left").set_index("ROW_KEY")
    got = study.study_features(lines).toPandas().set_index("ROW_KEY").loc[p.index]
    assert len(got) == len(p) and got.index.is_unique
    for c in ["MSRP", "WEEK_OF_YEAR", "DAY_OF_WEEK", "PRICE_DISCOUNT", *per.columns[1:]]:
        a, b = got[c].astype(float), p[c].astype(float)
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True), c


def test_study_matrix_is_complete_and_numeric(lines):
    matrix = study.study_matrix(lines)
    assert matrix.columns == [*S.CATEGORICAL_FEATURES, *S.NUMERIC_FEATURES]
    row = matrix.rows.agg(*[F.count(c).alias(c) for c in matrix.columns], F.count("*").alias("n")).first()
    assert all(row[c] == row["n"] for c in matrix.columns)
    assert not [f.name for f in matrix.rows.select(*matrix.columns).schema if f.dataType.simpleString() == "string"]


def test_leak_free_matrix_does_not_know_the_test_part(lines):
    """Changing the target of test lines changes no feature of any line."""
    is_test = F.col("split") == "test"
    changed = study.prepare.with_split(lines).withColumn("SALES", F.when(is_test, 1.0).otherwise(F.col("SALES")))
    a = study.study_matrix(lines, leak_free=True)
    b = study.study_matrix(changed.drop("split"), leak_free=True)
    assert not set(S.TARGET_DERIVED_FEATURES) & set(a.columns)
    left, right = (m.rows.select(S.ROW_KEY, *m.columns) for m in (a, b))
    assert left.exceptAll(right).isEmpty() and left.count() == right.count()


def test_dashboard_guards(spark):
    df = spark.createDataFrame([("r1", 2.0, 3.0), ("r2", None, 5.0)], "ROW_KEY string, QUANTITYORDERED double, PRICEEACH double")
    assert dashboard.guarded_features(df).columns == [*df.columns, "THEORETICAL_REV"]
    assert dashboard.guarded_features(df.drop("PRICEEACH")).columns == ["ROW_KEY", "QUANTITYORDERED"]
    filled = dashboard.dashboard_features(df).orderBy("ROW_KEY").collect()
    assert [tuple(r) for r in filled] == [("r1", 2.0, 3.0, 6.0), ("r2", 2.0, 5.0, 6.0)]


def test_dashboard_training(lines):
    df = dashboard.dashboard_features(lines.drop("ORDERDATE").withColumnRenamed("ORDERDATE_TEXT", "ORDERDATE"))
    small = models.GBT_DASHBOARD.using(trees=5)
    previous, dashboard.FALLBACK = dashboard.FALLBACK, small
    try:
        trained = dashboard.train(df, kind="anything else")
    finally:
        dashboard.FALLBACK = previous
    assert trained.model.getNumTrees == 5 and trained.model.getOrDefault("maxDepth") == 3
    assert "ORDERNUMBER" not in trained.columns and "SALES" not in trained.columns and "STATUS" in trained.columns
    row = trained.metrics.first()
    assert row["split"] == "test" and row["r2"] > 0.5
    ranked = models.importances(trained.model, trained.columns, 10).collect()
    assert len(ranked) == 10 and ranked[0]["importance"] >= ranked[9]["importance"]
    assert math.isclose(sum(trained.model.featureImportances.toArray()), 1.0, rel_tol=1e-9)


# --- learners against closed forms ---


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 3))
    y = 4 + x @ np.array([2.0, -1.0, 0.5]) + rng.normal(0, 0.3, 500)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, ROW_KEY=[str(i) for i in range(500)])
    df = spark.createDataFrame(pdf)
    return x, y, study.prepare.assemble(study.prepare.with_split(df), ["a", "b", "c"], "y", ["ROW_KEY", "split"])


def test_ols_and_ridge_closed_forms(linear, tmp_path):
    x, y, vectors = linear
    xc, yc = x - x.mean(0), y - y.mean()
    for learner, alpha in [(models.OLS, 0.0), (models.RIDGE, 1.0), (models.RIDGE.using(alpha=50.0), 50.0)]:
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        model = models.fit(learner, vectors)
        assert np.allclose(model.coefficients.toArray(), want, rtol=1e-9)
        assert math.isclose(model.intercept, y.mean() - x.mean(0) @ want, rel_tol=1e-9)
    model.save(str(tmp_path / "model"))
    again = LinearRegressionModel.load(str(tmp_path / "model"))
    assert again.coefficients == model.coefficients


def test_metrics_by_hand(linear):
    x, y, vectors = linear
    long = evaluate.predictions({"linear": models.fit(models.OLS, vectors)}, vectors)
    p = long.toPandas()
    for row in evaluate.metrics(long).collect():
        part = p[p.split == row["split"]]
        miss = part.label - part.prediction
        assert math.isclose(row["r2"], 1 - (miss**2).sum() / ((part.label - part.label.mean()) ** 2).sum(), rel_tol=1e-9)
        assert math.isclose(row["rmse"], math.sqrt((miss**2).mean()), rel_tol=1e-9)
        assert math.isclose(row["mae"], miss.abs().mean(), rel_tol=1e-9) and row["n"] == len(part)


def test_constant_label(spark):
    rows = [("exact", "test", "1", 5.0, 5.0), ("exact", "test", "2", 5.0, 5.0), ("off", "test", "1", 5.0, 4.0), ("off", "test", "2", 5.0, 5.0)]
    long = spark.createDataFrame(rows, "model string, split string, ROW_KEY string, label double, prediction double")
    assert {r["model"]: r["r2"] for r in evaluate.metrics(long).collect()} == {"exact": 1.0, "off": 0.0}


def test_rows_without_prediction_count_on_neither_side(spark):
    rows = [(1.0, 1.5), (2.0, 1.5), (3.0, 3.5), (50.0, None)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    assert math.isclose(df.agg(evaluate.r_squared().alias("r2")).first()["r2"], 1 - 0.75 / 2)


def test_trees_beat_the_mean_and_repeat(linear):
    _, _, vectors = linear
    train, test = vectors.where("split = 'train'"), vectors.where("split = 'test'")
    for learner in (models.RANDOM_FOREST.using(trees=10, depth=5), models.GBT.using(trees=10, depth=3)):
        scored = [evaluate.predictions({"m": models.fit(learner, train)}, test) for _ in range(2)]
        assert evaluate.metrics(scored[0]).first()["r2"] > 0.5
        assert scored[0].exceptAll(scored[1]).isEmpty()
    with pytest.raises(ValueError):
        models.fit(models.Learner("unknown", {"depth": 1}), train)


def test_grid_search_scores_every_point(linear):
    _, _, vectors = linear
    folded = study.prepare.with_fold(vectors, 2)
    model, best, table = models.grid_search(
        models.BOOSTED, folded, {"trees": [2, 8], "depth": [2], "rate": [0.3]}, folds=2, parallelism=2)
    rows = table.orderBy("rank").collect()
    assert len(rows) == 2 and rows[0]["mean_r2"] >= rows[1]["mean_r2"]
    assert best.params["trees"] == model.getNumTrees == 8
    assert len(models.grid_points(models.TUNING_GRID)) == 8 and len(models.grid_points(models.WIDE_GRID)) == 243


def test_prefixes_of_the_longest_equal_separate_fits(linear):
    _, _, vectors = linear
    folded = study.prepare.with_fold(vectors, 10).cache()
    grid = {"trees": [2, 5], "depth": [1, 2], "rate": [0.3]}
    _, _, table = models.grid_search(models.BOOSTED, folded, grid, folds=2, parallelism=2)
    got = {r["settings"]: r["mean_r2"] for r in table.collect()}
    for point in models.grid_points(grid):
        scores = []
        for fold in (0, 1):
            model = models.fit(models.BOOSTED.using(**point), folded.where(F.col("fold") != fold))
            rows = model.transform(folded.where(F.col("fold") == fold))
            scores.append(rows.agg(evaluate.r_squared().alias("r2")).first()["r2"])
        assert math.isclose(got[str(point)], sum(scores) / 2, rel_tol=1e-9)
    _, _, ten = models.grid_search(models.BOOSTED, folded, {"trees": [1], "depth": [1], "rate": [0.3]}, folds=10, parallelism=4)
    assert ten.first()["mean_r2"] is not None


def test_trees_do_not_depend_on_the_input_s_partitions(linear):
    _, _, vectors = linear
    train = vectors.where("split = 'train'")
    trees = [models.fit(models.GBT.using(trees=3, depth=3), models.dealt(train.repartition(n), "ROW_KEY")).toDebugString.split("\n", 1)[1] for n in (1, 5)]
    assert trees[0] == trees[1]


def test_comparison_and_best(spark):
    rows = [("b", "train", 0.9, 1.0, 1.0), ("b", "test", 0.80004, 2.0, 1.5), ("a", "train", 0.7, 3.0, 1.0), ("a", "test", 0.80001, 4.0, 2.0)]
    measured = spark.createDataFrame(rows, "model string, split string, r2 double, rmse double, mae double")
    table = evaluate.compare(measured)
    assert {tuple(r) for r in table.collect()} == {("b", 0.9, 0.80004, 2.0, 1.5), ("a", 0.7, 0.80001, 4.0, 2.0)}
    assert {tuple(r) for r in evaluate.shown(table).collect()} == {("b", 0.9, 0.8, 2.0, 1.5), ("a", 0.7, 0.8, 4.0, 2.0)}
    assert evaluate.best_model(table, ["a", "b"]).first()["model"] == "b"  # the fifth place decides
    tied = evaluate.shown(table)
    assert [evaluate.best_model(tied, order).first()["model"] for order in (["a", "b"], ["b", "a"])] == ["a", "b"]
    shown = spark.createDataFrame([("x", "test", 0.81), ("y", "test", 0.999)], "model string, split string, r2 double")
    assert {r[0]: round(r[1], 6) for r in evaluate.accuracy_pct(shown).collect()} == {"x": 81.5, "y": 100.0}


def test_cross_validation_without_scanning_folds(spark, lines):
    """Against the plain way: fit on four folds, score the fifth."""
    df = study.prepare.with_fold(study.prepare.with_split(study.filled(lines))).where("split = 'train'")
    got = {r["model"]: r["mean_r2"] for r in evaluate.cross_validate_baselines(df, 5).collect()}
    scores = {}
    for fold in range(5):
        fitted = evaluate.fit_baselines(df.where(F.col("fold") != fold))
        for r in evaluate.metrics(evaluate.baseline_predictions(fitted, df.where(F.col("fold") == fold))).collect():
            scores.setdefault(r["model"], []).append(r["r2"])
    assert set(got) == set(scores)
    for model, values in scores.items():
        assert math.isclose(got[model], sum(values) / 5, rel_tol=1e-9, abs_tol=1e-12)


# --- scenarios ---


def test_scenarios(spark, lines):
    rows = [(9, 50.0, 50.0), (10, 10.0, 10.0), (200, 500.0, 500.0), (201, 50.0, 50.0), (50, 501.0, 50.0), (50, 50.0, 9.0)]
    table = spark.createDataFrame(
        [(float(q), p, m, "STANDARD", "Small") for q, p, m in rows],
        "QUANTITYORDERED double, PRICEEACH double, MSRP double, PRODUCTLINE string, DEALSIZE string")
    assert sorted(r["ESTIMATE"] for r in scenario.estimate(table).collect()) == [100.0, 100_000.0]
    what_if = scenario.fit_what_if(lines.na.drop(subset=["MSRP"]), models.OLS)
    scored = scenario.score(table.union(table.withColumn("PRODUCTLINE", F.lit("never seen"))), what_if)
    assert scored.columns == [*table.columns, "ESTIMATE"] and scored.count() == 2
    assert set(r["DEALSIZE"] for r in scored.collect()) == {"Small"}


def test_grid_offers_pairs_that_never_occur_together(spark):
    df = spark.createDataFrame([("A", "Small"), ("B", "Large"), (None, "Small")], "PRODUCTLINE string, DEALSIZE string")
    grid = scenario.scenario_grid(df, [10], [20], [30])
    assert {(r["PRODUCTLINE"], r["DEALSIZE"]) for r in grid.collect()} == {(a, b) for a in "AB" for b in ("Small", "Large")}


def test_saved_models_score_raw_rows(spark, lines, tmp_path):
    what_if = scenario.fit_what_if(lines.na.drop(subset=["MSRP"]), models.GBT.using(trees=2, depth=2))
    what_if.save(str(tmp_path / "what-if"))
    grid = scenario.scenario_grid(lines, [10, 50], [100], [110])
    before = scenario.score(grid, what_if)
    after = scenario.score(grid, scenario.WhatIf.load(spark, str(tmp_path / "what-if")))
    assert before.count() > 0 and before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()
    rows = dashboard.drop_untrainable(dashboard.dashboard_features(lines))
    for kind in ("Random Forest", "Gradient Boosting"):
        try:
            dashboard.LEARNERS["Random Forest"], kept = models.RANDOM_FOREST.using(trees=2, depth=2), dashboard.LEARNERS["Random Forest"]
            trained = dashboard.train(rows.limit(2000), kind=kind)
        finally:
            dashboard.LEARNERS["Random Forest"] = kept
        trained.save(str(tmp_path / kind))
        raw = rows.limit(100).drop("SALES") if "SALES" not in trained.columns else rows.limit(100)
        one, two = trained.score(raw), dashboard.Trained.load(spark, str(tmp_path / kind)).score(raw)
        assert one.count() > 0 and one.exceptAll(two).isEmpty() and {*raw.columns, "prediction"} == set(one.columns)
        break  # boosting a hundred trees is run by the registered query


def test_vectors_move_no_rows(lines):
    """Sums over rows, such as a line's, need no exchange of them; only trees get dealt rows."""
    vectors = study.vectors(study.scaled_matrix(study.study_matrix(lines)))
    assert "Exchange hashpartitioning" not in vectors._jdf.queryExecution().executedPlan().toString()
    assert models.in_one_pass(models.OLS) and models.in_one_pass(models.RIDGE) and not models.in_one_pass(models.GBT)


def test_a_line_is_fitted_to_rows_where_they_are(lines, monkeypatch):
    monkeypatch.setattr(scenario, "dealt", lambda *_: pytest.fail("rows were dealt"))
    what_if = scenario.fit_what_if(lines.na.drop(subset=["MSRP"]), models.OLS)
    assert len(what_if.model.coefficients) == 5


def test_rounds_write_their_own_columns_only(spark, monkeypatch):
    from linewise.catalog import queries

    asked, filled = [], study.filled
    monkeypatch.setattr(study, "filled", lambda df, columns=None, **rest: asked.append(columns) or filled(df, columns=columns, **rest))
    rows = queries.boosted_rounds(spark, SF)
    assert asked == [["ROW_KEY", "QUANTITYORDERED", "SALES"]] and rows.count() > 0


def test_guarded_load_joins_the_star_once(spark, monkeypatch):
    from linewise.catalog import queries

    calls = []
    monkeypatch.setattr(queries.star, "sales", lambda *args: calls.append(args) or sales(*args))
    assert queries.guarded_load(spark, SF).count() == 4 and len(calls) == 1


def test_written_lines_are_packed_tightly(lines):
    files = study.filled(lines, columns=["ROW_KEY", "SALES", "POSTALCODE"]).inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_lines_are_exchanged_before_anything_is_derived(spark, lines, monkeypatch):
    """With customers too many to broadcast: the same columns in the same order, none of the derived ones in the exchange."""
    import linewise.operators.lookup as lookup

    want = study.study_features(lines)
    monkeypatch.setattr(lookup.attach, "__defaults__", (0, None))
    got = study.study_features(lines)
    assert got.columns == want.columns and got.columns[-2:] == ["QTY_PRICE_INTERACTION", "STATUS_MSRP_RATIO"]
    assert got.columns.index("WEEK_OF_YEAR") < got.columns.index("CUSTOMER_ORDER_COUNT")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("PROFIT_MARGIN") < plan.index("Join") and "PROFIT_MARGIN" not in plan[plan.index("Join"):]


# --- whole runs ---


def test_whole_study_from_csv(spark, lines, tmp_path):
    """Raw CSV to compared learners, with few and small trees."""
    from linewise.sources.orders_csv import read_orders_csv

    path = str(tmp_path / "lines")
    lines.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    loaded = read_orders_csv(spark, path)
    learners = {"Linear Regression": models.OLS, "Random Forest": models.RANDOM_FOREST.using(trees=3, depth=3)}
    grid = {"trees": [2, 4], "depth": [2], "rate": [0.3]}
    result = study.compare_learners(study.study_matrix(loaded), learners, grid, folds=2, parallelism=2)
    table = {r["model"]: r for r in result.table.collect()}
    assert set(table) == {*learners, study.TUNED}
    assert result.best.first()["model"] == max(table, key=lambda m: table[m]["test_r2"]) == "Linear Regression"
    assert result.importances.count() == 15 and result.search.count() == 2
    assert result.predictions.count() == 3 * 5812


def test_reports_hold_what_the_columns_allow(spark, lines):
    frames = study.explore(lines)
    assert len(frames) == 14 and all(f.count() > 0 for f in frames.values())
    full = dashboard.report(lines)
    assert len(full) == 7 and full["qty_sales_grid"].columns == ["x_bin", "y_bin", "STATUS", "n"]
    few = dashboard.report(lines.select("QUANTITYORDERED", "SALES"))
    assert set(few) == {"kpis", "qty_sales_grid"} and few["kpis"].first()["unique_customers"] is None
