"""Every registered query with a SQL twin gives the twin's rows."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from linewise.catalog.oracle import oracle_sql  # noqa: E402
from linewise.catalog.queries import QUERIES  # noqa: E402
from linewise.operators import models  # noqa: E402
from tools.compare import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"
TWINS = oracle_sql()
# Iterative learners have no SQL form; tests/test_plans.py checks them against closed forms and floors.
ROWS_ONLY = {
    "ols", "ridge", "random_forest", "gbt", "grid_search_short", "feature_importance", "scenario_model", "learner_comparison",
    "dashboard_boosted", "dashboard_forest", "boosted_importance",
}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


def test_only_learners_lack_a_twin():
    assert set(QUERIES) - set(TWINS) == ROWS_ONLY and not set(TWINS) - set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(TWINS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(spark, con, name):
    status, n, _, note = compare(spark, con, SF, name, QUERIES[name], TWINS[name])
    assert status == "equal" and n > 0, note


@pytest.fixture
def small_learners(monkeypatch):
    """Every learner with three trees at most: whether the query runs through is the question here."""
    fit = models.fit

    def quick(learner, train):
        cut = {k: min(v, 3) for k, v in learner.params.items() if k in ("trees", "depth")}
        return fit(learner.using(**cut), train)

    monkeypatch.setattr(models, "fit", quick)


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_learner_queries_run(spark, name, small_learners):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    if name == "learner_comparison":
        assert [r["best"] for r in rows].count(True) == 1 and len(rows) == 5
    if name == "grid_search_short":
        assert len(rows) == 4 and sorted(r["rank"] for r in rows) == [1, 2, 3, 4]


def test_five_learners_at_full_size(spark):
    """Nothing cut: as many trees, as deep, as registered."""
    rows = {r["model"]: r for r in QUERIES["learner_comparison"](spark, SF).collect()}
    assert len(rows) == 5 and all(r["test_r2"] > 0.99 for r in rows.values())
    best = max(rows.values(), key=lambda r: r["test_r2"])
    assert best["best"] and best["model"] not in ("Linear Regression", "Ridge Regression")
    assert rows["Gradient Boosting"]["rmse"] < rows["Linear Regression"]["rmse"]


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 10
