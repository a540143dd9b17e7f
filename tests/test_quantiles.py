import math

import numpy as np
import pytest

from linewise.functions.quantiles import exact_quantiles

PROBABILITIES = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def samples():
    rng = np.random.default_rng(7)
    return {
        "uniform": rng.uniform(0, 100_000, 3001),
        "heavy_tail": np.exp(rng.normal(0, 40, 2000)) * rng.choice([-1, 1], 2000),
        "hot_value": np.concatenate([np.full(1500, 42.0), rng.normal(42, 1e-9, 1500)]),
        "clumped": 1e6 + rng.uniform(0, 1e-3, 2500),
        "negative": -rng.uniform(1, 2, 999),
        "mixed_zero": np.concatenate([np.zeros(500), -rng.random(300), rng.random(301)]),
        "pair": np.array([1.0, 2.0]),
        "one": np.array([5.0]),
    }


@pytest.mark.parametrize("small_bucket", [1_000_000, 0])
def test_equals_numpy_with_and_without_the_linear_pass(spark, small_bucket):
    data = samples()
    longest = max(len(v) for v in data.values())
    columns = list(data)
    rows = [[float(data[c][i]) if i < len(data[c]) else None for c in columns] for i in range(longest)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)
    got = exact_quantiles(df, columns, PROBABILITIES, small_bucket=small_bucket)
    for c in columns:
        for p in PROBABILITIES:
            assert math.isclose(got[c, p], np.quantile(data[c], p), rel_tol=1e-12, abs_tol=1e-300), (c, p)


def test_missing_values_are_left_out(spark):
    df = spark.createDataFrame([(1.0, None, 3), (float("nan"), None, None), (4.0, None, 9), (None, None, 4)],
                               "a double, b double, c int")
    got = exact_quantiles(df, ["a", "b", "c"], [0.5])
    assert got == {("a", 0.5): 2.5, ("b", 0.5): None, ("c", 0.5): 4.0}


def test_infinities_keep_their_place(spark):
    values = [float("-inf"), -1.0, 0.0, 2.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, ["x"], [0.0, 0.5, 0.75, 1.0], small_bucket=0)
    assert got == {("x", 0.0): values[0], ("x", 0.5): 0.0, ("x", 0.75): 2.0, ("x", 1.0): values[4]}
