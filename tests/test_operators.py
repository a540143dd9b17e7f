import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linewise.functions import semantics
from linewise.operators import clean, features, prepare, profile, summarise


def column(df, name):
    return [r[name] for r in df.collect()]


# --- cleaning and profiles ---


def test_strict_drop_names_the_missing_column(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert clean.drop_strict(df, ["a"]).columns == ["b"]
    assert clean.drop_lenient(df, ["a", "zz"]).columns == ["b"]
    with pytest.raises(ValueError, match="zz"):
        clean.drop_strict(df, ["a", "zz"])


def test_median_fill_like_pandas(spark):
    pdf = pd.DataFrame({"even": [1.0, 2.0, None, 10.0, 4.0], "all_null": [None] * 5, "full": [1, 2, 3, 4, 5],
                        "whole": [1, None, 4, None, 2], "text": ["a", None, "b", "c", "d"]})
    df = spark.createDataFrame(
        [(1.0, None, 1, 1, "a"), (2.0, None, 2, None, None), (float("nan"), None, 3, 4, "b"), (10.0, None, 4, None, "c"),
         (4.0, None, 5, 2, "d")], "even double, all_null double, full int, whole int, text string")
    numeric = pdf[["even", "full", "whole"]].astype(float)
    want = numeric.fillna(numeric.median())
    out = clean.median_fill(df)
    assert dict(out.dtypes) == {"even": "double", "all_null": "double", "full": "int", "whole": "double", "text": "string"}
    for c in ("even", "full", "whole"):
        assert column(out, c) == want[c].tolist()
    assert column(out, "all_null") == [None] * 5 and column(out, "text")[1] is None


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", float("nan")), (2, None, 4.0)], "i int, s string, d double")
    assert profile.row_count(df).first().asDict() == {"n_rows": 3, "n_columns": 3}
    assert {r[0]: r[1] for r in profile.null_counts(df).collect()} == {"i": 0, "s": 1, "d": 2}
    assert profile.null_total(df).first()["n_null"] == 3
    assert {r[0]: r[1] for r in profile.distinct_counts(df).collect()} == {"i": 2, "s": 1, "d": 1}
    assert {r[0]: r[1] for r in profile.distinct_counts(df, approx=True).collect()} == {"i": 2, "s": 1, "d": 1}
    assert {r[0]: (r[1], r[2]) for r in profile.non_null_profile(df).collect()} == {
        "i": ("int", 3), "s": ("string", 2), "d": ("double", 1)}


def test_describe_like_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(5, 2, 501), "b": rng.integers(0, 9, 501)})
    out = {r["column_name"]: r for r in profile.describe_numeric(spark.createDataFrame(pdf)).collect()}
    want = pdf.describe()
    for c in pdf:
        for name, ours in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("25%", "q25"),
                           ("50%", "q50"), ("75%", "q75"), ("max", "max")]:
            assert math.isclose(out[c][ours], want[c][name], rel_tol=1e-12)


def test_null_tokens_and_nan(spark):
    df = spark.createDataFrame([("NA", 1.0), ("", float("nan")), ("Nantes", None)], "s string, d double")
    out = semantics.nan_to_null(semantics.null_tokens(df, ["NA", ""]))
    assert column(out, "s") == [None, None, "Nantes"] and column(out, "d") == [1.0, None, None]


# --- summaries ---


@pytest.mark.parametrize("values", [
    [0.0, 1.0, 2.0, 3.0, 10.0, 10.0], [5.0, 5.0, 5.0], list(np.random.default_rng(1).normal(0, 50, 700)),
    [i / 10 for i in range(51)],
])
@pytest.mark.parametrize("bins", [10, 30, 50])
def test_histogram_like_numpy(spark, values, bins):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    rows = summarise.histogram(df, "v", bins).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=bins)
    assert [r["n"] for r in rows] == counts.tolist()
    assert np.allclose([r["low"] for r in rows] + [rows[-1]["high"]], edges, rtol=1e-12, atol=1e-12)


def test_groups_without_key_are_left_out_and_empty_groups_sum_to_zero(spark):
    df = spark.createDataFrame([("a", 1.5), (None, 9.0), ("b", None), ("a", 2.0)], "k string, v double")
    assert [tuple(r) for r in summarise.total_by(df, ["k"], "v", "t", descending=True).collect()] == [("a", 3.5), ("b", 0.0)]
    assert [tuple(r) for r in summarise.mean_by(df, ["k"], "v", "m").collect()] == [("a", 1.75), ("b", None)]


def test_shares_add_up(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 1.0), (None, 5.0)], "k string, v double")
    assert {r["k"]: r["share"] for r in summarise.share_by(df, "k", "v").collect()} == {"a": 0.5, "b": 0.5}


def test_top_n_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(f"k{i:02d}", 7.0 if i < 15 else 9.0) for i in range(20)], "ROW_KEY string, SALES double")
    got = column(summarise.top_n(df.repartition(6), "SALES", 10, ["ROW_KEY"]), "ROW_KEY")
    assert got == ["k15", "k16", "k17", "k18", "k19", "k00", "k01", "k02", "k03", "k04"]


def test_grid_counts_every_point_once(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.random(400), "y": rng.random(400)})
    out = summarise.grid_counts(spark.createDataFrame(pdf), "x", "y", 8).toPandas()
    want, _, _ = np.histogram2d(pdf.x, pdf.y, bins=8)
    got = np.zeros((8, 8))
    got[out.x_bin, out.y_bin] = out.n
    assert (got == want).all()


def test_options_keep_a_missing_value(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "c string")
    assert column(summarise.options(df, "c"), "c") == [None, "a", "b"]


# --- features ---


def test_zero_divisors_give_null(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 1.0, 0.0), (10.0, 2.0, 4.0, 8.0), (10.0, None, 4.0, None)],
        "SALES double, QUANTITYORDERED double, PRICEEACH double, MSRP double")
    out = features.price_features(df).collect()
    assert [out[0][c] for c in ("PROFIT_MARGIN", "PRICE_DISCOUNT", "REVENUE_PER_UNIT")] == [None] * 3
    assert math.isclose(out[1]["PROFIT_MARGIN"], (10 - 2 * 4 * 0.7) / 10) and out[1]["PRICE_DISCOUNT"] == 0.5
    assert out[1]["REVENUE_PER_UNIT"] == 5.0 and out[2]["REVENUE_PER_UNIT"] is None


def test_missing_status_counts_as_not_shipped(spark):
    df = spark.createDataFrame([("Shipped", 3.0), (None, 3.0), ("On Hold", 3.0)], "STATUS string, MSRP double")
    assert [r[0] for r in df.select(features.shipped_msrp()).collect()] == [3.0, 0.0, 0.0]


def test_dates(spark):
    df = spark.createDataFrame([("2/24/2003 0:00",), ("bad",), (None,), ("1/1/2005 0:00",), ("2004-03-07",)], "d string")
    parsed = features.date_parts(features.parse_dates(df, "d", strict=False), "d", list(features.DATE_PARTS)).collect()
    assert [parsed[0][p] for p in features.DATE_PARTS] == [2003, 1, 2, 0, 24, 9]
    assert parsed[1]["d"] is None and parsed[2]["YEAR"] is None
    assert parsed[3]["WEEK_OF_YEAR"] == 53 and parsed[4]["DAY_OF_WEEK"] == 6
    good = df.where("d <> 'bad' OR d IS NULL")
    assert features.parse_dates(good, "d", strict=True).where("d IS NULL").count() == 1
    with pytest.raises(Exception, match="not a date: bad"):
        features.parse_dates(df, "d", strict=True).collect()


# --- model inputs ---


def test_codes_follow_sorted_labels_over_many_tasks(spark):
    words = [f"w{i:04d}" for i in range(3000)]
    rows = [(w, "B") for w in words] + [(None, "b"), ("é", "nan"), ("Z", None)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(7)
    codes = prepare.fit_codes(df, ["a", "b"])
    got = {c: {r["label"]: r["code"] for r in codes.where(F.col("column_name") == c).collect()} for c in ("a", "b")}
    assert got["a"] == {w: i for i, w in enumerate(sorted([*words, "nan", "é", "Z"]))}
    assert got["b"] == {"B": 0, "b": 1, "nan": 2}
    assert {r[0]: r[1] for r in prepare.class_counts(codes).collect()} == {"a": 3003, "b": 3}


def test_encode_decode_is_identity(spark):
    df = spark.createDataFrame([(str(i), f"c{i % 5}" if i % 7 else None) for i in range(200)], "ROW_KEY string, c string")
    codes = prepare.fit_codes(df, ["c"])
    back = prepare.encode(df, codes, ["c"]).join(codes, F.col("c") == F.col("code")).select("ROW_KEY", "label")
    want = df.select("ROW_KEY", F.coalesce("c", F.lit("nan")))
    assert back.exceptAll(want).isEmpty() and back.count() == 200
    fewer = prepare.fit_codes(df.where("c <> 'c1'"), ["c"])
    assert prepare.encode(df, fewer, ["c"]).where("c IS NULL").count() == df.where("c = 'c1' OR c IS NULL").count()


def test_split_and_folds_ignore_partitioning(spark):
    df = spark.range(20_000).select(F.concat(F.lit("row|"), "id").alias("ROW_KEY"))
    a = prepare.with_fold(prepare.with_split(df))
    b = prepare.with_fold(prepare.with_split(df.repartition(9)))
    assert a.exceptAll(b).isEmpty()
    share = a.where("split = 'train'").count() / 20_000
    assert abs(share - 0.8) < 0.02
    for k in (3, 5, 10):  # within the train part, where they are used
        folds = [r["count"] for r in prepare.with_fold(a, k).where("split = 'train'").groupBy("fold").count().collect()]
        assert len(folds) == k and max(folds) < 1.1 * min(folds)
    ratio = prepare.split_ratio(a).first()
    assert ratio["n_train"] + ratio["n_test"] == 20_000


def test_scaled_train_rows_have_mean_zero_and_population_deviation_one(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"ROW_KEY": [str(i) for i in range(800)], "x": rng.normal(50, 9, 800), "constant": 3})
    df = prepare.with_split(spark.createDataFrame(pdf))
    train = F.col("split") == "train"
    out = prepare.standardise(df, ["x", "constant"], fit_on=df.where(train)).where(train).toPandas()
    assert abs(out.x.mean()) < 1e-12 and abs(out.x.std(ddof=0) - 1) < 1e-12
    assert (out.constant == 0).all()


def test_amounts_with_nan_and_infinity(spark):
    from linewise.functions.semantics import exact_mean, exact_sum

    nan, inf = float("nan"), float("inf")
    for values, total, mean in [([1, nan, 3], 4, 2), ([1, inf, 3], inf, inf), ([inf, -inf], nan, nan), ([nan], 0, None), ([], 0, None)]:
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        row = df.agg(exact_sum("x").alias("s"), exact_mean("x").alias("m")).first()
        assert (row["s"], row["m"]) == (total, mean) or (math.isnan(total) and math.isnan(row["s"]) and math.isnan(row["m"]))


def test_both_zeros_are_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,), (None,)], "x double")
    assert profile.distinct_counts(df).first()["n_distinct"] == 2
