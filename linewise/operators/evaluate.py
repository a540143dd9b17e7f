"""Predictions in long form (model, split, key, label, prediction) and everything reported from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.functions.semantics import AMOUNT, exact_mean, safe_div
from linewise.operators.features import quantity_times_price
from linewise.operators.lookup import attach
from linewise.operators.summarise import histogram, value_range
from linewise.schema import ROW_KEY, TARGET

# Fixed value: points added when R² is shown as a percentage.
ACCURACY_OFFSET = 0.5


def predictions(models: dict[str, Model], rows: DataFrame, key: str = ROW_KEY) -> DataFrame:
    """Long predictions of several models over the same rows of (key, split, features, label).

    Each model adds a column to the rows, which are scanned once; the columns are put below each other at the end."""
    scored, columns = rows.select("split", key, "label", "features"), {}
    for i, (name, model) in enumerate(models.items()):
        columns[name] = f"_prediction_{i}"
        scored = model.copy({model.predictionCol: columns[name]}).transform(scored)
    below = F.inline(F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).alias("prediction")) for name, c in columns.items()]))
    return scored.select("split", key, "label", below).select("model", "split", key, "label", "prediction")


def r_squared(prediction: str = "prediction") -> Column:
    """R² over (label, prediction); a constant label scores 1 when met exactly, else 0."""
    miss = F.col("label") - F.col(prediction)
    error = F.sum(miss * miss)
    # a row counts on both sides or on neither
    label = F.when(F.col(prediction).isNotNull(), F.col("label"))
    spread = F.var_pop(label) * F.count(label)
    constant = F.when(error == 0, 1.0).otherwise(0.0)
    return F.when(spread == 0, constant).otherwise(1 - safe_div(error, spread))


def metrics(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """R², root mean squared error and mean absolute error, all models and splits in one aggregation."""
    miss = F.col("label") - F.col("prediction")
    return long.groupBy(*(by or ["model", "split"])).agg(
        r_squared().alias("r2"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.avg(F.abs(miss)).alias("mae"),
        F.count("*").alias("n"),
    )


def accuracy_pct(measured: DataFrame) -> DataFrame:
    shown = F.least(F.lit(100.0), F.col("r2") * 100 + ACCURACY_OFFSET)
    return measured.where(F.col("split") == "test").select("model", shown.alias("accuracy_pct"))


SCORES = ["train_r2", "test_r2", "rmse", "mae"]


def compare(measured: DataFrame) -> DataFrame:
    """One row per model: train and test R², test errors, not rounded."""

    def of(split: str, name: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(name)))

    return measured.groupBy("model").agg(
        of("train", "r2").alias("train_r2"),
        of("test", "r2").alias("test_r2"),
        of("test", "rmse").alias("rmse"),
        of("test", "mae").alias("mae"),
    )


def shown(table: DataFrame, digits: int = 4) -> DataFrame:
    """A comparison as it is printed; rank before rounding."""
    return table.withColumns({c: F.round(c, digits) for c in SCORES if c in table.columns})


def best_model(table: DataFrame, order: list[str]) -> DataFrame:
    """The row with the highest test R² as measured; of equal ones the first in `order`, the order of the models."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return table.orderBy(F.desc_nulls_last("test_r2"), place, "model").limit(1)


def model_bars(table: DataFrame) -> DataFrame:
    return table.select("model", "test_r2", "rmse")


def residuals(long: DataFrame, key: str = ROW_KEY) -> DataFrame:
    test = long.where(F.col("split") == "test")
    return test.select("model", key, "prediction", (F.col("label") - F.col("prediction")).alias("residual"))


def residual_histogram(long: DataFrame, model: str, bins: int = 30, key: str = ROW_KEY) -> DataFrame:
    return histogram(residuals(long.where(F.col("model") == model), key), "residual", bins)


def actual_range(long: DataFrame) -> DataFrame:
    """Ends of the diagonal in the actual / predicted chart."""
    return value_range(long, "label", ["split"])


@dataclass(frozen=True)
class Baselines:
    """Simple predictors: quantity x price, train means, and a line through quantity."""

    mean: float
    slope: float
    intercept: float
    by_product: DataFrame
    by_customer: DataFrame


def _group_means(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(exact_mean(TARGET).alias(name), F.count("*").alias(f"{name}_n"))


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Ordinary least squares with one feature, as one row."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def fit_baselines(train: DataFrame) -> Baselines:
    x = "QUANTITYORDERED"
    line = train.agg(
        exact_mean(TARGET).alias("mean"), F.regr_slope(TARGET, x).alias("slope"), F.regr_intercept(TARGET, x).alias("intercept")
    ).first()
    return Baselines(
        line["mean"], line["slope"], line["intercept"],
        _group_means(train, "PRODUCTLINE", "_product"), _group_means(train, "CUSTOMERNAME", "_customer"),
    )


def _long(df: DataFrame, models: dict[str, Column], keep: list[str]) -> DataFrame:
    """All models' predictions of a row from one pass."""
    pairs = [F.struct(F.lit(m).alias("model"), p.cast("double").alias("prediction")) for m, p in models.items()]
    return df.select(*keep, F.col(TARGET).alias("label"), F.inline(F.array(*pairs)))


BASELINES = ["quantity_x_price", "train_mean", "product_mean", "customer_mean", "quantity_line"]


def _baseline_columns(fitted: Baselines, df: DataFrame, asked: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """The asked baselines' predictions as columns; a lookup is joined only for a baseline that needs it."""
    if "product_mean" in asked:
        df = attach(df, fitted.by_product, ["PRODUCTLINE"], rows="_product_n")
    if "customer_mean" in asked:
        df = attach(df, fitted.by_customer, ["CUSTOMERNAME"], rows="_customer_n")
    made = {
        "quantity_x_price": lambda: quantity_times_price(),
        "train_mean": lambda: F.lit(fitted.mean),
        "product_mean": lambda: F.coalesce("_product", F.lit(fitted.mean)),
        "customer_mean": lambda: F.coalesce("_customer", F.lit(fitted.mean)),
        "quantity_line": lambda: F.col("QUANTITYORDERED") * fitted.slope + fitted.intercept,
    }
    return df, {m: made[m]() for m in asked}


def baseline_predictions(fitted: Baselines, df: DataFrame, asked: list[str] | None = None) -> DataFrame:
    """Long predictions of the asked baselines (default: all) over rows with `split`; customers unknown to the train part
    get the overall mean."""
    known, models = _baseline_columns(fitted, df, asked or BASELINES)
    return _long(known, models, ["split", ROW_KEY]).select("model", "split", ROW_KEY, "label", "prediction")


def baseline_metrics(fitted: Baselines, df: DataFrame) -> DataFrame:
    """`metrics` of all baselines: one wide aggregate row per split, turned into a row per model afterwards."""
    known, models = _baseline_columns(fitted, df, BASELINES)
    wide = known.select("split", F.col(TARGET).alias("label"), *[p.cast("double").alias(m) for m, p in models.items()])

    def measured(m: str) -> Column:
        miss = F.col("label") - F.col(m)
        return F.struct(
            F.lit(m).alias("model"), r_squared(m).alias("r2"), F.sqrt(F.avg(miss * miss)).alias("rmse"),
            F.avg(F.abs(miss)).alias("mae"), F.count("*").alias("n"))

    rows = wide.groupBy("split").agg(*[measured(m).alias(m) for m in models])
    return rows.select("split", F.inline(F.array(*models))).select("model", "split", "r2", "rmse", "mae", "n")


def _other_folds(df: DataFrame, key: str | None, name: str, folds: int) -> DataFrame:
    """(key, fold) -> mean target over the key's rows in all other folds, from one grouping by key and fold.

    After that grouping a key has at most `folds` rows; they are combined into the sums over the other folds.
    """
    keys = [] if key is None else [key]
    rows = df if key is None else df.where(F.col(key).isNotNull())
    sums = rows.groupBy(*keys, "fold").agg(
        F.sum(F.col(TARGET).cast(AMOUNT)).alias("total"), F.count(TARGET).alias("n"), F.count("*").alias("here")
    )
    per_fold = [
        F.struct(
            F.lit(f).alias("fold"),
            F.sum(F.when(F.col("fold") != f, F.col("total"))).alias("total"),
            F.coalesce(F.sum(F.when(F.col("fold") != f, F.col("n"))), F.lit(0)).alias("n"),
            F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("here"))), F.lit(0)).alias("here"),
        )
        for f in range(folds)
    ]
    wide = sums.groupBy(*keys).agg(*[p.alias(f"f{i}") for i, p in enumerate(per_fold)])
    long = wide.select(*keys, F.inline(F.array(*[F.col(f"f{i}") for i in range(folds)])))
    mean = safe_div(F.col("total").cast("double"), F.col("n").cast("double"))
    return long.select(*keys, "fold", mean.alias(name), F.col("here").alias(f"{name}_n"))


def cross_validate_baselines(df: DataFrame, folds: int) -> DataFrame:
    """Mean R² over folds, each predicted from the other folds; no fold is scanned on its own."""
    overall = _other_folds(df, None, "_mean", folds).drop("_mean_n")
    line = [
        F.struct(
            F.lit(f).alias("fold"),
            F.regr_slope(F.when(F.col("fold") != f, F.col(TARGET)), F.col("QUANTITYORDERED")).alias("_slope"),
            F.regr_intercept(F.when(F.col("fold") != f, F.col(TARGET)), F.col("QUANTITYORDERED")).alias("_intercept"),
        )
        for f in range(folds)
    ]
    lines = df.agg(*[p.alias(f"f{i}") for i, p in enumerate(line)]).select(
        F.inline(F.array(*[F.col(f"f{i}") for i in range(folds)]))
    )
    # one row per fold
    known = df.join(F.broadcast(overall), "fold", "left").join(F.broadcast(lines), "fold", "left")
    known = attach(known, _other_folds(df, "PRODUCTLINE", "_product", folds), ["PRODUCTLINE", "fold"], rows="_product_n")
    known = attach(known, _other_folds(df, "CUSTOMERNAME", "_customer", folds), ["CUSTOMERNAME", "fold"], rows="_customer_n")
    models = {
        "quantity_x_price": quantity_times_price(),
        "train_mean": F.col("_mean"),
        "product_mean": F.coalesce("_product", "_mean"),
        "customer_mean": F.coalesce("_customer", "_mean"),
        "quantity_line": F.col("QUANTITYORDERED") * F.col("_slope") + F.col("_intercept"),
    }
    by_fold = metrics(_long(known, models, ["fold"]), ["model", "fold"])
    return by_fold.groupBy("model").agg(F.avg("r2").alias("mean_r2"), F.count("*").alias("folds"))
