"""Registered queries: name -> function of (session, folder of tables). Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise import schema as S
from linewise.operators import clean, evaluate, features, models, prepare, profile, summarise
from linewise.operators.lookup import attach
from linewise.plans import dashboard, scenario, study
from linewise.session import TIGHT, materialize, scratch_folder, scratch_path
from linewise.sources import inference, orders_csv, star, synthetic
from linewise.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def over(name: str, build: Callable[[DataFrame], DataFrame], source: Callable[..., DataFrame] = star.sales) -> None:
    """Register `build` over a source table."""
    QUERIES[name] = lambda spark, sf_dir: build(source(spark, sf_dir))


# --- shared inputs ---------------------------------------------------------------------------------------------

VALUES = [S.ROW_KEY, "QUANTITYORDERED", "PRICEEACH", "SALES", "MSRP"]
BASELINE_COLUMNS = [*VALUES, "PRODUCTLINE", "CUSTOMERNAME"]


def dashboard_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the dashboard gets them: the order date is text, some of it not a date."""
    lines = star.sales(spark, sf_dir)
    return lines.drop("ORDERDATE").withColumnRenamed("ORDERDATE_TEXT", "ORDERDATE")


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, filled lines with their split."""
    return prepare.with_split(study.filled(star.sales(spark, sf_dir), columns=BASELINE_COLUMNS))


def baseline_rows(spark: SparkSession, sf_dir: str, asked: list[str] | None = None) -> DataFrame:
    lines = split_lines(spark, sf_dir)
    return evaluate.baseline_predictions(evaluate.fit_baselines(lines.where(F.col("split") == "train")), lines, asked)


def baseline_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = split_lines(spark, sf_dir)
    return evaluate.baseline_metrics(evaluate.fit_baselines(lines.where(F.col("split") == "train")), lines)


def settled(column: str):
    """The fitted line's values rounded, since its sums depend on task order; all others are exact."""
    return F.when(F.col("model") == "quantity_line", F.round(column, 4)).otherwise(F.col(column)).alias(column)


def study_rows(spark: SparkSession, sf_dir: str) -> study.Matrix:
    return study.scaled_matrix(study.study_matrix(star.sales(spark, sf_dir)))


def learner_metrics(learners: dict[str, models.Learner]) -> Query:
    """Metrics by split of learners on the study's matrix."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = study.vectors(study_rows(spark, sf_dir))
        if all(models.in_one_pass(learner) for learner in learners.values()):
            fitted = models.fit_all(learners, rows.where(F.col("split") == "train"))
        else:
            with models.train_rows(rows, S.ROW_KEY) as train:
                fitted = models.fit_all(learners, train)
        return materialize(evaluate.metrics(evaluate.predictions(fitted, rows)), "metrics")

    return query


# --- sources and sinks -----------------------------------------------------------------------------------------


@register
def header_normalise(spark, sf_dir):
    lines = star.sales(spark, sf_dir).select("ORDERNUMBER", "CUSTOMERNAME", "SALES", S.ROW_KEY)
    untidy = lines.toDF(" Ordernumber ", "customername", "SALES ", " row_key")
    return orders_csv.normalise_header(untidy)


@register
def synthetic_source(spark, sf_dir):
    """Made-up values for the key of every order."""
    orders = spark.read.schema(star.STAR_SCHEMAS["orders"]).parquet(f"{sf_dir}/orders.parquet")
    return synthetic.synthetic_from(orders.select("o_orderkey"), "o_orderkey", synthetic.DEFAULT_ROWS)


CSV_COLUMNS = [S.ROW_KEY, "ORDERNUMBER", "CUSTOMERNAME", "POSTALCODE", "QUANTITYORDERED", "SALES", "MSRP", "STATUS"]


def _as_csv(lines: DataFrame, columns) -> str:
    path = scratch_path(lines.sparkSession, "csv")
    lines.select(*columns).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return path


def _written_csv(spark: SparkSession, sf_dir: str, columns) -> str:
    return _as_csv(star.sales(spark, sf_dir), columns)


@register
def csv_roundtrip(spark, sf_dir):
    return orders_csv.read_orders_csv(spark, _written_csv(spark, sf_dir, CSV_COLUMNS))


@register
def csv_rejects(spark, sf_dir):
    """Lines whose list price is text that is no number, found while loading."""
    broken = F.when(F.col("ORDERNUMBER") % 100 == 0, F.lit("unknown")).otherwise(F.col("MSRP").cast("string")).alias("MSRP")
    path = _written_csv(spark, sf_dir, [S.ROW_KEY, "ORDERNUMBER", "SALES", broken])
    _, rejected = orders_csv.split_rejects(orders_csv.read_orders_csv(spark, path, mode="keep"))
    return rejected.select(S.ROW_KEY, "ORDERNUMBER", "SALES", F.array_join(orders_csv.REJECT_REASON, ",").alias("bad_columns"))


@register
def csv_malformed(spark, sf_dir):
    """Records with a cell too many or too few, found while loading, with their raw text."""
    cells = F.concat_ws(",", S.ROW_KEY, "ORDERNUMBER", F.col("QUANTITYORDERED").cast("int"))
    line = F.when(F.col("ORDERNUMBER") % 100 == 1, F.concat(cells, F.lit(",surplus"))).when(
        F.col("ORDERNUMBER") % 100 == 2, F.concat_ws(",", S.ROW_KEY, "ORDERNUMBER")).otherwise(cells)
    path = scratch_path(spark, "csv")
    # whole records as one column with no separator or quote of its own
    plain = {"header": True, "sep": "\u0001", "quote": "\u0000", "encoding": "ISO-8859-1"}
    star.sales(spark, sf_dir).select(line.alias(f"{S.ROW_KEY},ORDERNUMBER,QUANTITYORDERED")).write.options(**plain).csv(path)
    _, rejected = orders_csv.split_rejects(orders_csv.read_orders_csv(spark, path, mode="keep"))
    return rejected.select(F.col(orders_csv.RAW_RECORD).alias("record"), F.array_join(orders_csv.REJECT_REASON, ",").alias("bad_columns"))


def _untyped(lines: DataFrame) -> DataFrame:
    """Columns as a file of unknown columns has them: whole numbers, numbers with gaps, numbers among words, flags, nothing."""
    word = F.when(F.col("ORDERNUMBER") % 100 == 0, F.lit("unknown")).otherwise(F.col("MSRP").cast("string"))
    return lines.select(
        S.ROW_KEY, F.col("ORDERNUMBER").alias("WHOLE"), F.col("POSTALCODE").alias("GAPS"), F.col("MSRP").alias("NUMBER"), word.alias("MIXED"),
        F.when(F.col("STATUS") == "Shipped", "True").otherwise("False").alias("FLAG"), F.lit(None).cast("string").alias("NOTHING"))


@register
def csv_inferred(spark, sf_dir):
    """Rows of a file whose types nobody states."""
    path = scratch_path(spark, "csv")
    _untyped(star.sales(spark, sf_dir)).write.option("header", True).csv(path)
    return orders_csv.read_orders_csv(spark, path, types={}, infer=True, multi_line=False)


@register
def csv_column_kinds(spark, sf_dir):
    """What the cells of each of its columns could be, and the kind that follows."""
    path = scratch_path(spark, "csv")
    _untyped(star.sales(spark, sf_dir)).write.option("header", True).csv(path)
    return inference.column_kinds(orders_csv.read_orders_csv(spark, path, types={}, multi_line=False))


@register
def guarded_load(spark, sf_dir):
    """A clean file, one with bad cells and one with bad records: whether each is loaded, and what its report counts."""
    plain = {"header": True, "sep": "\u0001", "quote": "\u0000"}
    # joined once for the three files, which take a few of its columns
    lines = materialize(star.sales(spark, sf_dir).select(S.ROW_KEY, "ORDERNUMBER", "SALES", "MSRP", "QUANTITYORDERED"), "lines", TIGHT)
    price = F.when(F.col("ORDERNUMBER") % 100 == 0, F.lit("unknown")).otherwise(F.col("MSRP").cast("string")).alias("MSRP")
    cells = F.concat_ws(",", S.ROW_KEY, "ORDERNUMBER", F.col("QUANTITYORDERED").cast("int"))
    record = F.when(F.col("ORDERNUMBER") % 100 == 1, F.concat(cells, F.lit(",surplus"))).otherwise(cells)
    files = {"clean": [S.ROW_KEY, "ORDERNUMBER", "SALES"], "cells": [S.ROW_KEY, "ORDERNUMBER", "SALES", price]}
    paths = {name: _as_csv(lines, columns) for name, columns in files.items()} | {"records": scratch_path(spark, "csv")}
    lines.select(record.alias(f"{S.ROW_KEY},ORDERNUMBER,QUANTITYORDERED")).write.options(**plain).csv(paths["records"])
    paths["absent"] = scratch_path(spark, "csv")
    loads = {name: orders_csv.load_guarded(spark, path, report=lambda _: None, multi_line=False) for name, path in paths.items()}
    rows = [(name, x.rows is not None, x.n_rows, x.n_bad_shape, ",".join(f"{c}:{n}" for c, n in x.bad_cells.items())) for name, x in loads.items()]
    return spark.createDataFrame(rows, "file string, loaded boolean, n_rows bigint, n_bad_shape bigint, bad_cells string")


@register
def stored_customer_stats(spark, sf_dir):
    """Customer statistics as a second call finds them: read from the store, nothing computed."""
    kept = Store(spark, f"{scratch_folder(spark)}/store")
    lines = star.sales(spark, sf_dir).select("CUSTOMERNAME", "ORDERNUMBER", "SALES", "QUANTITYORDERED")
    build = lambda rows: features.customer_stats(rows).drop(features.GROUP_ROWS)
    kept.table("customer_stats", lines, build)
    return kept.table("customer_stats", lines, build)


@register
def predictions_sink(spark, sf_dir):
    """Test predictions of one baseline, written to CSV and read back."""
    long = baseline_rows(spark, sf_dir, ["product_mean"]).where(F.col("split") == "test")
    path = scratch_path(spark, "predictions")
    orders_csv.write_predictions(long, path)
    back = spark.read.option("header", True).schema("Actual_Sales double, Predicted_Sales double").csv(path)
    return back


# --- profiles --------------------------------------------------------------------------------------------------

over("row_count", profile.row_count)
over("head_rows", profile.head_rows)
over("non_null_profile", profile.non_null_profile)
over("describe_numeric", lambda df: profile.describe_numeric(df, digits=4))
over("null_counts", profile.null_counts)
over("null_counts_cleaned", lambda df: profile.null_counts(study.cleaned(df)))
over("distinct_counts", profile.distinct_counts)


@register
def describe_features(spark, sf_dir):
    matrix = study.study_matrix(star.sales(spark, sf_dir))
    return profile.describe_numeric(matrix.rows, matrix.columns, digits=2)


@register
def null_total(spark, sf_dir):
    matrix = study.study_matrix(star.sales(spark, sf_dir))
    return profile.null_total(matrix.rows.select(*matrix.columns))


# --- cleaning and projections ----------------------------------------------------------------------------------

over("drop_strict", lambda df: clean.drop_strict(df, S.UNUSED_ADDRESS_COLUMNS))
over("drop_lenient", dashboard.drop_untrainable)
over("rename_address", lambda df: clean.rename(df, S.ADDRESS_RENAME).select(S.ROW_KEY, "ADDRESS"))
over("drop_null_postal", lambda df: clean.drop_null(df, S.REQUIRED_COLUMNS).select(S.ROW_KEY, "POSTALCODE", "SALES"))
over("median_fill", lambda df: study.filled(df, columns=VALUES))
over("feature_select", lambda df: study.feature_select(study.study_features(df, columns=S.FEATURE_SOURCES)))


@register
def median_fill_features(spark, sf_dir):
    matrix = study.study_matrix(star.sales(spark, sf_dir))
    return matrix.rows.select(S.ROW_KEY, *matrix.columns, S.TARGET)


@register
def guarded_features(spark, sf_dir):
    """Lines without a date and customer get only the features their columns allow."""
    lines = star.sales(spark, sf_dir).select(S.ROW_KEY, "PRODUCTLINE", "QUANTITYORDERED", "PRICEEACH", "SALES")
    return dashboard.guarded_features(lines)


# --- joins -----------------------------------------------------------------------------------------------------


def _joined(df: DataFrame, stats: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """The star is joined and its line items are read once; statistics and lines start from the few columns written."""
    lines = materialize(df.select(S.ROW_KEY, key, "ORDERNUMBER", "QUANTITYORDERED", "SALES"), "lines")
    joined = attach(lines.select(S.ROW_KEY, key, "SALES"), stats(lines), [key], rows=features.GROUP_ROWS)
    return joined.drop(features.GROUP_ROWS)


over("join_customer_stats", lambda df: _joined(df, features.customer_stats, "CUSTOMERNAME"))
over("join_product_stats", lambda df: _joined(df, features.product_stats, "PRODUCTLINE"))

# --- aggregates ------------------------------------------------------------------------------------------------

over("sales_by_productline", lambda df: summarise.total_by(df, ["PRODUCTLINE"], "SALES", "total_sales", descending=True))
over("avg_sales_by_year", lambda df: summarise.mean_by(df, ["YEAR_ID"], "SALES", "avg_sales"))
over("avg_sales_by_quarter", lambda df: summarise.mean_by(df, ["QTR_ID"], "SALES", "avg_sales"))
over("sales_by_status", lambda df: summarise.total_by(df, ["STATUS"], "SALES", "total_sales", descending=True))
over("sales_by_orderdate", lambda df: summarise.total_by(df, ["ORDERDATE"], "SALES", "total_sales"))
over("kpis", summarise.kpis)
over("dealsize_share", lambda df: summarise.share_by(df, "DEALSIZE", "SALES"))
over("customer_stats", lambda df: features.customer_stats(df).drop(features.GROUP_ROWS))
over("customer_stats_app", lambda df: features.customer_stats_dashboard(df).drop(features.GROUP_ROWS))
over("product_stats", lambda df: features.product_stats(df).drop(features.GROUP_ROWS))
over("product_stats_app", lambda df: features.product_stats_dashboard(df).drop(features.GROUP_ROWS))
over("sales_histogram", lambda df: summarise.histogram(df, "SALES", 50).withColumns(
    {c: F.round(c, 4) for c in ("low", "high")}))
over("qty_sales_corr", lambda df: summarise.correlation(df, "QUANTITYORDERED", "SALES").select(
    F.round("correlation", 8).alias("correlation")))
over("qty_sales_points", lambda df: summarise.point_set(df, ["QUANTITYORDERED", "SALES", "STATUS"]))
over("qty_sales_grid", lambda df: summarise.grid_counts(df, "QUANTITYORDERED", "SALES", 50, ["STATUS"]))
over("sales_by_country_productline", lambda df: summarise.total_by(
    df, ["COUNTRY", "PRODUCTLINE"], "SALES", "total_sales"))
over("sales_by_year_quarter", lambda df: summarise.total_by(df, ["YEAR_ID", "QTR_ID"], "SALES", "total_sales"))


@register
def option_lists(spark, sf_dir):
    lines = star.sales(spark, sf_dir).select("PRODUCTLINE", "DEALSIZE")
    both = lines.unpivot([], lines.columns, "list_name", "choice")
    return both.distinct()


# the study's charts show the cleaned, filled lines; the dashboard's the engineered ones
CHARTS = {
    "sales_by_productline": lambda df: summarise.total_by(df, ["PRODUCTLINE"], "SALES", "total_sales", descending=True),
    "avg_sales_by_year": lambda df: summarise.mean_by(df, ["YEAR_ID"], "SALES", "avg_sales"),
    "avg_sales_by_quarter": lambda df: summarise.mean_by(df, ["QTR_ID"], "SALES", "avg_sales"),
    "sales_by_status": lambda df: summarise.total_by(df, ["STATUS"], "SALES", "total_sales", descending=True),
    "sales_histogram": lambda df: summarise.histogram(df, "SALES", 50).withColumns({c: F.round(c, 4) for c in ("low", "high")}),
}
CHART_COLUMNS = ["PRODUCTLINE", "YEAR_ID", "QTR_ID", "STATUS", "SALES"]
for chart, build in CHARTS.items():
    over(f"{chart}_cleaned", lambda df, build=build: build(study.filled_lazily(df, CHART_COLUMNS)))


def engineered(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """`build` over the dashboard's engineered lines, from the columns that its charts need."""
    needed = ["ORDERNUMBER", "ORDERDATE", "PRODUCTLINE", "CUSTOMERNAME", "DEALSIZE", "STATUS", "QUANTITYORDERED", "SALES"]
    return lambda df: build(dashboard.dashboard_features(df.select(*needed)))


over("kpis_app", engineered(lambda df: dashboard.report(df)["kpis"]), dashboard_lines)
over("sales_by_productline_app", engineered(lambda df: dashboard.report(df)["sales_by_productline"]), dashboard_lines)
over("sales_by_orderdate_app", engineered(lambda df: dashboard.report(df)["sales_by_orderdate"]), dashboard_lines)
over("dealsize_share_app", engineered(lambda df: dashboard.report(df)["dealsize_share"]), dashboard_lines)

# --- rankings --------------------------------------------------------------------------------------------------

over("top_orders", lambda df: summarise.top_n(study.filled_lazily(df, S.TOP_COLUMNS), "SALES", 10, S.TOP_COLUMNS))
over("top_customers", lambda df: summarise.top_n(
    features.customer_stats(df), "CUSTOMER_TOTAL_SALES", 10,
    ["CUSTOMERNAME", "CUSTOMER_TOTAL_SALES", "CUSTOMER_ORDER_COUNT"], tie=["CUSTOMERNAME"]))

# --- scalar features -------------------------------------------------------------------------------------------

over("price_features", lambda df: features.price_features(df).select(
    S.ROW_KEY, "PROFIT_MARGIN", "PRICE_DISCOUNT", "REVENUE_PER_UNIT"))
over("interaction_features", lambda df: df.select(
    S.ROW_KEY, features.quantity_times_price().alias("QTY_PRICE_INTERACTION")))
over("status_msrp", lambda df: df.select(S.ROW_KEY, features.shipped_msrp().alias("STATUS_MSRP_RATIO")))
over("parse_dates_coerce", lambda df: features.parse_dates(
    df.select(S.ROW_KEY, "ORDERDATE"), "ORDERDATE", strict=False), dashboard_lines)
over("date_format_counts", lambda df: features.format_counts(df.select("ORDERDATE"), "ORDERDATE"), dashboard_lines)
over("parse_dates_discovered", lambda df: features.parse_discovered(
    materialize(df.select(S.ROW_KEY, "ORDERDATE"), "dates"), "ORDERDATE", strict=False), dashboard_lines)
over("parse_dates_strict", lambda df: features.parse_dates(
    df.select(S.ROW_KEY, F.date_format("ORDERDATE", "M/d/yyyy H:mm").alias("ORDERDATE")), "ORDERDATE", strict=True))
over("temporal_features", lambda df: features.date_parts(
    df.select(S.ROW_KEY, "ORDERDATE"), "ORDERDATE", ["DAY_OF_WEEK", "DAY_OF_MONTH", "WEEK_OF_YEAR"]).drop("ORDERDATE"))
over("date_parts_app", lambda df: features.date_parts(
    features.parse_dates(df.select(S.ROW_KEY, "ORDERDATE"), "ORDERDATE", strict=False),
    "ORDERDATE", ["YEAR", "MONTH", "DAY_OF_WEEK", "QUARTER"]).drop("ORDERDATE"), dashboard_lines)

# --- composed feature tables -----------------------------------------------------------------------------------

over("features_notebook", study.study_features)
over("features_app", dashboard.dashboard_features, dashboard_lines)

# --- model inputs ----------------------------------------------------------------------------------------------


@register
def label_encode(spark, sf_dir):
    lines = star.sales(spark, sf_dir).select(S.ROW_KEY, *S.CATEGORICAL_FEATURES)
    return prepare.encode(lines, prepare.fit_codes(lines, S.CATEGORICAL_FEATURES), S.CATEGORICAL_FEATURES)


@register
def label_encode_all(spark, sf_dir):
    """Every text column that training keeps, the always-missing ones included."""
    lines = dashboard.drop_untrainable(star.sales(spark, sf_dir)).drop("ORDERDATE_TEXT")
    texts = [c for c, kind in lines.dtypes if kind == "string" and c != S.ROW_KEY]
    lines = lines.select(S.ROW_KEY, *texts)
    return prepare.encode(lines, prepare.fit_codes(lines, texts), texts)


over("encoder_classes", lambda df: prepare.class_counts(prepare.fit_codes(df, S.CATEGORICAL_FEATURES)))
over("train_test_split", lambda df: prepare.with_split(df.select(S.ROW_KEY)))
over("split_ratio", lambda df: prepare.split_ratio(prepare.with_split(df.select(S.ROW_KEY))))
@register
def exact_split(spark, sf_dir):
    """Train and test parts whose sizes are exact, whatever the number of lines."""
    keys = star.sales(spark, sf_dir).select(S.ROW_KEY)
    return prepare.exact_splitter(keys)(keys)


@register
def exact_split_ratio(spark, sf_dir):
    """Sizes of the parts of the study's own rows, split exactly."""
    lines = study.cleaned(star.sales(spark, sf_dir)).select(S.ROW_KEY)
    return prepare.split_ratio(study.exact_splitter(star.sales(spark, sf_dir))(lines))


@register
def exact_folds(spark, sf_dir):
    """Folds of that train part, of sizes that differ by one at most."""
    train = materialize(exact_split(spark, sf_dir).where(F.col("split") == "train").select(S.ROW_KEY), "train")
    return prepare.exact_folder(train)(train)


over("fold_assign", lambda df: prepare.with_fold(df.select(S.ROW_KEY)))


@register
def standard_scale(spark, sf_dir):
    columns = ["QUANTITYORDERED", "PRICEEACH", "MSRP"]
    lines = split_lines(spark, sf_dir)
    scaled = prepare.standardise(lines, columns, fit_on=lines.where(F.col("split") == "train"))
    return scaled.select(S.ROW_KEY, *[F.round(c, 8).alias(c) for c in columns])


# --- evaluation, on predictors that SQL can express -------------------------------------------------------------


@register
def ols_one_feature(spark, sf_dir):
    train = split_lines(spark, sf_dir).where(F.col("split") == "train")
    line = evaluate.fit_line(train, "QUANTITYORDERED", "SALES")
    return line.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@register
def cv_baselines(spark, sf_dir):
    train = prepare.with_fold(split_lines(spark, sf_dir).where(F.col("split") == "train"), prepare.FOLDS)
    scores = evaluate.cross_validate_baselines(train, prepare.FOLDS)
    return scores.select("model", F.round("mean_r2", 8).alias("mean_r2"), "folds")


@register
def metrics_by_split(spark, sf_dir):
    measured = baseline_measures(spark, sf_dir)
    return measured.select(
        "model", "split", F.round("r2", 8).alias("r2"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), "n"
    )


@register
def accuracy_pct(spark, sf_dir):
    shown = evaluate.accuracy_pct(baseline_measures(spark, sf_dir))
    return shown.select("model", F.round("accuracy_pct", 6).alias("accuracy_pct"))


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compare(baseline_measures(spark, sf_dir))


# ranked as measured; the last digits, which depend on the order of sums, are cut off when shown only
QUERIES["comparison_table"] = lambda spark, sf_dir: evaluate.shown(comparison(spark, sf_dir))
QUERIES["best_model"] = lambda spark, sf_dir: evaluate.shown(
    evaluate.best_model(comparison(spark, sf_dir), evaluate.BASELINES), 8)
QUERIES["model_bars"] = lambda spark, sf_dir: evaluate.shown(evaluate.model_bars(comparison(spark, sf_dir)), 8)


@register
def residuals(spark, sf_dir):
    out = evaluate.residuals(baseline_rows(spark, sf_dir))
    return out.select("model", S.ROW_KEY, settled("prediction"), settled("residual"))


@register
def residual_histogram(spark, sf_dir):
    bars = evaluate.residual_histogram(baseline_rows(spark, sf_dir, ["product_mean"]), "product_mean")
    return bars.withColumns({c: F.round(c, 4) for c in ("low", "high")})


@register
def actual_vs_predicted(spark, sf_dir):
    return baseline_rows(spark, sf_dir).select(
        "model", "split", S.ROW_KEY, "label", settled("prediction")
    )


over("actual_min_max", lambda df: summarise.value_range(prepare.with_split(df), "SALES", ["split"]))

# --- scenarios -------------------------------------------------------------------------------------------------

over("scenario_estimates", lambda df: scenario.estimate(
    df.select(S.ROW_KEY, "QUANTITYORDERED", "PRICEEACH", "MSRP", "PRODUCTLINE", "DEALSIZE").withColumns(
        {"PRICEEACH": F.col("PRICEEACH") / 10, "MSRP": F.col("MSRP") / 2})))
over("scenario_grid", lambda df: scenario.estimate(scenario.scenario_grid(
    df, quantities=[5, 10, 50, 100, 200, 250], prices=[5, 10, 100, 500, 600], list_prices=[110, 501])))

# --- learners --------------------------------------------------------------------------------------------------

QUERIES["ols"] = learner_metrics({"linear": models.OLS})
QUERIES["ridge"] = learner_metrics({"ridge": models.RIDGE})
QUERIES["random_forest"] = learner_metrics({"forest": models.RANDOM_FOREST})
QUERIES["gbt"] = learner_metrics({"boosted": models.GBT})


def narrow(columns: list[str]):
    """(spark, folder) -> learner rows of the train part from a few columns that SQL can follow; no other is written."""

    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = prepare.with_split(study.filled(star.sales(spark, sf_dir), columns=[S.ROW_KEY, *columns, S.TARGET]))
        return prepare.assemble(lines.where(F.col("split") == "train"), columns, S.TARGET, [S.ROW_KEY])

    return rows


def fitted_trees(learner: models.Learner, rows: DataFrame) -> Model:
    """`learner` fitted to `rows`, which are dealt once for all its passes."""
    with models.held(models.dealt(rows, S.ROW_KEY).drop(S.ROW_KEY)) as train:
        return models.fit(learner, train)


def coefficients(learner: models.Learner, columns: list[str]) -> Query:
    """Fitted slopes and intercept as rows."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = models.fit(learner, narrow(columns)(spark, sf_dir))
        values = [*zip(columns, model.coefficients.tolist()), ("intercept", model.intercept)]
        table = spark.createDataFrame([(n, float(v)) for n, v in values], "term string, value double")
        return table.select("term", F.round("value", 4).alias("value"))

    return query


QUERIES["ols_two_features"] = coefficients(models.OLS, ["QUANTITYORDERED", "PRICEEACH"])
QUERIES["ridge_one_feature"] = coefficients(models.Learner("ridge", {"alpha": 1000.0}), ["QUANTITYORDERED"])


def stump(learner: models.Learner) -> Query:
    """What a single split on the quantity predicts, and how important the quantity is."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = narrow(["QUANTITYORDERED"])(spark, sf_dir)
        model = fitted_trees(learner, rows)
        weight = models.importances(model, ["QUANTITYORDERED"], 1).first()["importance"]
        quantity = vector_to_array("features")[0].alias("quantity")
        values = rows.groupBy("features").agg(F.count("*").alias("n"))
        return model.transform(values).select(
            quantity, "n", F.round("prediction", 4).alias("prediction"), F.lit(weight).alias("importance"))

    return query


QUERIES["forest_stump"] = stump(models.Learner("forest", {"trees": 1, "depth": 1, "bootstrap": False}))
QUERIES["boosted_stump"] = stump(models.Learner("boosted", {"trees": 1, "depth": 1, "rate": 0.1}))


ROUNDS = models.Learner("boosted", {"trees": 3, "depth": 1, "rate": 0.1})


@register
def boosted_rounds(spark, sf_dir):
    """Three rounds of boosting on the quantity: each fits what the rounds before have left."""
    rows = narrow(["QUANTITYORDERED"])(spark, sf_dir)
    values = rows.groupBy("features").agg(F.count("*").alias("n"))
    quantity = vector_to_array("features")[0].alias("quantity")
    return fitted_trees(ROUNDS, rows).transform(values).select(quantity, "n", F.round("prediction", 4).alias("prediction"))


@register
def split_gains(spark, sf_dir):
    """What the splits of these rounds gain."""
    columns = ["QUANTITYORDERED"]
    gains = models.split_gains(fitted_trees(ROUNDS, narrow(columns)(spark, sf_dir)), columns)
    return gains.select("feature", "splits", *[(F.round(F.col(c) / 1e6, 4)).alias(c) for c in ("total_gain", "mean_gain")], "importance")


@register
def boosted_importance(spark, sf_dir):
    """The study's boosted trees and their fifteen leading features by the mean gain of a split."""
    matrix = study_rows(spark, sf_dir)
    with models.train_rows(study.vectors(matrix), S.ROW_KEY) as train:
        model = models.fit(models.BOOSTED, train)
    return models.split_gains(model, matrix.columns, 15)


#: The study's learners; the boosted trees with the settings that tuning starts from.
FIVE = {**study.COMPARED, f"{study.TUNED} (untuned)": models.BOOSTED}


@register
def learner_comparison(spark, sf_dir):
    """Five learners at full size, fitted to the same rows at a time, ranked by what they score on the test part."""
    measured = learner_metrics(FIVE)(spark, sf_dir)
    table = materialize(evaluate.compare(measured), "comparison")
    best = evaluate.best_model(table, list(FIVE)).select("model", F.lit(True).alias("best"))
    # one row per learner
    return evaluate.shown(table).join(F.broadcast(best), "model", "left").na.fill({"best": False})


def training_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's engineered lines, without the columns that have no part in features or training."""
    unused = [c for c in S.DASHBOARD_DROP if c not in dashboard.FEATURE_SOURCES]
    return dashboard.dashboard_features(dashboard_lines(spark, sf_dir).drop(*unused))


def dashboard_learner(kind: str) -> Query:
    """Test metrics of one of the dashboard's learners, by its name there."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dashboard.train(training_lines(spark, sf_dir), kind=kind, rewrite=False).metrics

    return query


QUERIES["dashboard_boosted"] = dashboard_learner("XGBoost")
QUERIES["dashboard_forest"] = dashboard_learner("Random Forest")


@register
def feature_importance(spark, sf_dir):
    """The dashboard's gradient boosting and its ten leading features."""
    trained = dashboard.train(training_lines(spark, sf_dir), kind="Gradient Boosting", rewrite=False)
    return models.importances(trained.model, trained.columns, 10)


@register
def grid_search_short(spark, sf_dir):
    """Grid search on all train rows over a grid of its own, with fewer and shallower trees than `models.TUNING_GRID`."""
    with models.train_rows(study.vectors(study_rows(spark, sf_dir), folds=3), S.ROW_KEY) as train:
        grid = {"trees": [10], "depth": [3, 5], "rate": [0.1, 0.3]}
        _, _, scores = models.grid_search(models.BOOSTED, train, grid, folds=3, fold_column="fold")
        return scores


@register
def scenario_model(spark, sf_dir):
    """What-if grid scored by a line fitted to all order lines."""
    lines = study.filled(star.sales(spark, sf_dir), columns=[*VALUES, *scenario.CATEGORIES])
    grid = scenario.scenario_grid(
        lines, quantities=[10, 50, 100, 200], prices=[10, 100, 500], list_prices=[110, 500])
    return scenario.score(grid, scenario.fit_what_if(lines, models.OLS))
