"""The full study: clean, derive features, build and split the model matrix."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise import schema as S
from linewise.operators import clean, evaluate, features, models, prepare, profile, summarise
from linewise.operators.lookup import attach
from linewise.session import TIGHT, materialize


def cleaned(df: DataFrame) -> DataFrame:
    """Unused columns dropped, address renamed, lines without a postal code dropped."""
    kept = clean.drop_strict(df, S.UNUSED_ADDRESS_COLUMNS)
    return clean.drop_null(clean.rename(kept, S.ADDRESS_RENAME), S.REQUIRED_COLUMNS)


Splitter = Callable[[DataFrame], DataFrame]


def exact_splitter(df: DataFrame) -> Splitter:
    """Split of the cleaned lines whose test part is exactly a fifth of them, for `study_matrix`."""
    return prepare.exact_splitter(cleaned(df).select(S.ROW_KEY))


def filled(
    df: DataFrame, leak_free: bool = False, columns: list[str] | None = None, splitter: Splitter = prepare.with_split
) -> DataFrame:
    """Cleaned lines with numeric NULLs replaced by medians; only `columns`, if given.

    Written once: medians, statistics and features each scan it, reading only the columns they need.
    """
    lines = cleaned(df)
    lines = lines if columns is None else lines.select(*columns)
    return clean.materialize_filled(lines, "cleaned", lambda rows: _fit_rows(rows, leak_free, splitter))


def filled_lazily(df: DataFrame, columns: list[str]) -> DataFrame:
    """Some cleaned columns (and the row key) for a single pass: medians are sought only if a scan finds NULLs among
    their numbers, and nothing is written."""
    return clean.median_fill(cleaned(df).select(S.ROW_KEY, *[c for c in columns if c != S.ROW_KEY]))


def _fit_rows(df: DataFrame, leak_free: bool, splitter: Splitter) -> DataFrame:
    """Rows that fitted values may come from: all of them, or the train part only."""
    if not leak_free:
        return df
    return splitter(df).where(F.col("split") == "train").select(*df.columns)


def with_statistics(df: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """Customer and product-line statistics on every line."""
    source = df if fit_on is None else fit_on
    out = attach(df, features.customer_stats(source), ["CUSTOMERNAME"], rows=features.GROUP_ROWS)
    out = out.drop(features.GROUP_ROWS)
    out = attach(out, features.product_stats(source), ["PRODUCTLINE"], rows=features.GROUP_ROWS)
    return out.drop(features.GROUP_ROWS)


def study_features(
    df: DataFrame, leak_free: bool = False, columns: list[str] | None = None, splitter: Splitter = prepare.with_split
) -> DataFrame:
    """Cleaned, filled lines with price, calendar, customer, product and interaction columns.

    `leak_free` fits medians and statistics on the train part only and leaves out features made from the target.
    """
    base = filled(df, leak_free, columns, splitter)
    # joined before anything is derived: where the customers are too many to broadcast, the lines are exchanged as narrow as they are
    joined = with_statistics(base, _fit_rows(base, leak_free, splitter))
    statistics = [c for c in joined.columns if c not in base.columns]
    out = features.price_features(joined)
    if leak_free:
        out = out.drop(*S.TARGET_DERIVED_FEATURES)
    out = features.parse_dates(out, "ORDERDATE", strict=True)
    out = features.date_parts(out, "ORDERDATE", ["DAY_OF_WEEK", "DAY_OF_MONTH", "WEEK_OF_YEAR"])
    out = out.select(*[c for c in out.columns if c not in statistics], *statistics)
    return features.interaction_features(out)


def feature_select(df: DataFrame, leak_free: bool = False) -> DataFrame:
    """Row key, categorical and numeric features, target."""
    return df.select(S.ROW_KEY, *S.CATEGORICAL_FEATURES, *numeric_features(leak_free), S.TARGET)


def numeric_features(leak_free: bool = False) -> list[str]:
    return [c for c in S.NUMERIC_FEATURES if not (leak_free and c in S.TARGET_DERIVED_FEATURES)]


@dataclass(frozen=True)
class Matrix:
    """Model matrix with `split`, its feature columns, and the category codes behind it."""

    rows: DataFrame
    columns: list[str]
    codes: DataFrame

    def part(self, name: str) -> DataFrame:
        return self.rows.where(F.col("split") == name)


def study_matrix(df: DataFrame, leak_free: bool = False, splitter: Splitter = prepare.with_split) -> Matrix:
    """Encoded, filled and split feature matrix, not yet scaled. `splitter` marks the parts: about a fifth for testing, or
    `exact_splitter(df)` for exactly that."""
    columns = [*S.CATEGORICAL_FEATURES, *numeric_features(leak_free)]
    selected = clean.materialize_filled(
        splitter(feature_select(study_features(df, leak_free, S.FEATURE_SOURCES, splitter), leak_free)),
        "features",
        lambda rows: _fit_rows(rows, leak_free, splitter),
    )
    codes = prepare.fit_codes(_fit_rows(selected, leak_free, splitter), S.CATEGORICAL_FEATURES)
    encoded = prepare.encode(selected, codes, S.CATEGORICAL_FEATURES)
    if leak_free:  # only then can a label be unknown
        encoded = clean.median_fill(encoded, S.CATEGORICAL_FEATURES, fit_on=_fit_rows(encoded, leak_free, splitter))
    return Matrix(encoded, columns, codes)


def scaled_matrix(matrix: Matrix) -> Matrix:
    """Features standardised with the train part's mean and deviation. The encoded rows are written first, so that fitting
    and scaling don't each join the codes."""
    written = Matrix(materialize(matrix.rows, "encoded", TIGHT), matrix.columns, matrix.codes)
    return Matrix(prepare.standardise(written.rows, matrix.columns, fit_on=written.part("train")), matrix.columns, matrix.codes)


def vectors(matrix: Matrix, folds: int = prepare.FOLDS) -> DataFrame:
    """(row key, split, fold, features, label) of a scaled matrix, made from its written rows by every pass.

    Linear learners and scores read it as it is; trees are fitted to its train part (`models.train_rows`)."""
    keyed = prepare.with_fold(matrix.rows, folds)
    return prepare.assemble(keyed, matrix.columns, S.TARGET, [S.ROW_KEY, "split", "fold"])


def explore(df: DataFrame) -> dict[str, DataFrame]:
    """Profiles of the raw lines, and the data of the study's charts over the cleaned, filled ones."""
    lines = filled(df)
    return {
        "row_count": profile.row_count(df),
        "head": profile.head_rows(df),
        "non_null": profile.non_null_profile(df),
        "describe": profile.describe_numeric(df),
        "nulls": profile.null_counts(df),
        "distinct": profile.distinct_counts(df),
        "nulls_cleaned": profile.null_counts(cleaned(df)),
        "top_orders": summarise.top_n(lines, "SALES", 10, S.TOP_COLUMNS),
        "sales_histogram": summarise.histogram(lines, "SALES", 50),
        "sales_by_productline": summarise.total_by(lines, ["PRODUCTLINE"], "SALES", "total_sales", descending=True),
        "avg_sales_by_year": summarise.mean_by(lines, ["YEAR_ID"], "SALES", "avg_sales"),
        "qty_sales_grid": summarise.grid_counts(lines, "QUANTITYORDERED", "SALES"),
        "sales_by_status": summarise.total_by(lines, ["STATUS"], "SALES", "total_sales", descending=True),
        "avg_sales_by_quarter": summarise.mean_by(lines, ["QTR_ID"], "SALES", "avg_sales"),
    }


# Names of the compared learners; the tuned one joins them under TUNED.
COMPARED = {
    "Linear Regression": models.OLS,
    "Ridge Regression": models.RIDGE,
    "Random Forest": models.RANDOM_FOREST,
    "Gradient Boosting": models.GBT,
}
TUNED = "XGBoost"


@dataclass(frozen=True)
class Comparison:
    """Fitted models and everything reported from their predictions."""

    models: dict[str, Model]
    search: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    table: DataFrame
    best: DataFrame
    importances: DataFrame


def compare_learners(
    matrix: Matrix,
    learners: dict[str, models.Learner] | None = None,
    grid: dict[str, list] = models.TUNING_GRID,
    folds: int = prepare.FOLDS,
    parallelism: int = models.PARALLEL_FITS,
) -> Comparison:
    """Tune the boosted trees, fit the other learners meanwhile, and compare all on the same scaled rows."""
    learners = learners or COMPARED
    rows = vectors(scaled_matrix(matrix), folds)
    with models.train_rows(rows, S.ROW_KEY) as train, ThreadPool(1) as aside:
        others = aside.apply_async(models.fit_all, (learners, train, parallelism))
        if models.fits_at_a_time(train.count(), parallelism) == 1:
            others.wait()
        tuned, _, search = models.grid_search(models.BOOSTED, train, grid, folds, parallelism=parallelism)
        fitted = others.get() | {TUNED: tuned}
    # written once: one scan scores every row with every model, and all reports start from these rows
    predictions = materialize(evaluate.predictions(fitted, rows), "predictions", TIGHT)
    metrics = evaluate.metrics(predictions)
    table = evaluate.compare(metrics)
    ranked = models.split_gains(tuned, matrix.columns, 15)
    best = evaluate.best_model(table, list(fitted))
    return Comparison(fitted, search, predictions, metrics, table, best, ranked)
