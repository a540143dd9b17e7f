"""The dashboard's own path: features that depend on the columns present, one learner by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise import schema as S
from linewise.functions.semantics import numeric_columns, text_columns
from linewise.operators import clean, evaluate, features, models, prepare, summarise
from linewise.operators.lookup import attach
from linewise.session import TIGHT, materialize

# Learner by name; any other name means gradient boosting.
LEARNERS = {"XGBoost": models.BOOSTED_DASHBOARD, "Random Forest": models.RANDOM_FOREST}
FALLBACK = models.GBT_DASHBOARD
# Columns that features are made from; of those that are dropped before training, only these have a use.
FEATURE_SOURCES = ["ORDERNUMBER", "ORDERDATE", "CUSTOMERNAME", "PRODUCTLINE", "QUANTITYORDERED", "PRICEEACH", "SALES"]


def _has(df: DataFrame, *columns: str) -> bool:
    return all(c in df.columns for c in columns)


def guarded_features(df: DataFrame) -> DataFrame:
    """Date parts, customer and product statistics and expected revenue, each only if its inputs exist."""
    out = df
    if _has(df, "CUSTOMERNAME", "SALES"):  # joined before dates are read: where customers are many, the lines are exchanged as they are
        stats = features.customer_stats_dashboard(df)
        out = attach(out, stats, ["CUSTOMERNAME"], features.GROUP_ROWS).drop(features.GROUP_ROWS)
    if _has(df, "PRODUCTLINE", "SALES"):
        stats = features.product_stats_dashboard(df)
        out = attach(out, stats, ["PRODUCTLINE"], features.GROUP_ROWS).drop(features.GROUP_ROWS)
    statistics = [c for c in out.columns if c not in df.columns]
    if _has(df, "ORDERDATE"):
        out = features.parse_dates(out, "ORDERDATE", strict=False)
        out = features.date_parts(out, "ORDERDATE", ["YEAR", "MONTH", "DAY_OF_WEEK", "QUARTER"])
        out = out.select(*[c for c in out.columns if c not in statistics], *statistics)
    if _has(df, "QUANTITYORDERED", "PRICEEACH"):
        out = out.withColumn("THEORETICAL_REV", features.quantity_times_price())
    return out


def dashboard_features(df: DataFrame, rewrite: bool = True) -> DataFrame:
    """Guarded features, then medians for every numeric NULL, bad dates included.

    The lines are scanned three times; `rewrite=False` saves writing them first where they are a flat
    columnar table already.
    """
    lines = materialize(df, "lines", TIGHT) if rewrite else df
    return clean.materialize_filled(guarded_features(lines), "features")


def report(df: DataFrame) -> dict[str, DataFrame]:
    """Key figures, and the data of every chart that the columns allow."""
    frames = {"kpis": summarise.kpis(df)}
    if _has(df, "PRODUCTLINE"):
        frames["sales_by_productline"] = summarise.total_by(df, ["PRODUCTLINE"], "SALES", "total_sales")
    if _has(df, "ORDERDATE"):
        frames["sales_by_orderdate"] = summarise.total_by(df, ["ORDERDATE"], "SALES", "total_sales")
    if _has(df, "DEALSIZE"):
        frames["dealsize_share"] = summarise.share_by(df, "DEALSIZE", "SALES")
    by = ["STATUS"] if _has(df, "STATUS") else []
    frames["qty_sales_grid"] = summarise.grid_counts(df, "QUANTITYORDERED", "SALES", by=by)
    for column in ("PRODUCTLINE", "DEALSIZE"):
        if _has(df, column):
            frames[f"options_{column}"] = summarise.options(df, column)
    return frames


def drop_untrainable(df: DataFrame) -> DataFrame:
    return clean.drop_lenient(df, S.DASHBOARD_DROP)


@dataclass(frozen=True)
class Trained:
    model: Model
    columns: list[str]
    metrics: DataFrame
    predictions: DataFrame
    texts: list[str]
    codes: DataFrame | None

    def score(self, rows: DataFrame) -> DataFrame:
        """`rows` of engineered lines (with or without a target) and their `prediction`; a line with a category never seen
        or a missing number is left out."""
        kept = rows.withColumns({f"_{c}": F.col(c) for c in rows.columns})
        coded = prepare.encode(kept, self.codes, self.texts) if self.texts else kept
        ready = coded.na.drop(subset=self.columns)
        vectors = VectorAssembler(inputCols=self.columns, outputCol="features").transform(ready)
        return self.model.transform(vectors).select(*[F.col(f"_{c}").alias(c) for c in rows.columns], "prediction")

    def save(self, path: str) -> None:
        """Model, codes and columns in one folder, all that `score` needs."""
        spark = self.predictions.sparkSession
        self.model.write().overwrite().save(f"{path}/model")
        if self.codes is not None:
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        names = [("column", i, c) for i, c in enumerate(self.columns)] + [("text", i, c) for i, c in enumerate(self.texts)]
        spark.createDataFrame(names, "kind string, place int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
        self.predictions.write.mode("overwrite").parquet(f"{path}/predictions")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trained:
        names = spark.read.parquet(f"{path}/columns").orderBy("place").collect()
        columns, texts = ([r["name"] for r in names if r["kind"] == kind] for kind in ("column", "text"))
        scored = spark.read.parquet(f"{path}/predictions")
        codes = spark.read.parquet(f"{path}/codes") if texts else None
        return cls(models.load_model(spark, f"{path}/model"), columns, evaluate.metrics(scored), scored, texts, codes)


def train(df: DataFrame, target: str = S.TARGET, kind: str = "XGBoost", key: str = S.ROW_KEY, rewrite: bool = True) -> Trained:
    """Every remaining text column encoded, no scaling, one learner, scored on the test part.

    The lines are scanned several times; `rewrite=False` saves writing them first where they are a projection of a
    written table, as `dashboard_features` gives them.
    """
    rows = prepare.with_split(drop_untrainable(df), key)
    if rewrite:
        rows = materialize(rows, "dashboard", TIGHT)
    texts = [c for c in text_columns(rows) if c not in (key, "split")]
    codes = prepare.fit_codes(rows, texts) if texts else None
    encoded = prepare.encode(rows, codes, texts) if texts else rows
    columns = [c for c in [*texts, *numeric_columns(rows)] if c not in (target, key)]
    columns = [c for c in rows.columns if c in columns]
    vectors = prepare.assemble(encoded, columns, target, [key, "split"])  # made from the written rows by the exchange and by the scores
    with models.train_rows(vectors, key) as fitted_to:
        model = models.fit(LEARNERS.get(kind, FALLBACK), fitted_to)
    scored = evaluate.predictions({kind: model}, vectors.where(F.col("split") == "test"), key)
    return Trained(model, columns, evaluate.metrics(scored), scored, texts, codes)
