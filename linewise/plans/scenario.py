"""What-if estimates for whole tables of scenarios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.operators import prepare
from linewise.operators.features import quantity_times_price
from linewise.operators.models import Learner, dealt, fit, held, in_one_pass, load_model
from linewise.schema import ROW_KEY, TARGET

CATEGORIES = ["PRODUCTLINE", "DEALSIZE"]

# Allowed inputs of a scenario.
BOUNDS = {"QUANTITYORDERED": (10, 200), "PRICEEACH": (10.0, 500.0), "MSRP": (10.0, 500.0)}


def in_bounds() -> Column:
    checks = [F.col(c).between(low, high) for c, (low, high) in BOUNDS.items()]
    return checks[0] & checks[1] & checks[2]


def scenario_grid(df: DataFrame, quantities: list[float], prices: list[float], list_prices: list[float]) -> DataFrame:
    """Every product line with every deal size of the order lines, seen together or not, at every asked quantity, price
    and list price. Both lists are what a form offers to choose from; each is gathered as one set."""
    lists = df.agg(*[F.collect_set(c).alias(c) for c in CATEGORIES])
    offers = lists.select(F.explode("PRODUCTLINE").alias("PRODUCTLINE"), "DEALSIZE")
    offers = offers.select("PRODUCTLINE", F.explode("DEALSIZE").alias("DEALSIZE"))

    def each(values: list[float]) -> Column:
        return F.explode(F.array(*[F.lit(float(v)) for v in values]))

    return (
        offers.select("*", each(quantities).alias("QUANTITYORDERED"))
        .select("*", each(prices).alias("PRICEEACH"))
        .select("*", each(list_prices).alias("MSRP"))
    )


def estimate(scenarios: DataFrame) -> DataFrame:
    """Expected revenue, quantity x price, of the scenarios within bounds."""
    return scenarios.where(in_bounds()).withColumn("ESTIMATE", quantity_times_price())


@dataclass(frozen=True)
class WhatIf:
    """A model over a scenario's own inputs, and the category codes it was fitted with."""

    model: Model
    codes: DataFrame

    def save(self, path: str) -> None:
        """Model and codes in one folder."""
        self.model.write().overwrite().save(f"{path}/model")
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> WhatIf:
        return cls(load_model(spark, f"{path}/model"), spark.read.parquet(f"{path}/codes"))


def _vectors(df: DataFrame, codes: DataFrame, keep: list[str]) -> DataFrame:
    marked = df.withColumns({f"_{c}": F.col(c) for c in CATEGORIES})  # the texts stay next to their codes
    encoded = prepare.encode(marked, codes, CATEGORIES)
    # a choice never seen in the lines cannot be estimated
    known = encoded.na.drop(subset=[*BOUNDS, *CATEGORIES])
    vectors = VectorAssembler(inputCols=[*BOUNDS, *CATEGORIES], outputCol="features").transform(known)
    return vectors.withColumns({c: F.col(f"_{c}") for c in CATEGORIES}).select(*keep, "features")


def fit_what_if(lines: DataFrame, learner: Learner, target: str = TARGET) -> WhatIf:
    codes = prepare.fit_codes(lines, CATEGORIES)
    rows = _vectors(lines, codes, [ROW_KEY, F.col(target).alias("label")])
    if in_one_pass(learner):
        return WhatIf(fit(learner, rows.drop(ROW_KEY)), codes)
    with held(dealt(rows, ROW_KEY).drop(ROW_KEY)) as train:
        return WhatIf(fit(learner, train), codes)


def score(scenarios: DataFrame, what_if: WhatIf) -> DataFrame:
    """Expected revenue, by the fitted model, of the scenarios within bounds: raw rows, a saved model's too."""
    inputs = scenarios.columns
    vectors = _vectors(scenarios.where(in_bounds()), what_if.codes, inputs)
    return what_if.model.transform(vectors).select(*inputs, F.col("prediction").alias("ESTIMATE"))
