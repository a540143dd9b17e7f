"""Repeatable made-up order lines: every value is a function of (seed, column, row id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.functions.semantics import uniform

# Domains, weights and ranges of the made-up data.
PRODUCT_LINES = ["Classic Car", "Motorcycle", "Plane", "Ship", "Train", "Truck", "Vintage Car"]
STATUSES = ["Shipped", "Cancelled", "Resolved", "On Hold", "Disputed", "In Process"]
STATUS_WEIGHTS = [0.80, 0.05, 0.05, 0.02, 0.03, 0.05]
DEAL_SIZES = ["Small", "Medium", "Large"]
COUNTRIES = ["USA", "France", "Norway", "Australia", "UK", "Japan"]
FIRST_DAY = "2023-01-01"
QUANTITY_RANGE = (20, 100)
PRICE_RANGE = (50.0, 200.0)
MSRP_RANGE = (60.0, 250.0)
NOISE_RANGE = (0.9, 1.1)
CUSTOMER_RANGE = (1, 100)
DEFAULT_ROWS = 2000
DEFAULT_SEED = 42


def synthetic_orders(spark: SparkSession, n: int = DEFAULT_ROWS, seed: int = DEFAULT_SEED) -> DataFrame:
    """`n` order lines, dated within `n` days from the first day."""
    return synthetic_from(spark.range(n), "id", n, seed).drop("id")


def synthetic_from(ids: DataFrame, key: str, days: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """One made-up order line per row of `ids`, whose column `key` drives every value."""

    def draw(name: str) -> Column:
        return uniform(seed, name, F.col(key))

    def whole(name: str, low: int, high: int) -> Column:
        return (F.lit(low) + F.floor(draw(name) * (high - low))).cast("int")

    def between(name: str, bounds: tuple[float, float]) -> Column:
        return F.lit(bounds[0]) + draw(name) * (bounds[1] - bounds[0])

    def one_of(name: str, values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), whole(name, 1, len(values) + 1))

    def weighted(name: str, values: list[str], weights: list[float]) -> Column:
        choice, reached = None, 0.0
        for value, weight in zip(values[:-1], weights[:-1]):
            reached = round(reached + weight, 10)
            hit = draw(name) < reached
            choice = F.when(hit, F.lit(value)) if choice is None else choice.when(hit, F.lit(value))
        return choice.otherwise(F.lit(values[-1]))

    lines = ids.select(
        key,
        F.date_add(F.to_date(F.lit(FIRST_DAY)), whole("ORDERDATE", 0, days)).alias("ORDERDATE"),
        one_of("PRODUCTLINE", PRODUCT_LINES).alias("PRODUCTLINE"),
        weighted("STATUS", STATUSES, STATUS_WEIGHTS).alias("STATUS"),
        whole("QUANTITYORDERED", *QUANTITY_RANGE).alias("QUANTITYORDERED"),
        between("PRICEEACH", PRICE_RANGE).alias("PRICEEACH"),
        one_of("DEALSIZE", DEAL_SIZES).alias("DEALSIZE"),
        between("MSRP", MSRP_RANGE).alias("MSRP"),
        F.concat(F.lit("Customer_"), whole("CUSTOMERNAME", *CUSTOMER_RANGE)).alias("CUSTOMERNAME"),
        one_of("COUNTRY", COUNTRIES).alias("COUNTRY"),
    )
    return lines.withColumn("SALES", F.col("QUANTITYORDERED") * F.col("PRICEEACH") * between("SALES", NOISE_RANGE))
