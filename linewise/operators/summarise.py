"""Grouped totals, shares, histograms, rankings and key figures.

Rows without a group key are left out of grouped results. Every grouping uses partial aggregation,
so a key that holds a third of the rows reaches the exchange as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.functions.semantics import exact_mean, exact_sum, number, safe_div
from linewise.schema import ROW_KEY
from linewise.session import materialize, materialize_measured


def _grouped(df: DataFrame, keys: list[str]):
    return df.na.drop(subset=keys).groupBy(*keys)


def total_by(df: DataFrame, keys: list[str], value: str, name: str, descending: bool = False) -> DataFrame:
    """Sum of `value` per key; largest first, or in key order."""
    out = _grouped(df, keys).agg(exact_sum(value).alias(name))
    return out.orderBy(F.desc(name), *keys) if descending else out.orderBy(*keys)


def mean_by(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return _grouped(df, keys).agg(exact_mean(value).alias(name)).orderBy(*keys)


def share_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum of `value` per key and its share of the sum over all keys.

    The sums are written, so the whole is their sum and the lines are scanned once.
    """
    sums = materialize(_grouped(df, [key]).agg(exact_sum(value).alias("total")), "sums")
    whole = sums.agg(exact_sum("total").alias("whole")).first()["whole"]
    return sums.select(key, "total", safe_div(F.col("total"), F.lit(whole)).alias("share"))


def kpis(df: DataFrame) -> DataFrame:
    """Revenue, mean line value, number of lines, number of known customers (NULL without that column)."""
    revenue = exact_sum("SALES")
    customers = F.count_distinct("CUSTOMERNAME") if "CUSTOMERNAME" in df.columns else F.lit(None).cast("bigint")
    return df.agg(
        revenue.alias("total_revenue"),
        F.round(revenue / 1e6, 2).alias("revenue_millions"),
        exact_mean("SALES").alias("mean_line_value"),
        F.count("*").alias("line_count"),
        customers.alias("unique_customers"),
    )


def value_range(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("correlation"))


def written_with_bounds(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """`df` written, with the lowest and highest value per column seen on the way; a single value gets half a unit on
    each side."""
    ends = {f"{f.__name__}_{c}": f(number(c)).cast("double") for c in columns for f in (F.min, F.max)}
    table, row = materialize_measured(df, "values", **ends)
    out = {}
    for c in columns:
        low, high = row[f"min_{c}"], row[f"max_{c}"]
        out[c] = (low - 0.5, high + 0.5) if low is not None and low == high else (low, high)
    return table, out


def bin_of(x: Column, bounds: tuple[float, float], bins: int) -> Column:
    """Equal-width bin; the last one is closed on the right. Edges are low + i * width, and a value that
    rounding put on the wrong side of its edge is moved by one."""
    if bounds[0] is None:
        return F.lit(None).cast("int")
    low, high = F.lit(bounds[0]), F.lit(bounds[1])
    width = (high - low) / bins
    first = F.least(F.floor((x - low) * (bins / (high - low))), F.lit(bins - 1))
    moved = F.when(x < low + first * width, first - 1).when(
        (first < bins - 1) & (x >= low + (first + 1) * width), first + 1
    )
    return F.coalesce(moved, first).cast("int")


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, n) for every bin, empty ones too."""
    values = df.select(number(value).alias("x")).where(F.col("x").isNotNull())
    values, found = written_with_bounds(values, ["x"])
    bounds = found["x"]
    counts = values.groupBy(bin_of(F.col("x"), bounds, bins).alias("bin")).agg(F.count("*").alias("n"))
    low, high = (F.lit(b).cast("double") for b in bounds)
    width = (high - low) / bins
    frame = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (low + F.col("id") * width).alias("low"),
        F.when(F.col("id") == bins - 1, high).otherwise(low + (F.col("id") + 1) * width).alias("high"),
    )
    # one row per bin
    filled = frame.join(F.broadcast(counts), "bin", "left")
    return filled.select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def point_set(df: DataFrame, columns: list[str]) -> DataFrame:
    """Points of a scatter chart, one per row."""
    return df.select(*columns)


def grid_counts(df: DataFrame, x: str, y: str, bins: int = 50, by: list[str] | None = None) -> DataFrame:
    """Scatter chart of any size: rows per cell of a bins x bins grid, optionally per further key."""
    points = df.select(number(x).alias("x"), number(y).alias("y"), *(by or [])).na.drop(subset=["x", "y"])
    points, bounds = written_with_bounds(points, ["x", "y"])
    cells = [bin_of(F.col(c), bounds[c], bins).alias(f"{c}_bin") for c in ("x", "y")]
    return points.groupBy(*cells, *(by or [])).agg(F.count("*").alias("n"))


def top_n(df: DataFrame, order: str, n: int, columns: list[str], tie: list[str] | None = None) -> DataFrame:
    """The n rows with the largest `order`; ties by key. Each task keeps n rows only."""
    return df.orderBy(F.desc(order), *(tie or [ROW_KEY])).limit(n).select(*columns)


def options(df: DataFrame, column: str) -> DataFrame:
    """Values to choose from, a missing one included."""
    return df.select(column).distinct().orderBy(column)
