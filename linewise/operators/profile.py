"""Table profiles. Statistics of all columns share one scan and one partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewise.functions.quantiles import exact_quantiles
from linewise.functions.semantics import number, numeric_columns
from linewise.schema import ROW_KEY
from linewise.session import TIGHT, materialize

QUARTILES = [0.25, 0.5, 0.75]


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


def head_rows(df: DataFrame, n: int = 5, order: str = ROW_KEY) -> DataFrame:
    """First rows in key order: files have no order of their own."""
    return df.orderBy(order).limit(n)


def _per_column(df: DataFrame, stat, value: str) -> DataFrame:
    """One long row per column from one wide aggregate row."""
    wide = df.agg(*[stat(f).alias(f.name) for f in df.schema])
    return wide.unpivot([], df.columns, "column_name", value)


def non_null_profile(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    counted = _per_column(df, lambda f: F.count(number(f.name, f.dataType)), "non_null")
    kind = F.coalesce(*[F.when(F.col("column_name") == c, F.lit(kinds[c])) for c in df.columns])
    return counted.select("column_name", kind.alias("data_type"), "non_null")


def null_counts(df: DataFrame) -> DataFrame:
    return _per_column(df, lambda f: F.count_if(number(f.name, f.dataType).isNull()), "n_null")


def null_total(df: DataFrame) -> DataFrame:
    return null_counts(df).agg(F.sum("n_null").alias("n_null"))


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct non-null values per column.

    Exact: (column, value) pairs are de-duplicated before and after one exchange, so a value that fills a
    third of a column travels once per task. `approx` keeps one sketch per column instead and moves no values.
    """
    if approx:
        return _per_column(df, lambda f: F.approx_count_distinct(number(f.name, f.dataType)), "n_distinct")
    # adding zero makes -0.0 and 0.0 one value
    fractions = (T.DoubleType, T.FloatType)
    values = [number(f.name, f.dataType) + F.lit(0.0) if isinstance(f.dataType, fractions) else F.col(f.name) for f in df.schema]
    cells = df.select(*[v.cast("string").alias(c) for v, c in zip(values, df.columns)])
    return (
        cells.unpivot([], df.columns, "column_name", "cell")
        .distinct()
        .groupBy("column_name")
        .agg(F.count("cell").alias("n_distinct"))
    )


def describe_numeric(df: DataFrame, columns: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per numeric column."""
    columns = numeric_columns(df) if columns is None else columns
    df = materialize(df.select(*columns), "numbers", TIGHT)  # several passes follow
    types = {f.name: f.dataType for f in df.schema}
    quartile = exact_quantiles(df, columns, QUARTILES)

    # one row a column and value: an aggregate over hundreds of columns would not be compiled
    cells = df.select(F.posexplode(F.array(*[number(c, types[c]).cast("double") for c in columns])).alias("place", "x"))
    every = df.sparkSession.createDataFrame([(i,) for i in range(len(columns))], "place int")  # those of an empty table too
    found = cells.groupBy("place").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    of = lambda values: F.array(*[F.lit(v) for v in values])[F.col("place")]
    quartiles = {f"q{int(p * 100)}": of([quartile[c, p] for c in columns]).cast("double") for p in QUARTILES}
    shown = {k: quartiles.get(k, F.col(k)) for k in ("mean", "std", "min", *quartiles, "max")}
    rounded = {k: F.round(v, digits) if digits is not None else v for k, v in shown.items()}
    rows = every.join(F.broadcast(found), "place", "left")  # one row a column
    return rows.select(of(columns).alias("column_name"), F.coalesce("n", F.lit(0)).alias("count"), *[v.alias(k) for k, v in rounded.items()])
