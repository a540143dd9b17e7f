"""Column expressions that settle null, zero, rounding and key rules once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewise.schema import MISSING_LABEL

# Amounts are summed as decimals of ten places: exact, and the same whatever order tasks finish in.
AMOUNT = "decimal(38,10)"


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero or either side is NULL."""
    return F.try_divide(a, b)


def number(col: str, data_type: T.DataType | None = None) -> Column:
    """The column with NaN turned into NULL; other types pass through."""
    if data_type is None or isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), F.col(col))
    return F.col(col)


def exact_sum(col: str) -> Column:
    """Sum of an amount as DECIMAL, so the result does not depend on task order; 0.0 for no values.

    NaN is a missing value; an infinite value makes the sum infinite (NaN if both signs occur)."""
    size = F.abs(F.col(col).cast("double"))
    finite = F.sum(F.when(size < float("inf"), F.col(col).cast(AMOUNT)))
    endless = F.sum(F.when(size == float("inf"), F.col(col).cast("double")))
    return F.coalesce(endless, F.coalesce(finite, F.lit(0).cast(AMOUNT)).cast("double"))


def exact_mean(col: str) -> Column:
    """Mean from `exact_sum` over the values that it sums; NULL for no values."""
    return safe_div(exact_sum(col), F.count(F.when(~F.isnan(F.col(col).cast("double")), F.col(col))).cast("double"))


def label_text(col: str) -> Column:
    """Category as text, with missing values as their own category."""
    return F.coalesce(F.col(col).cast("string"), F.lit(MISSING_LABEL))


def hash_bucket(key: str, buckets: int, first: int = 1) -> Column:
    """Bucket 0..buckets-1 from the row key alone: same on any partitioning, retry or engine.

    Eight hexadecimal digits of the key's md5 from the `first` decide; buckets from other digits are independent."""
    digits = F.conv(F.substring(F.md5(F.col(key).cast("binary")), first, 8), 16, 10).cast("bigint")
    return F.pmod(digits, F.lit(buckets)).cast("int")


def uniform(seed: int, name: str, key: Column) -> Column:
    """Repeatable number in [0, 1) for (seed, name, key)."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(name), key.cast("string"))
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def null_tokens(df: DataFrame, tokens: list[str]) -> DataFrame:
    """Text cells that spell a missing value become NULL."""
    texts = set(text_columns(df))
    return df.select(
        *[F.when(~F.col(c).isin(tokens), F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns]
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[number(f.name, f.dataType).alias(f.name) for f in df.schema])
