"""Cleaning steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewise.functions.quantiles import exact_quantiles
from linewise.functions.semantics import number, numeric_columns
from linewise.session import materialize_measured


def drop_strict(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns; an unknown name is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.drop(*columns)


def drop_lenient(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop the columns that exist."""
    return df.drop(*columns)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def drop_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def null_flags(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Per column, an aggregate that tells whether it holds a NULL or NaN."""
    types = {f.name: f.dataType for f in df.schema}
    return {c: F.bool_or(number(c, types[c]).isNull()) for c in columns}


def null_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of `columns` that hold a NULL or NaN, from one scan."""
    if not columns:
        return []
    row = df.agg(*[flag.alias(c) for c, flag in null_flags(df, columns).items()]).first()
    return [c for c in columns if row[c]]


def fit_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians; a column without values has None."""
    return {c: value for (c, _), value in exact_quantiles(df, columns, [0.5]).items()}


def fill_with(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """NULL and NaN replaced by the column's value. A whole-number column that is filled becomes double."""
    types = {f.name: f.dataType for f in df.schema}
    filled = {}
    for c, value in values.items():
        if value is None:
            continue
        kept = types[c] if isinstance(types[c], (T.FloatType, T.DecimalType)) else T.DoubleType()
        filled[c] = F.coalesce(number(c, types[c]).cast(kept), F.lit(value).cast(kept))
    return df.withColumns(filled)


def median_fill(
    df: DataFrame,
    columns: list[str] | None = None,
    fit_on: DataFrame | None = None,
    with_nulls: list[str] | None = None,
) -> DataFrame:
    """Numeric NULLs replaced by the column's median over `fit_on` (default: the same rows).

    Only columns that hold a NULL (`with_nulls`, found by a scan if not given) are measured and changed;
    what remains lazy is a projection with literals.
    """
    if with_nulls is None:
        with_nulls = null_columns(df, numeric_columns(df) if columns is None else columns)
    return fill_with(df, fit_medians(df if fit_on is None else fit_on, with_nulls))


def materialize_filled(df: DataFrame, label: str, fit_part: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Write `df` once and fill its numeric NULLs with medians over `fit_part` of it (default: all of it)."""
    columns = numeric_columns(df)
    table, found = materialize_measured(df, label, **null_flags(df, columns))
    fit_on = table if fit_part is None else fit_part(table)
    return median_fill(table, fit_on=fit_on, with_nulls=[c for c in columns if found[c]])
