"""Types of text columns, found in one aggregate over the whole of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How text spells a whole number, a number, and a flag.
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
FLAGS = ["True", "TRUE", "true", "False", "FALSE", "false"]

KINDS = {"boolean": T.BooleanType(), "integer": T.LongType(), "double": T.DoubleType(), "text": T.StringType()}


def _spellings(name: str) -> dict[str, Column]:
    """Whether a cell could be of each narrower kind; NULL for a missing cell."""
    cell = F.col(f"`{name}`")
    return {
        "boolean": cell.isin(FLAGS),
        "integer": cell.rlike(WHOLE) & F.trim(cell).try_cast("bigint").isNotNull(),
        "double": cell.rlike(NUMBER),
    }


def column_kinds(text: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, kind, n_missing, n_boolean, n_integer, n_double, n_cells) of text columns, missing cells being NULL.

    Kinds form a lattice: missing only < integer < double < text, and flags < text; a column is of the least kind that all its
    cells fit. One aggregate counts the cells that fit each kind, for all columns at once, and combines before its exchange.
    As tables without missing whole numbers or flags have it, a gap turns whole numbers into doubles and flags into text;
    a column of gaps only is double. Whole numbers beyond 64 bits are doubles.
    """
    columns = text.columns if columns is None else columns
    if not columns:
        return text.sparkSession.createDataFrame([], "column_name string, kind string, n_missing bigint, n_boolean bigint, "
                                                     "n_integer bigint, n_double bigint, n_cells bigint")
    counts = [
        F.struct(F.lit(c).alias("column_name"), F.count("*").alias("n_cells"), F.count(f"`{c}`").alias("n_filled"),
                 *[F.count_if(fits).alias(f"n_{kind}") for kind, fits in _spellings(c).items()]).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    rows = text.agg(*counts).select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))])))
    whole, filled = F.col("n_filled") == F.col("n_cells"), F.col("n_filled")
    kind = (
        F.when(filled == 0, "double")
        .when(whole & (F.col("n_boolean") == filled), "boolean")
        .when(whole & (F.col("n_integer") == filled), "integer")
        .when(F.col("n_double") == filled, "double")
        .otherwise("text")
    )
    return rows.select("column_name", kind.alias("kind"), (F.col("n_cells") - filled).alias("n_missing"),
                       "n_boolean", "n_integer", "n_double", "n_cells")


def infer_kinds(text: DataFrame, columns: list[str] | None = None) -> dict[str, T.DataType]:
    """Type of each text column, from one row a column."""
    return {r["column_name"]: KINDS[r["kind"]] for r in column_kinds(text, columns).collect()}


def with_kinds(text: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    """The columns of `kinds` cast from text; blanks round a number don't count."""
    return text.withColumns({c: F.trim(F.col(f"`{c}`")).cast(k) for c, k in kinds.items() if not isinstance(k, T.StringType)})
