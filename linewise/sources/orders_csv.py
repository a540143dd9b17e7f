"""Order lines from CSV files, and predictions to CSV or Parquet files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewise.functions.semantics import null_tokens
from linewise.schema import NULL_TOKENS, ORDER_LINE_TYPES
from linewise.session import materialize_measured
from linewise.sources.inference import infer_kinds, with_kinds

REJECT_REASON = "_BAD_COLUMNS"
RAW_RECORD = "_RECORD"
# Stands among the bad columns for a record with too many or too few cells.
BAD_SHAPE = "_CELLS"


def normalise_header(df: DataFrame) -> DataFrame:
    """Column names trimmed and in upper case."""
    return df.toDF(*[name.upper().strip() for name in df.columns])


def read_orders_csv(
    spark: SparkSession,
    path: str | list[str],
    types: dict[str, T.DataType] | None = None,
    mode: str = "strict",
    encoding: str = "ISO-8859-1",
    tidy_header: bool = True,
    multi_line: bool = True,
    infer: bool = False,
) -> DataFrame:
    """CSV with a header row; columns are found by name, in any order.

    Every cell is read as text. Columns without a type of their own stay text, unless `infer` finds their types in one more
    pass over the file (`inference.column_kinds`). Known columns are cast:
    `strict` fails on a bad cell, `keep` makes it NULL and lists its column in `_BAD_COLUMNS`
    (see `split_rejects`). A record with more or fewer cells than the header fails too, or has `_CELLS` among its bad
    columns; `_RECORD` then holds its raw text. This also holds if only some columns are asked for. Files of one load
    must agree on their header. `multi_line` allows line breaks inside quotes, at the price of files that cannot be split
    between tasks: turn it off only for files that are known to have none.
    """
    if mode not in ("strict", "keep"):
        raise ValueError(f"mode must be 'strict' or 'keep', not {mode!r}")
    types = ORDER_LINE_TYPES if types is None else types

    def reader():
        return spark.read.options(header=True, encoding=encoding, escape='"', enforceSchema=False, multiLine=multi_line)

    header = reader().csv(path).columns
    cells = T.StructType([T.StructField(name, T.StringType()) for name in header])
    if mode == "strict":
        raw = reader().options(mode="FAILFAST", columnPruning=False).schema(cells).csv(path)
        text = null_tokens(normalise_header(raw) if tidy_header else raw, NULL_TOKENS)
        found = infer_kinds(text, [c for c in text.columns if c not in types]) if infer else {}
        return with_kinds(text.select(*[_cast(c, types.get(c), strict=True).alias(c) for c in text.columns]), found)
    raw = reader().options(columnPruning=False, columnNameOfCorruptRecord=RAW_RECORD).schema(cells.add(RAW_RECORD, T.StringType())).csv(path)
    record, raw = F.col(RAW_RECORD), normalise_header(raw) if tidy_header else raw
    cleared = [c for c in raw.columns if c != RAW_RECORD]
    text = raw.select(*[F.when(~F.col(c).isin(NULL_TOKENS), F.col(c)).alias(c) for c in cleared], RAW_RECORD)
    typed = [c for c in cleared if c in types]
    bad = [F.when(F.col(c).isNotNull() & _cast(c, types[c], strict=False).isNull(), F.lit(c)) for c in typed]
    reasons = F.array_compact(F.array(F.when(record.isNotNull(), F.lit(BAD_SHAPE)), *bad))
    # a record whose cells don't fit the header says nothing about the columns' types
    found = infer_kinds(text.where(record.isNull()), [c for c in cleared if c not in types]) if infer else {}
    guessed = {c: k for c, k in found.items() if not isinstance(k, T.StringType)}
    return text.select(
        *[F.trim(F.col(c)).try_cast(guessed[c]).alias(c) if c in guessed else _cast(c, types.get(c), strict=False).alias(c) for c in cleared],
        reasons.alias(REJECT_REASON), RAW_RECORD,
    )


def _cast(name: str, data_type: T.DataType | None, strict: bool) -> Column:
    column = F.col(name)
    if data_type is None:
        return column
    if isinstance(data_type, T.IntegralType):
        # "12.0" is a whole number too
        column = column.cast("double") if strict else column.try_cast("double")
    return column.cast(data_type) if strict else column.try_cast(data_type)


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their bad columns and, if their cells don't fit the header, raw text) of a `keep` load."""
    good = df.where(F.size(REJECT_REASON) == 0).drop(REJECT_REASON, RAW_RECORD)
    return good, df.where(F.size(REJECT_REASON) > 0)


def load_or_none(spark: SparkSession, path: str | list[str], report=print, **options) -> DataFrame | None:
    """Guarded load: a file that cannot be opened is reported and gives None.

    Only the header is touched here; bad cells show when the rows are used (or use `mode="keep"`).
    """
    try:
        return read_orders_csv(spark, path, **options)
    except Exception as error:  # the caller decides what a failed load means
        report(f"cannot load {path}: {error}")
        return None


@dataclass(frozen=True)
class Load:
    """What became of a guarded load: its rows, or None, and what was wrong with the files."""

    rows: DataFrame | None
    n_rows: int
    n_bad_shape: int
    bad_cells: dict[str, int]
    error: str | None

    @property
    def report(self) -> str:
        if self.error:
            return self.error
        wrong = [f"{n} bad cells in {c}" for c, n in self.bad_cells.items()]
        wrong += [f"{self.n_bad_shape} records whose cells don't fit the header"] if self.n_bad_shape else []
        return ", ".join(wrong) or f"{self.n_rows} rows"


def load_guarded(spark: SparkSession, path: str | list[str], report=print, **options) -> Load:
    """Guarded load of the whole of its files: any bad cell, bad record or unreadable file is reported and gives no rows.

    Rows are written while they are read, as every later step would read them again, and an observation on the way says whether
    any of them is bad. Only then is the written table counted, a few narrow columns of it, by column. Good rows are those
    of the written table: no bad cell can turn up later. A read that fails (no file, headers that differ, a broken encoding)
    fails here and not in a later step.
    """
    try:
        kept = read_orders_csv(spark, path, mode="keep", **options)
        is_bad = F.size(REJECT_REASON) > 0
        written, seen = materialize_measured(kept, "load", n_rows=F.count("*"), bad=F.coalesce(F.max(is_bad), F.lit(False)))
    except Exception as error:  # the caller decides what a failed load means
        report(f"cannot load {path}: {error}")
        return Load(None, 0, 0, {}, str(error))
    if not seen["bad"]:
        return Load(written.drop(REJECT_REASON, RAW_RECORD), written.count(), 0, {}, None)
    reasons = written.select(F.explode_outer(REJECT_REASON).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    bad = {r["reason"]: r["n"] for r in reasons.collect() if r["reason"] is not None}  # one row a column
    load = Load(None, written.count(), bad.pop(BAD_SHAPE, 0), dict(sorted(bad.items())), None)
    report(f"cannot load {path}: {load.report}")
    return load


def write_predictions(predictions: DataFrame, path: str, fmt: str = "csv") -> None:
    """Actual and predicted values of one model, written in parallel."""
    # Column names of the exported file.
    out = predictions.select(F.col("label").alias("Actual_Sales"), F.col("prediction").alias("Predicted_Sales"))
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
