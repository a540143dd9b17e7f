"""Derived columns: prices, dates, customer and product statistics, interactions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewise.functions.semantics import exact_mean, exact_sum, safe_div
from linewise.schema import CANDIDATE_FORMATS, COST_SHARE, DATE_FORMATS, SHIPPED

GROUP_ROWS = "_GROUP_ROWS"


def price_features(df: DataFrame) -> DataFrame:
    """Margin under the assumed cost share, discount from list price, revenue per unit."""
    cost = F.col("QUANTITYORDERED") * (F.col("PRICEEACH") * COST_SHARE)
    return df.withColumns(
        {
            "PROFIT_MARGIN": safe_div(F.col("SALES") - cost, F.col("SALES")),
            "PRICE_DISCOUNT": safe_div(F.col("MSRP") - F.col("PRICEEACH"), F.col("MSRP")),
            "REVENUE_PER_UNIT": safe_div(F.col("SALES"), F.col("QUANTITYORDERED")),
        }
    )


def quantity_times_price() -> Column:
    return F.col("QUANTITYORDERED") * F.col("PRICEEACH")


def shipped_msrp() -> Column:
    """List price of shipped lines, 0 for any other or missing status."""
    return F.col("STATUS").eqNullSafe(SHIPPED).cast("int") * F.col("MSRP")


def interaction_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"QTY_PRICE_INTERACTION": quantity_times_price(), "STATUS_MSRP_RATIO": shipped_msrp()})


def parse_dates(df: DataFrame, column: str, strict: bool, formats: list[str] | None = None) -> DataFrame:
    """Text to timestamp without zone, by the first format that fits.

    Text that fits none fails the query when `strict`, else becomes NULL. Date columns are only widened.
    """
    source = df.schema[column].dataType
    if not isinstance(source, T.StringType):
        return df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    tried = F.coalesce(*[F.try_to_timestamp(F.col(column), F.lit(f)) for f in formats or DATE_FORMATS])
    parsed = tried.cast("timestamp_ntz")
    if strict:
        complaint = F.concat(F.lit(f"{column} is not a date: "), F.col(column))
        parsed = F.when(F.col(column).isNotNull() & tried.isNull(), F.raise_error(complaint).cast("timestamp_ntz")).otherwise(
            parsed
        )
    return df.withColumn(column, parsed)


@dataclass(frozen=True)
class DateFormat:
    """The format found for a text column: how many of its cells it fits, and the formats that fit as many but mean other days."""

    format: str | None
    n_fit: int
    n_text: int
    ambiguous: list[str]


def format_counts(df: DataFrame, column: str, formats: list[str] | None = None) -> DataFrame:
    """(format, place, n_fit, n_unlike, n_text): for each candidate the cells it fits, and those of them that a format before it
    in the list reads as another time. One aggregate tries all candidates on the whole column."""
    formats = CANDIDATE_FORMATS if formats is None else formats
    text, n = F.col(column), len(formats)
    times = df.select(text.alias("text"), F.array(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).alias("t"))

    def unlike(i: int) -> Column:
        earlier = F.coalesce(*[F.col("t")[j] for j in range(i)]) if i else F.lit(None).cast("timestamp")
        return F.count_if(F.col("t")[i] != earlier)

    counted = times.agg(
        F.array(*[F.count(F.col("t")[i]) for i in range(n)]).alias("fit"), F.array(*[unlike(i) for i in range(n)]).alias("other"),
        F.count("text").alias("n_text"))
    rows = F.arrays_zip(F.array(*[F.lit(f) for f in formats]).alias("format"), F.col("fit"), F.col("other"))
    return counted.select("n_text", F.posexplode(rows).alias("place", "row")).select(
        F.col("row.format").alias("format"), "place", F.col("row.fit").alias("n_fit"), F.col("row.other").alias("n_unlike"), "n_text")


def discover_format(df: DataFrame, column: str, formats: list[str] | None = None, report=print) -> DateFormat:
    """The format that fits most cells, of equals the first: month before day. If one that fits as many reads some of them as other
    days, all cells have a day up to 12, and that is reported."""
    rows = sorted(format_counts(df, column, formats).collect(), key=lambda r: (-r["n_fit"], r["place"]))  # one row a format
    best = rows[0]
    if not best["n_fit"]:
        return DateFormat(None, 0, best["n_text"], [])
    rivals = [r["format"] for r in rows[1:] if r["n_fit"] == best["n_fit"] and r["n_unlike"]]
    if rivals:
        report(f"{column}: {best['format']} and {', '.join(rivals)} fit alike and mean different days; {best['format']} is taken")
    return DateFormat(best["format"], best["n_fit"], best["n_text"], rivals)


def parse_discovered(df: DataFrame, column: str, strict: bool, formats: list[str] | None = None, report=print) -> DataFrame:
    """`parse_dates` with the one format that is found for the whole column; without any that fits, all cells count as bad."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return parse_dates(df, column, strict)
    formats = CANDIDATE_FORMATS if formats is None else formats
    found = discover_format(df, column, formats, report)
    return parse_dates(df, column, strict, [found.format or formats[0]])


# Part name -> expression of a date column; weekdays count from Monday = 0, weeks are ISO weeks.
DATE_PARTS = {
    "YEAR": F.year,
    "QUARTER": F.quarter,
    "MONTH": F.month,
    "DAY_OF_WEEK": F.weekday,
    "DAY_OF_MONTH": F.dayofmonth,
    "WEEK_OF_YEAR": F.weekofyear,
}


def date_parts(df: DataFrame, column: str, parts: list[str]) -> DataFrame:
    return df.withColumns({p: DATE_PARTS[p](column).cast("int") for p in parts})


def customer_stats(df: DataFrame) -> DataFrame:
    """Per customer: lines, sales total and mean, quantity total."""
    return _stats(
        df,
        "CUSTOMERNAME",
        CUSTOMER_ORDER_COUNT=F.count("ORDERNUMBER"),
        CUSTOMER_TOTAL_SALES=exact_sum("SALES"),
        CUSTOMER_AVG_SALES=exact_mean("SALES"),
        CUSTOMER_TOTAL_QTY=exact_sum("QUANTITYORDERED"),
    )


def customer_stats_dashboard(df: DataFrame) -> DataFrame:
    """Per customer: mean, total and count of sales values."""
    return _stats(
        df,
        "CUSTOMERNAME",
        CUST_AVG_SALES=exact_mean("SALES"),
        CUST_TOTAL_SALES=exact_sum("SALES"),
        CUST_ORDER_COUNT=F.count("SALES"),
    )


def product_stats(df: DataFrame) -> DataFrame:
    """Per product line: sales mean and total, quantity mean."""
    return _stats(
        df,
        "PRODUCTLINE",
        PRODUCTLINE_AVG_SALES=exact_mean("SALES"),
        PRODUCTLINE_TOTAL_SALES=exact_sum("SALES"),
        PRODUCTLINE_AVG_QTY=exact_mean("QUANTITYORDERED"),
    )


def product_stats_dashboard(df: DataFrame) -> DataFrame:
    """Per product line: mean sales value."""
    return _stats(df, "PRODUCTLINE", PROD_AVG_SALES=exact_mean("SALES"))


def _stats(df: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """Aggregates per known key, and how many rows have the key (what `attach` uses to find hot keys)."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[a.alias(name) for name, a in aggregates.items()], F.count("*").alias(GROUP_ROWS))
    )
