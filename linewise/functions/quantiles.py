"""Exact quantiles of very large columns.

The built-in exact percentile keeps every distinct value of a column in one task. Here a small mergeable sketch of each column
brackets the wanted ranks first, and only what lies inside the brackets is counted exactly:

1. `bracket` pass: a sketch of 2,048 steps a column, merged task by task, gives two values round each asked quantile;
   one aggregate row then tells how many values are below and up to each, hence whether the rank is inside.
2. `octave` pass, only for columns with a rank outside (in small tables, where a step is less than a row): 1,024
   order-preserving buckets per power of two, at most about 4.3 million per column, each of at most 2^42 representable doubles.
3. `linear` pass, only for ranks whose bracket or bucket is still large: 2^21 equal slices of it.
4. `value` pass: counts per value inside the chosen bracket, bucket or slice.

Each pass reads only the asked columns; the driver sees two rows per asked quantile, and whatever the sketch says, the
values are exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewise.functions.semantics import number

SLICES_PER_OCTAVE = 1024
LINEAR_SLICES = 2**21
# Relative rank error of a column's sketch; brackets are twice as far from the asked rank.
SKETCH_ERROR = 1 / 2048
# Buckets with at most this many rows go straight to the value pass.
SMALL_BUCKET = 1_000_000


@dataclass(frozen=True)
class _Range:
    """Closed value range known to hold some wanted ranks, counted from its lowest value."""

    column: str
    low: float
    high: float
    rows: int
    ranks: tuple[tuple[int, int], ...]  # (rank in the whole column, rank inside the range)


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], small_bucket: int = SMALL_BUCKET
) -> dict[tuple[str, float], float | None]:
    """Linearly interpolated quantiles, {(column, probability): value}; None for columns without values."""
    if not columns:
        return {}
    doubles = df.select(*[number(f.name, f.dataType).cast("double").alias(f.name) for f in df.schema if f.name in columns])

    def values(names) -> DataFrame:
        kept = doubles.select(*sorted(set(names)))
        return kept.unpivot([], kept.columns, "column", "x").where(F.col("x").isNotNull())

    totals, found, missed = _bracket_pass(doubles, probabilities)
    if missed:
        _, others = _octave_pass(values(missed), probabilities)
        found = [r for r in found if r.column not in missed] + others
    large = [r for r in found if r.low < r.high and r.rows > small_bucket]
    found = [r for r in found if r not in large] + (_linear_pass(values(r.column for r in large), large) if large else [])
    at_rank = {(r.column, rank): r.low for r in found if r.low == r.high for rank, _ in r.ranks}
    if wide := [r for r in found if r.low < r.high]:
        at_rank.update(_value_pass(values(r.column for r in wide), wide))

    result: dict[tuple[str, float], float | None] = {}
    for column in columns:
        for p in probabilities:
            if column not in totals:
                result[column, p] = None
                continue
            position = (totals[column] - 1) * p
            low, high = at_rank[column, math.floor(position)], at_rank[column, math.ceil(position)]
            result[column, p] = low if low == high else low + (high - low) * (position - math.floor(position))
    return result


def _bracket_pass(doubles: DataFrame, probabilities: list[float]) -> tuple[dict[str, int], list[_Range], set[str]]:
    """Values of each column, ranges that hold its wanted ranks, and the columns where the sketch has missed one."""
    ends = sorted({min(1.0, max(0.0, p + d)) for p in probabilities for d in (-2 * SKETCH_ERROR, 2 * SKETCH_ERROR)})
    # as an aggregate over the columns: no row is taken apart into objects
    sketch = [F.percentile_approx(f"`{c}`", ends, round(1 / SKETCH_ERROR)).alias(f"s{i}") for i, c in enumerate(doubles.columns)]
    sketched = dict(zip(doubles.columns, doubles.agg(*sketch).first()))
    brackets = {
        (c, p): tuple(marks[ends.index(min(1.0, max(0.0, p + d)))] for d in (-2 * SKETCH_ERROR, 2 * SKETCH_ERROR))
        for c, marks in sketched.items() if marks for p in probabilities
    }
    if not brackets:
        return {}, [], set()
    # one row a column and value: an aggregate over hundreds of columns would not be compiled
    cells = doubles.select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in doubles.columns])).alias("place", "x")).where(F.col("x").isNotNull())

    def bound(p: float, end: int) -> Column:
        return F.array(*[F.lit(brackets[c, p][end] if (c, p) in brackets else None).cast("double") for c in doubles.columns])[F.col("place")]

    counts = [F.count("*").alias("n")]
    for i, p in enumerate(probabilities):
        counts += [F.count_if(F.col("x") < bound(p, 0)).alias(f"below{i}"), F.count_if(F.col("x") <= bound(p, 1)).alias(f"upto{i}")]
    rows = {doubles.columns[r["place"]]: r for r in cells.groupBy("place").agg(*counts).collect()}  # one row a column
    totals = {c: r["n"] for c, r in rows.items()}
    inside, missed = [], set()
    for (c, p), (low, high) in brackets.items():
        i = probabilities.index(p)
        position, below, upto = (totals[c] - 1) * p, rows[c][f"below{i}"], rows[c][f"upto{i}"]
        for rank in {math.floor(position), math.ceil(position)}:
            if below <= rank < upto:
                inside.append((c, low, high, upto - below, rank, rank - below))
            else:
                missed.add(c)
    return totals, _ranges(inside), missed


def _octave_bucket(x: Column) -> Column:
    """Order-preserving bucket of any double: sign, then 1,024 slices per power of two."""
    offset = 1_100_000.0  # above 1,074 octaves of 1,024 slices, so magnitudes stay positive
    slice_ = F.floor(F.log2(F.abs(x)) * SLICES_PER_OCTAVE).cast("double")
    finite = F.when(F.abs(x) == float("inf"), F.lit(offset)).otherwise(slice_)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (finite + offset))


def _ranked(values: DataFrame, key: str, bucket: Column) -> DataFrame:
    """Rows per (key, bucket), with the number of rows in lower buckets of the key and in the whole key."""
    counted = values.groupBy(key, bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    in_order = Window.partitionBy(key).orderBy("bucket")
    return counted.withColumn("before", F.sum("n").over(in_order) - F.col("n")).withColumn(
        "total", F.sum("n").over(Window.partitionBy(key))
    )


_HOLDS_RANK = "before <= rank AND rank < before + n"


def _octave_pass(values: DataFrame, probabilities: list[float]) -> tuple[dict[str, int], list[_Range]]:
    picked = (
        _ranked(values, "column", _octave_bucket(F.col("x")))
        .select("*", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p"))
        .withColumn("position", (F.col("total") - 1) * F.col("p"))
        .select("*", F.explode(F.array(F.floor("position"), F.ceil("position"))).alias("rank"))
        .where(_HOLDS_RANK)
        .select("column", "low", "high", "n", "before", "total", "rank")
        .distinct()
        .collect()
    )
    totals = {row["column"]: row["total"] for row in picked}
    return totals, _ranges((r["column"], r["low"], r["high"], r["n"], r["rank"], r["rank"] - r["before"]) for r in picked)


def _ranges(rows) -> list[_Range]:
    grouped: dict[tuple, set] = {}
    for column, low, high, n, rank, inner in rows:
        grouped.setdefault((column, low, high, n), set()).add((rank, inner))
    return [_Range(*key, ranks=tuple(sorted(ranks))) for key, ranks in grouped.items()]


def _narrow(values: DataFrame, ranges: list[_Range], bucket: Column):
    """The buckets, within each range, that hold its wanted ranks: (range, bucket row, rank in the whole column).

    The ranges, at most two per asked quantile, are broadcast; `bucket` may use their `range_low`, `range_high`.
    """
    if not ranges:
        return []
    rows = [
        F.struct(
            F.lit(i).alias("range"), F.lit(r.column).alias("column"), F.lit(r.low).alias("range_low"),
            F.lit(r.high).alias("range_high"), F.array(*[F.lit(inner) for _, inner in r.ranks]).alias("wanted"),
        )
        for i, r in enumerate(ranges)
    ]
    table = values.sparkSession.range(1).select(F.inline(F.array(*rows)))
    inside = F.col("x").between(F.col("range_low"), F.col("range_high"))
    placed = values.join(F.broadcast(table.drop("wanted")), "column").where(inside)
    picked = (
        _ranked(placed, "range", bucket)
        .join(F.broadcast(table.select("range", F.explode("wanted").alias("rank"))), "range")
        .where(_HOLDS_RANK)
        .collect()
    )
    whole = [{inner: rank for rank, inner in r.ranks} for r in ranges]
    return [(ranges[row["range"]], row, whole[row["range"]][row["rank"]]) for row in picked]


def _linear_pass(values: DataFrame, ranges: list[_Range]) -> list[_Range]:
    share = (F.col("x") - F.col("range_low")) / (F.col("range_high") - F.col("range_low"))
    slice_ = F.least(F.floor(share * LINEAR_SLICES), F.lit(LINEAR_SLICES - 1))
    return _ranges(
        (source.column, row["low"], row["high"], row["n"], rank, row["rank"] - row["before"])
        for source, row, rank in _narrow(values, ranges, slice_)
    )


def _value_pass(values: DataFrame, ranges: list[_Range]) -> dict[tuple[str, int], float]:
    return {(source.column, rank): row["low"] for source, row, rank in _narrow(values, ranges, F.col("x"))}
