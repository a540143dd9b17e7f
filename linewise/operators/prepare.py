"""Model inputs: category codes, splits, folds, scaling, vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewise.functions.semantics import hash_bucket, label_text, number, safe_div
from linewise.operators.lookup import attach, measures
from linewise.schema import ROW_KEY
from linewise.session import materialize

SPLIT_PARTS = 10
TEST_PARTS = 2
FOLDS = 5


def fit_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, label, code, n): the rank of every label among its column's sorted labels, from 0.

    The labels are counted, sorted over all tasks and written with their position inside their task; the
    number of labels in earlier tasks completes the rank. No task ranks a whole column.
    """
    labels = (
        df.select(*[label_text(c).alias(c) for c in columns])
        .unpivot([], columns, "column_name", "label")
        .groupBy("column_name", "label")
        .agg(F.count("*").alias("n"))
    )
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_labels = materialize(
        labels.orderBy("column_name", "label").select("*", F.spark_partition_id().alias("task"), within.alias("seat")),
        "labels",
    )
    # one row per task of the sort
    seats = sorted_labels.groupBy("task").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = seats.select("task", before.alias("start"))
    placed = sorted_labels.join(F.broadcast(starts), "task").withColumn("place", F.col("start") + F.col("seat"))
    first = placed.groupBy("column_name").agg(F.min("place").alias("first_place"))
    codes = placed.join(F.broadcast(first), "column_name").select(
        "column_name", "label", (F.col("place") - F.col("first_place")).cast("int").alias("code"), "n"
    )
    return materialize(codes, "codes")


def encode(df: DataFrame, codes: DataFrame, columns: list[str]) -> DataFrame:
    """Categories replaced by their fitted codes; a label not seen when fitting gives NULL."""
    lookups = codes.select("column_name", F.col("label").alias("_label"), F.col("code").alias("_code"), F.col("n").alias("_n"))
    sizes = lookups.groupBy("column_name").agg(*[m.alias(k) for k, m in measures(lookups, ["_label"], "_n").items()])
    measured = {row["column_name"]: row.asDict() for row in sizes.collect()}  # one row per column
    for c in columns:
        lookup = lookups.where(F.col("column_name") == c).drop("column_name")
        marked = df.withColumn("_label", label_text(c))
        size = measured.get(c, {"size": 0, "lines": 0})
        coded = attach(marked, lookup, ["_label"], rows="_n", measured=size)
        df = coded.select(*[F.col("_code").alias(c) if name == c else F.col(name) for name in df.columns])
    return df


def class_counts(codes: DataFrame) -> DataFrame:
    return codes.groupBy("column_name").agg(F.count("*").alias("n_classes"))


def with_split(df: DataFrame, key: str = ROW_KEY) -> DataFrame:
    """Adds `split`: about 80 % train, 20 % test, decided by the row key alone."""
    is_train = hash_bucket(key, SPLIT_PARTS) < SPLIT_PARTS - TEST_PARTS
    return df.withColumn("split", F.when(is_train, "train").otherwise("test"))


def split_ratio(df: DataFrame) -> DataFrame:
    counted = df.agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test")
    )
    return counted.select("n_train", "n_test", safe_div(F.col("n_train"), F.col("n_test")).alias("ratio"))


def with_fold(df: DataFrame, k: int = FOLDS, key: str = ROW_KEY) -> DataFrame:
    """Adds `fold`, 0..k-1, from other digits of the key's hash than the split: folds of the train part are of equal size."""
    return df.withColumn("fold", hash_bucket(key, k, first=9))


def _order(key: str, first: int) -> Column:
    """The key's place in a fixed shuffle: 32 bits of its hash; equal ones go by the key itself."""
    return F.conv(F.substring(F.md5(F.col(key).cast("binary")), first, 8), 16, 10).cast("bigint")


def shuffled_cuts(df: DataFrame, key: str, shares: Callable[[int], list[int]], first: int = 1) -> list[tuple[int, str]]:
    """The (hash, key) that stand at some ranks when the rows are sorted by the hash of their key; `shares` gives the
    ranks, from 1, for the number of rows.

    No rows are sorted: rows are counted by the upper half of the hash, those of the halves that hold a rank by the whole
    hash, and those of the hash found by key. The driver sees 65,536 counts, and as many again for each rank.
    """
    keys = materialize(df.select(_order(key, first).alias("hash"), F.col(key).cast("string").alias("key")), "keys")

    def place(counted: DataFrame, ranks: list[int]) -> list[tuple]:
        """For each rank the value that holds it, and the rank among the rows of this value."""
        rows, found, before, at = counted.collect(), [], 0, 0
        for value, n in sorted((r["value"], r["n"]) for r in rows):
            while at < len(ranks) and ranks[at] <= before + n:
                found.append((value, ranks[at] - before))
                at += 1
            before += n
        return found

    by = lambda rows, value: rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    upper = F.shiftright("hash", 16)
    halves = by(keys, upper)
    ranks = shares(halves.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    cuts = []
    for (half, inner), rank in zip(place(halves, ranks), ranks):
        (whole, inner), = place(by(keys.where(upper == half), F.col("hash")), [inner])
        (last, _), = place(by(keys.where(F.col("hash") == whole), F.col("key")), [inner])
        cuts.append((whole, last))
    return cuts


def _up_to(key: str, cut: tuple[int, str], first: int) -> Column:
    order = _order(key, first)
    return (order < cut[0]) | ((order == cut[0]) & (F.col(key).cast("string") <= cut[1]))


def exact_splitter(df: DataFrame, key: str = ROW_KEY) -> Callable[[DataFrame], DataFrame]:
    """Adds `split` like `with_split`, with a test part of exactly 20 % of the rows of `df`, rounded up.

    Fitted as one cut through the shuffled keys; applying it is a projection. Row keys are unique; rows that share one
    stay together. Rows without a key are in the test part."""
    cuts = shuffled_cuts(df.where(F.col(key).isNotNull()), key, lambda n: [-(-n * TEST_PARTS // SPLIT_PARTS)] if n else [])
    is_test = F.coalesce(_up_to(key, cuts[0], 1), F.lit(True)) if cuts else F.lit(True)
    return lambda rows: rows.withColumn("split", F.when(is_test, "test").otherwise("train"))


def exact_folder(df: DataFrame, k: int = FOLDS, key: str = ROW_KEY) -> Callable[[DataFrame], DataFrame]:
    """Adds `fold`, 0..k-1, like `with_fold`: the folds of `df` differ in size by one row at most, the first being the larger."""

    def ends(n: int) -> list[int]:
        sizes = [n // k + (f < n % k) for f in range(k)]
        return [sum(sizes[: f + 1]) for f in range(k - 1)] if n >= k else list(range(1, n))

    cuts = shuffled_cuts(df.where(F.col(key).isNotNull()), key, ends, first=9)
    fold = F.lit(len(cuts))
    for f in reversed(range(len(cuts))):
        fold = F.when(_up_to(key, cuts[f], 9), f).otherwise(fold)
    return lambda rows: rows.withColumn("fold", fold.cast("int"))


def fit_scale(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, from one aggregate row; a zero deviation counts as 1."""
    row = df.agg(
        *[F.avg(number(c)).alias(f"m_{c}") for c in columns], *[F.stddev_pop(number(c)).alias(f"s_{c}") for c in columns]
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - mean) / deviation for c, (mean, deviation) in fitted.items()})


def standardise(df: DataFrame, columns: list[str], fit_on: DataFrame) -> DataFrame:
    doubles = {c: F.col(c).cast("double") for c in columns}
    return scale(df.withColumns(doubles), fit_scale(fit_on.withColumns(doubles), columns))


def assemble(df: DataFrame, columns: list[str], label: str, keep: list[str]) -> DataFrame:
    """`features` vector and `label`, next to the kept columns. Codes stay ordered numbers: no category metadata."""
    vectors = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error")
    return vectors.transform(df).select(*keep, "features", F.col(label).cast("double").alias("label"))
