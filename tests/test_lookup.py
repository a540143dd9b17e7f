import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from linewise.operators.lookup import attach


@pytest.fixture(scope="module")
def lines(spark):
    """A third of the lines share one key, a fifth have none."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 5 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 2000).cast("string"))
    )
    return spark.range(30_000).select(F.col("id").cast("string").alias("ROW_KEY"), key.alias("key"), F.col("id").alias("v"))


def stats(df):
    return df.where(F.col("key").isNotNull()).groupBy("key").agg(F.sum("v").alias("total"), F.count("*").alias("rows"))


def plan(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_small_lookup_is_broadcast(spark, lines):
    out = attach(lines, stats(lines), ["key"], rows="rows")
    assert "Exchange hashpartitioning" not in plan(out)
    assert out.columns == ["ROW_KEY", "key", "v", "total", "rows"]


def test_large_lookup_gives_the_same_rows(spark, lines):
    small = attach(lines, stats(lines), ["key"], rows="rows")
    large = attach(lines, stats(lines), ["key"], rows="rows", broadcast_bytes=0)
    assert "_slot" in plan(large)
    assert large.count() == lines.count() == small.count()
    assert small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()
    assert large.where("key IS NULL AND total IS NOT NULL").isEmpty()


def test_hot_and_missing_keys_are_spread(spark, lines):
    """In the exchange of the large path, no partition gets a third of the rows."""
    previous = spark.conf.get("spark.sql.adaptive.enabled")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = attach(lines, stats(lines), ["key"], rows="rows", broadcast_bytes=0)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", previous)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum(sizes) == 30_000 and max(sizes) < 10_000


def test_many_middling_keys_and_a_constant_first_column(spark):
    """Keys just below a thousandth of the lines, and lines without a key behind a constant first column, are spread."""
    key = F.when(F.col("id") % 2 == 0, F.concat(F.lit("m"), (F.col("id") % 1200).cast("string"))).when(F.col("id") % 3 == 0, "hot")
    lines = spark.range(60_000).select(F.lit(1).alias("constant"), key.alias("key"), F.col("id").alias("v"))
    previous, threshold = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = attach(lines, stats(lines), ["key"], rows="rows", broadcast_bytes=0)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", previous)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum(sizes) == 60_000 and max(sizes) < 2 * 60_000 / 4


def test_unmatched_and_empty(spark, lines):
    nothing = stats(lines).where("1 = 0")
    out = attach(lines, nothing, ["key"], rows="rows")
    assert out.count() == lines.count() and out.where("total IS NOT NULL").isEmpty()


def test_two_keys(spark, lines):
    two = lines.withColumn("fold", F.col("v") % 4)
    per = two.where("key IS NOT NULL").groupBy("key", "fold").agg(F.max("v").alias("top"), F.count("*").alias("rows"))
    a = attach(two, per, ["key", "fold"], rows="rows")
    b = attach(two, per, ["key", "fold"], rows="rows", broadcast_bytes=0)
    assert a.exceptAll(b).isEmpty() and b.count() == two.count()
