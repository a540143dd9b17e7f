"""The keyed store: found again, told apart, raced, left half written, swept."""

from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from linewise.operators import models, prepare
from linewise.session import scratch_path
from linewise.store import Store, files_state, plan_text


@pytest.fixture
def store(spark):
    return Store(spark, scratch_path(spark, "store"))


@pytest.fixture
def numbers(spark, tmp_path):
    path = f"{tmp_path}/numbers"
    spark.range(100).select("id", (F.col("id") % 7).alias("g")).write.parquet(path)
    return path


class Counted:
    """A build step that says how often it was called."""

    def __init__(self):
        self.calls = 0

    def __call__(self, rows):
        self.calls += 1
        return rows.groupBy("g").agg(F.sum("id").alias("total"))


def test_second_call_reads_the_stored_table_only(spark, store, numbers):
    build = Counted()
    first = store.table("sums", spark.read.parquet(numbers), build)
    again = store.table("sums", spark.read.parquet(numbers), build)
    assert build.calls == 1 and first.exceptAll(again).isEmpty() and again.count() == 7
    assert all(f.startswith(("file:" + store.folder, "file://" + store.folder)) for f in again.inputFiles()) and again.inputFiles()


def test_another_session_finds_it_too(spark, store, numbers):
    build = Counted()
    store.table("sums", spark.read.parquet(numbers), build)
    other = spark.newSession()
    Store(other, store.folder).table("sums", other.read.parquet(numbers), build)
    assert build.calls == 1


def test_name_parameters_and_plan_are_part_of_the_key(spark, store, numbers):
    build, rows = Counted(), spark.read.parquet(numbers)
    store.table("sums", rows, build)
    store.table("other", rows, build)
    store.table("sums", rows, build, digits=2)
    few = store.table("sums", rows.where("id < 50"), build)
    store.table("sums", rows.where("id < 51"), build)
    assert build.calls == 5 and few.agg(F.sum("total")).first()[0] == sum(range(50))


def test_wide_plans_are_not_cut_short(spark, numbers):
    wide = lambda last: spark.read.parquet(numbers).select(*[(F.col("id") + i).alias(f"c{i}") for i in [*range(60), last]])
    assert plan_text(wide(70)) == plan_text(wide(70)) != plan_text(wide(71))


def test_rows_that_are_in_no_file_are_told_apart(spark, store):
    build = Counted()
    a, b = (spark.createDataFrame([(i, 1)], "id bigint, g bigint") for i in (1, 2))
    assert store.table("sums", a, build).first()["total"] == 1
    assert store.table("sums", b, build).first()["total"] == 2
    assert build.calls == 2


def test_changed_input_is_computed_anew_and_swept(spark, store, numbers):
    build = Counted()
    store.table("sums", spark.read.parquet(numbers), build)
    state = files_state(spark, spark.read.parquet(numbers).inputFiles())
    assert store.sweep("sums") == 0
    spark.range(1000, 1001).select("id", (F.col("id") % 7).alias("g")).write.mode("append").parquet(numbers)
    assert files_state(spark, spark.read.parquet(numbers).inputFiles()) != state
    # the first entry's own files are all there, so it still answers for them; the new state is another key
    new = store.table("sums", spark.read.parquet(numbers), build)
    assert build.calls == 2 and new.agg(F.sum("total")).first()[0] == sum(range(100)) + 1000
    spark.range(5).select("id", (F.col("id") % 7).alias("g")).write.mode("overwrite").parquet(numbers)
    assert store.sweep("sums") == 2
    assert store.table("sums", spark.read.parquet(numbers), build).agg(F.sum("total")).first()[0] == 10


def test_a_half_written_table_is_never_found(spark, store, numbers):
    def breaks(rows):
        odd = F.when(F.col("id") == 99, F.raise_error("lost")).otherwise(F.col("id"))
        return rows.select("g", odd.alias("total"))

    with pytest.raises(Exception, match="lost"):
        store.table("sums", spark.read.parquet(numbers), breaks)
    assert list(Path(store.folder, "data").iterdir())  # something was left
    build = Counted()
    assert store.table("sums", spark.read.parquet(numbers), build).count() == 7 and build.calls == 1


def test_two_writers_agree_on_the_first_published(spark, store, numbers):
    rows, inner = spark.read.parquet(numbers), Counted()
    paths = []

    def slow(source):
        paths.append(store.table("sums", rows, inner).inputFiles())  # another call comes first, from start to end
        return inner(source)

    late = store.table("sums", rows, slow)
    assert inner.calls == 2 and sorted(late.inputFiles()) == sorted(paths[0])
    assert sorted(store.table("sums", rows, slow).inputFiles()) == sorted(paths[0])


def test_models_are_found_again(spark, store, numbers):
    rows = prepare.assemble(spark.read.parquet(numbers), ["g"], "id", ["id"])
    fits = []

    def fit(source):
        fits.append(1)
        return models.fit(models.OLS, source)

    first = store.model("line", rows, fit, kind="linear")
    again = store.model("line", rows, fit, kind="linear")
    assert len(fits) == 1 and first.coefficients == again.coefficients and first.intercept == again.intercept
    store.model("line", rows, fit, kind="other")
    assert len(fits) == 2


def test_missing_input_fails(spark, store, numbers):
    with pytest.raises(AnalysisException):
        store.table("sums", spark.read.parquet(numbers + "-absent"), Counted())
