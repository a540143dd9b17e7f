"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import linewise
from linewise.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and whole text; a NULL text is the empty text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def in_small_batches(df: DataFrame) -> DataFrame:
    """`df`, after bounding what a Python worker of its session is handed at once, so that long texts don't fill its memory."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 16 << 20)):
        now = int(conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b"))
        if not 0 < now <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A mapper that, when its task ends, gives the memory it has freed back to the system: the Python worker lives on."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidied


def remainder(doc_id: Column | str, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; a NULL id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % divisor,
                      F.lit(0).cast("long"))


def with_free_names(docs: DataFrame, taken: set[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`work` of `docs`, whose own columns with names in `taken` go by other names meanwhile."""
    aside = {c: f"own_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in taken}
    return work(docs.withColumnsRenamed(aside)).withColumnsRenamed({v: k for k, v in aside.items()})


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; NULL is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def connected(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of `edges` (a, b: long): one row (node, root) for each node that an edge names.

    Randomised contraction: in every round each node points to the neighbour (or itself) with the smallest hash for
    that round, edges are rewritten to the targets, loops and repeats go. A round removes a constant share of the
    nodes on any graph, so the rounds grow with the logarithm of the nodes. Only minima are grouped, which combine
    before the exchange, so a hub costs no more than any other node. Every round is written, which cuts the lineage.
    The root is some node of the component.
    """
    edges = materialize(edges.where("a <> b").distinct(), label)
    roots, turn = None, 0
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("x"))  # noqa: B023, E731
        to = both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("m"))
        to = materialize(to.select("node", F.least(F.col("m"), rank(F.col("node")))["x"].alias("to")), label)
        at = lambda side: to.select(F.col("node").alias(side), F.col("to").alias(f"{side}_to"))  # noqa: B023, E731
        if roots is None:
            roots = to.select("node", F.col("to").alias("root"))
        else:
            moved = to.select(F.col("node").alias("root"), "to")
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = materialize(roots, label)
        edges = edges.join(at("a"), "a").join(at("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        edges = materialize(edges.where("a <> b").distinct(), label)
        turn += 1
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this library where neither their path nor their working folder has it: the driver
    serves it to them as a zip, once for each application."""
    root = Path(linewise.__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == root:
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="run-"), "linewise"), "zip", root, "linewise")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
