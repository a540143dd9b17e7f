"""Keyed store of intermediate tables and fitted models: computed once, found again by later calls and sessions."""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.operators.models import load_model

ENTRY = "key string, inputs string, files array<string>, path string, written timestamp"
#: Leaves of a plan whose rows are not in files: only their own hash tells two of them apart.
NOT_IN_FILES = re.compile(r"LocalRelation|LocalTableScan|LogicalRDD|ExistingRDD|Scan ExistingRDD")


def plan_text(df: DataFrame) -> str:
    """What `df` computes, as text: its optimised plan with columns numbered by appearance, so that the same steps give the same text."""
    conf, width = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(width, None)
    conf.set(width, str(1 << 30))  # no column may be left out of the text
    try:
        with contextlib.redirect_stdout(io.StringIO()) as shown:
            df.explain(mode="extended")
    finally:
        conf.set(width, before) if before is not None else conf.unset(width)
    text = shown.getvalue().split("== Optimized Logical Plan ==")[-1].split("== Physical Plan ==")[0]
    numbers: dict[str, str] = {}
    text = re.sub(r"#(\d+)", lambda m: numbers.setdefault(m[1], f"#{len(numbers)}c"), text)
    return text + (f"\n{df.semanticHash()}" if NOT_IN_FILES.search(text) else "")


def files_state(spark: SparkSession, files: list[str]) -> str:
    """Digest of the names, lengths and times of files: another one as soon as a file is changed, added or gone.

    Only the files' metadata are read, in parallel, and combined before the driver sees them."""
    if not files:
        return "none"
    listed = spark.read.format("binaryFile").load(sorted(files)).select("path", "length", "modificationTime")
    mark = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    row = listed.agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum("length").alias("bytes")).first()
    return f"{row['n']}-{row['x']}-{row['bytes']}"


@dataclass(frozen=True)
class Store:
    """Tables and models under `folder`, found by what they are made of.

    An entry's key digests its name, its parameters, the plan of the rows it is made from and the state of the files behind
    them; a changed input or parameter is another key. The table is written under a name of its own first, and
    only then published by one row in the index of its name: a table that was left half written is never found. Two calls that
    miss at a time both write, and every later call takes the first published of the two. Nothing is deleted while others may read it:
    `sweep` empties what no input leads to any more.
    """

    spark: SparkSession
    folder: str

    def _index(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/index/{name}"

    def _entries(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(ENTRY).parquet(self._index(name))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def _find(self, name: str, key: str) -> str | None:
        entries = self._entries(name)
        first = None if entries is None else entries.where(F.col("key") == key).orderBy("written", "path").first()
        return None if first is None else first["path"]

    def _key(self, name: str, source: DataFrame, params: dict) -> tuple[str, str, list[str]]:
        files = source.inputFiles()
        inputs = files_state(self.spark, files)
        made_of = json.dumps([name, params, plan_text(source), sorted(files), inputs, source.schema.json()], sort_keys=True, default=str)
        return hashlib.sha256(made_of.encode()).hexdigest(), inputs, sorted(files)

    def _kept(self, name: str, source: DataFrame, params: dict, write: Callable[[str], None]) -> str:
        key, inputs, files = self._key(name, source, params)
        path = self._find(name, key)
        if path is None:
            mine = f"{self.folder.rstrip('/')}/data/{name}-{uuid.uuid4().hex}"
            write(mine)
            entry = self.spark.range(1).select(
                F.lit(key).alias("key"), F.lit(inputs).alias("inputs"), F.array(*[F.lit(f) for f in files]).cast("array<string>").alias("files"),
                F.lit(mine).alias("path"), F.current_timestamp().alias("written"))
            entry.coalesce(1).write.mode("append").parquet(self._index(name))
            path = self._find(name, key)
        return path

    def table(self, name: str, source: DataFrame, build: Callable[[DataFrame], DataFrame], **params) -> DataFrame:
        """`build(source)`, from the store if it is there for this source and these parameters.

        `build` may depend on nothing but `source` and `params`; give what else it depends on as a parameter."""
        return self.spark.read.parquet(self._kept(name, source, params, lambda path: build(source).write.parquet(path)))

    def model(self, name: str, source: DataFrame, fit: Callable[[DataFrame], Model], **params) -> Model:
        """`fit(source)`, or the model that an earlier call has fitted to the same rows with the same parameters."""
        return load_model(self.spark, self._kept(name, source, params, lambda path: fit(source).write().save(path)))

    def sweep(self, name: str) -> int:
        """Empties the tables whose input files have changed since, and takes them out of the index; how many there were.

        To be run while no one reads them or adds to this name."""
        entries = self._entries(name)
        rows = [] if entries is None else entries.collect()  # one row a stored table
        kept, gone = [], []
        for row in rows:
            try:
                same = files_state(self.spark, row["files"]) == row["inputs"]
            except AnalysisException:  # an input file is gone
                same = False
            (kept if same else gone).append(row)
        if gone:
            self.spark.createDataFrame(kept, ENTRY).coalesce(1).write.mode("overwrite").parquet(self._index(name))
            for row in gone:
                self.spark.createDataFrame([], "gone boolean").write.mode("overwrite").parquet(row["path"])
        return len(gone)
