"""Session helpers: building a session, and the shared scratch folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_folders: dict[str, str] = {}


def build_session(app_name: str = "linewise", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and skew handling on. Cluster sizing stays with the caller.

    `forceOptimizeSkewedJoin` lets AQE split a hot join partition even where that costs one more
    exchange: a third of all rows in one task is worse than an exchange.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """Folder for written intermediates: the cluster's `spark.checkpoint.dir`.

    Only a local master may fall back to a fresh folder under /tmp; on a cluster a machine-local
    folder would be invisible to the other executors, so a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_folders[app]


def ensure_checkpoint_folder(spark: SparkSession) -> None:
    """Let iterative learners checkpoint; a folder the cluster has set is kept."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_folder(spark))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the scratch folder that no earlier call has returned."""
    return f"{scratch_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


# Codec for written lines: a third smaller than the session's own, and they are most of what a query writes.
TIGHT = "zstd"


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write `df` as Parquet to the scratch folder and read it back.

    Cuts lineage in a way that survives lost executors, lets later passes read only the columns
    they need, and gives the planner true sizes for its join choice. `compression` is the session's, unless given.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_measured(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """`materialize`, with aggregates taken while the rows pass by instead of in another scan.

    A task that ran twice may be counted twice, so use measures for which that is harmless:
    flags, extremes, or sizes that only choose between two exact ways.
    """
    seen = Observation(label)
    table = materialize(df.observe(seen, *[m.alias(name) for name, m in measures.items()]), label, TIGHT)
    return table, seen.get
