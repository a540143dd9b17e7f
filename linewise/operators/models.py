"""Regressors from MLlib: learners, grid search, importances."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewise.operators import trees
from linewise.operators.evaluate import r_squared
from linewise.session import ensure_checkpoint_folder, scratch_path

SEED = 42
# Finer than the default 32 bins: closer to exact split search. Codes are ordered numbers, so classes need no bins of their own;
# the statistics of a level are exchanged bin by bin, which is most of a fit's work.
MAX_BINS = 64
# Rows of a part of a learner's table: few enough for many short fits at a time, more where the parts would be many.
PART_ROWS, MANY_PARTS, MOST_PART_ROWS, LEAST_PARTS = 16_384, 4_096, 1 << 20, 2
# Parts of the rows that trees are fitted to, until a part would have more than MOST_PART_ROWS: every level of every tree exchanges
# the statistics of all its nodes once a part, however few rows the part has.
TREE_PARTS = 12
# Rows from which trees are grown over binned blocks of rows (operators/trees.py) instead of by MLlib, whose fits to fewer rows take
# less time. Candidates are drawn and rows bagged by other random numbers there; the rules are the same.
BLOCKS_FROM = 1 << 18
# Fits at a time. A fit on few rows is a chain of short jobs that leaves most of a cluster idle.
PARALLEL_FITS = 8
# Rows that all fits of a time may have together: each keeps its own copy of the binned rows.
ROWS_AT_A_TIME = 1 << 24
# Trees between two cuts of a boosted model's lineage: a cut writes two numbers a row.
CHECKPOINT_TREES = 25
# Memory of one task for split statistics, as MLlib defaults it: a session with many slots per executor must hold all tasks.
TREE_MEMORY_MB = 256


@dataclass(frozen=True)
class Learner:
    """A kind of regressor and its settings."""

    kind: str
    params: dict = field(default_factory=dict)

    def using(self, **params) -> "Learner":
        return Learner(self.kind, {**self.params, **params})


# Settings of the compared learners.
OLS = Learner("linear")
RIDGE = Learner("ridge", {"alpha": 1.0})
RANDOM_FOREST = Learner("forest", {"trees": 100, "depth": 10})
GBT = Learner("boosted", {"trees": 100, "depth": 7, "rate": 0.1})
GBT_DASHBOARD = Learner("boosted", {"trees": 100, "depth": 3, "rate": 0.1})
BOOSTED_DASHBOARD = Learner("boosted", {"trees": 200, "depth": 6, "rate": 0.05})
BOOSTED = Learner("boosted", {"trees": 100, "depth": 6, "rate": 0.3})

# The search grid of the tuned learner, and the wider one.
TUNING_GRID = {"trees": [100, 150], "depth": [5, 7], "rate": [0.01, 0.1]}
WIDE_GRID = {
    "trees": [100, 150, 200], "depth": [5, 7, 9], "rate": [0.01, 0.05, 0.1],
    "row_share": [0.8, 0.9, 1.0], "column_share": [0.8, 0.9, 1.0],
}


def in_one_pass(learner: Learner) -> bool:
    """Whether a fit sums over its rows and is done, so that they need not be dealt into parts and held for it."""
    return learner.kind in ("linear", "ridge")


def estimator(learner: Learner, train: DataFrame | trees.Blocks):
    """The MLlib estimator for rows of (features, label); blocks of them do for trees."""
    p = learner.params
    if learner.kind == "linear":
        return LinearRegression(solver="normal")
    if learner.kind == "ridge":
        # The normal solver scales its penalty by the label's deviation and by the row count
        n, deviation = train.agg(F.count("label"), F.stddev_pop("label")).first()
        return LinearRegression(
            solver="normal", elasticNetParam=0.0, standardization=False, regParam=p["alpha"] * deviation / n
        )
    columns = str(p["column_share"]) if p.get("column_share", 1.0) < 1.0 else "all"
    common = dict(
        maxDepth=p["depth"], seed=SEED, maxBins=MAX_BINS, maxMemoryInMB=TREE_MEMORY_MB,
        featureSubsetStrategy=columns, subsamplingRate=p.get("row_share", 1.0),
    )
    if learner.kind == "forest":
        return RandomForestRegressor(numTrees=p["trees"], bootstrap=p.get("bootstrap", True), **common)
    if learner.kind == "boosted":
        return GBTRegressor(maxIter=p["trees"], stepSize=p["rate"], checkpointInterval=CHECKPOINT_TREES, **common)
    raise ValueError(f"unknown learner {learner.kind!r}")


def parts(rows: int) -> int:
    """Parts that a learner's rows are dealt into. The number of rows alone decides, not the cluster's size, for trees depend on it."""
    size = min(max(PART_ROWS, rows // MANY_PARTS), MOST_PART_ROWS)
    return max(LEAST_PARTS, -(-rows // size))


def tree_parts(rows: int) -> int:
    """Parts of the rows of a learner of trees: as `parts`, but no more than TREE_PARTS before they have MOST_PART_ROWS each."""
    return min(parts(rows), max(TREE_PARTS, -(-rows // MOST_PART_ROWS)))


def fits_at_a_time(rows: int, most: int = PARALLEL_FITS) -> int:
    """Fits to so many rows that run together: many on few rows, one alone where it keeps the cluster and its memory busy."""
    return max(1, min(most, ROWS_AT_A_TIME // max(rows, 1)))


def dealt(rows: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """`rows` in parts by the hash of `key`, in its order: MLlib draws its split candidates part by part, so trees are the
    same on any cluster as long as the number of parts is."""
    partitions = tree_parts(rows.count()) if partitions is None else partitions
    return rows.repartition(partitions, key).sortWithinPartitions(key)


def train_part(rows: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """The train part of `rows`, dealt into as many parts as all of them would be: what fits read, without key and split."""
    partitions = tree_parts(rows.count()) if partitions is None else partitions
    return dealt(rows.where(F.col("split") == "train").drop("split"), key, partitions).drop(key)


@contextmanager
def train_rows(rows: DataFrame, key: str) -> Iterator[DataFrame]:
    """The train part of `rows` for any number of fits: few rows are dealt and held, many stay where they are, with a seat
    instead of their key, for fits to lay out (`laid_out`)."""
    n = rows.count()
    if n >= BLOCKS_FROM:
        yield trees.seated(rows.where(F.col("split") == "train").drop("split"), key)
        return
    with held(train_part(rows, key, tree_parts(n))) as train:
        yield train


@contextmanager
def laid_out(learners: list[Learner], train: DataFrame) -> Iterator[DataFrame | trees.Blocks]:
    """What the learners are fitted to: blocks, if `train` has seats and one of them grows trees, else `train` itself."""
    growing = [estimator(learner, train) for learner in learners if not in_one_pass(learner)]
    if not growing or trees.SEAT not in train.columns:
        yield train
        return
    with trees.laid_out(train, MAX_BINS, SEED, any(trees.draws(e) for e in growing)) as blocks:
        yield blocks


@contextmanager
def held(rows: DataFrame) -> Iterator[DataFrame]:
    """`rows` laid out once for many fits: exchanged and sorted by the first, read in place by all others.

    Parts that don't fit in memory go to the executors' disks; a lost executor's parts are dealt again from what `rows` reads."""
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def fit(learner: Learner, train: DataFrame | trees.Blocks) -> Model:
    ensure_checkpoint_folder(train.sparkSession)  # boosting cuts its lineage there
    if isinstance(train, trees.Blocks):
        return trees.fit(estimator(learner, train), train)
    with laid_out([learner], train) as rows:
        return estimator(learner, train).fit(train) if rows is train else trees.fit(estimator(learner, train), rows)


def fit_all(learners: dict[str, Learner], train: DataFrame, parallelism: int = PARALLEL_FITS) -> dict[str, Model]:
    """Every learner fitted to the same rows, `parallelism` at a time, fewer of many rows."""
    if len(learners) > 1:
        parallelism = fits_at_a_time(train.count(), parallelism)
    with laid_out(list(learners.values()), train) as rows, ThreadPool(max(1, min(parallelism, len(learners)))) as pool:
        fitted = pool.map(lambda learner: fit(learner, train if in_one_pass(learner) else rows), learners.values(), chunksize=1)
    return dict(zip(learners, fitted))


def load_model(spark: SparkSession, path: str) -> Model:
    """A saved model of any of the learners' kinds."""
    return DefaultParamsReader.loadParamsInstance(path, spark)


def prefix_scores(model: Model, rows: DataFrame, trees: list[int], spread: float | None) -> list[float]:
    """R² over `rows` of a boosted model's first so many trees, from one pass; `spread` is the variance of the labels."""
    errors = model.evaluateEachIteration(rows, "squared")
    return [1 - errors[n - 1] / spread if spread else float(errors[n - 1] == 0) for n in trees]


def grid_points(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def grid_search(
    base: Learner,
    train: DataFrame,
    grid: dict[str, list] = TUNING_GRID,
    folds: int = 5,
    fold_column: str = "fold",
    parallelism: int = PARALLEL_FITS,
) -> tuple[Model, Learner, DataFrame]:
    """Refitted best model, its settings, and (point, settings, mean_r2, rank) of every point.

    `train` has `features`, `label` and a fold number from 0 to folds - 1 (`prepare.with_fold` with the same number).
    Fits run as separate Spark jobs, `parallelism` at a time (fewer of many rows), the deepest first; a point's score is the mean of its folds'
    R². The first point wins a tie. Boosting adds one tree after the other, so points that differ in their number of trees
    only are prefixes of the longest: it is fitted once for all of them. `train` is read by every fit, so hold it, or let it have
    seats (`train_rows`): then the rows outside of each fold are laid out once for all points.
    """
    points = grid_points(grid)
    found = train.groupBy(fold_column).agg(F.var_pop("label"), F.count("*")).collect()  # one row a fold
    spreads, parallelism = {r[0]: r[1] for r in found}, fits_at_a_time(sum(r[2] for r in found), parallelism)
    alike: dict[tuple, list[int]] = {}
    for i, point in enumerate(points):
        settings = base.using(**point).params
        rest = tuple(sorted((k, v) for k, v in settings.items() if k != "trees" or base.kind != "boosted"))
        alike.setdefault(rest, []).append(i)

    def score(task: tuple[list[int], int]) -> list[tuple[int, float]]:
        group, fold = task
        inside, outside = rows[fold], train.where(F.col(fold_column) == fold)
        if len(group) == 1:
            scored = fit(base.using(**points[group[0]]), inside).transform(outside)
            return [(group[0], scored.agg(r_squared().alias("r2")).first()["r2"])]
        trees = {i: base.using(**points[i]).params["trees"] for i in group}
        longest = fit(base.using(**points[max(group, key=trees.get)]), inside)
        return list(zip(group, prefix_scores(longest, outside, [trees[i] for i in group], spreads.get(fold))))

    size = lambda group: [-base.using(**points[group[0]]).params.get(k, 0) for k in ("depth", "trees")]
    tasks = [(group, fold) for group in sorted(alike.values(), key=size) for fold in range(folds)]
    with ExitStack() as kept, ThreadPool(parallelism) as pool:
        rows = [kept.enter_context(laid_out([base], train.where(~(F.col(fold_column) == fold)))) for fold in range(folds)]
        scores = [pair for found in pool.map(score, tasks, chunksize=1) for pair in found]
    means = [sum(s for i, s in scores if i == point) / folds for point in range(len(points))]
    order = sorted(range(len(points)), key=lambda i: (-means[i], i))
    best = base.using(**points[order[0]])
    table = train.sparkSession.createDataFrame(
        [(i, str(points[i]), means[i], order.index(i) + 1) for i in range(len(points))],
        "point int, settings string, mean_r2 double, rank int",
    )
    return fit(best, train), best, table


def importances(model: Model, columns: list[str], n: int) -> DataFrame:
    """The n features with the largest importance; ties in column order."""
    values = model.featureImportances.toArray()
    rows = [(i, name, float(values[i])) for i, name in enumerate(columns)]
    table = SparkSession.active().createDataFrame(rows, "position int, feature string, importance double")
    return table.orderBy(F.desc("importance"), "position").limit(n).select("feature", "importance")


# Fixed value: boosting fits later trees to twice the residual, the gradient of the squared error, so their gains are four times as large.
GRADIENT_SCALE = 2.0


def tree_nodes(model: Model) -> DataFrame:
    """The nodes of all trees of a forest or a boosted model: tree, node, rows, prediction, and for inner nodes feature (its
    place among the columns), threshold and gain, the fall of the squared error over the node's rows.

    The model is written once and its nodes are read back as a table, so no tree is walked on the driver."""
    spark = SparkSession.active()
    path = scratch_path(spark, "model")
    model.write().save(path)
    node = F.col("nodeData")
    boosted = "GBT" in type(model).__name__
    scale = F.when(F.lit(boosted) & (F.col("treeID") > 0), GRADIENT_SCALE).otherwise(1.0)
    inner = node["leftChild"] >= 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), node["rawCount"].alias("rows"), node["prediction"].alias("prediction"),
        F.when(inner, node["split"]["featureIndex"]).alias("feature"),
        F.when(inner, node["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"),
        F.when(inner, node["gain"] * node["impurityStats"][0] / (scale * scale)).alias("gain"))


def split_gains(model: Model, columns: list[str], n: int | None = None) -> DataFrame:
    """(feature, splits, total_gain, mean_gain, importance) by falling importance: the mean gain of a feature's splits, as a share of
    all features' means. Features that no split uses have importance 0; ties go by column order; the first `n` only, if given."""
    used = tree_nodes(model).where("feature IS NOT NULL").groupBy("feature").agg(
        F.count("*").alias("splits"), F.sum("gain").alias("total_gain"))
    names = used.sparkSession.createDataFrame(list(enumerate(columns)), "place int, name string")
    filled = names.join(used, F.col("place") == F.col("feature"), "left").select(
        "place", F.col("name").alias("feature"), F.coalesce("splits", F.lit(0)).alias("splits"), F.coalesce("total_gain", F.lit(0.0)).alias("total_gain"))
    means = filled.withColumn("mean_gain", F.when(F.col("splits") > 0, F.col("total_gain") / F.col("splits")).otherwise(0.0))
    whole = F.sum("mean_gain").over(Window.partitionBy())  # one row a feature
    ranked = means.withColumn("importance", F.coalesce(F.try_divide("mean_gain", whole), F.lit(0.0))).orderBy(F.desc("importance"), "place").drop("place")
    return ranked if n is None else ranked.limit(n)
