"""Forests and boosted trees of many rows, grown level by level over blocks of binned rows.

MLlib's own fit keeps a vector and two objects for every row and exchanges the statistics of all nodes in doubles. Here a row
is one byte a feature, the place of its value among the feature's split candidates, and what is left of its label. A task adds
up its blocks' counts and label sums by node and bin, the tasks' tables are added, and the best split of every node is found
there. Candidates, gains, ties and stopping are MLlib's, and the trees become an MLlib model.

Labels are added as whole multiples of a power of two, so sums are exact in any order: the trees depend neither on the cluster
nor on where rows lie.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.ml.util import DefaultParamsReader
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.session import scratch_path

# What tasks run travels with them: workers need not find this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Column with a hash of each row, from which the rows of a tree are drawn.
SEAT = "seat"
BLOCK_ROWS = 1 << 16
# Rows of a part, unless the cluster has more slots than parts: each part gives a table of every asked node.
PART_ROWS = 1 << 22
# Rows that split candidates come from, as MLlib takes them (it asks for the square of the bins, if that is more).
SAMPLE_ROWS = 10_000
# Bytes of a task's tables in one pass over a forest's level: trees take turns beyond it.
TABLE_BYTES = 192 << 20
# Label sums are whole numbers below 2^53; what rows drawn several times add to them is left free.
SUM_BITS = 50
# Boosting fits later trees to twice the residual, the gradient of the squared error, as MLlib does.
GRADIENT = 2.0
# Cut of a slot without a split: every row of it goes left.
ALL_LEFT = 255


@dataclass(frozen=True)
class Blocks:
    """Binned rows of a fit, block by block: `bins` of (places by feature, seats or None), and in the same parts `labels`: what is left
    of them, its squares by the leaf that left it (none yet), and its largest."""

    bins: RDD
    labels: RDD
    cuts: list[np.ndarray]
    n: int
    largest: float
    sparkSession: SparkSession


def seated(rows: DataFrame, key: str) -> DataFrame:
    """`rows` of (key, features, label, ...) with a seat instead of the key; rows that are equal in all three share theirs."""
    return rows.withColumn(SEAT, F.xxhash64(key, "features", "label")).drop(key)


def candidates(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """MLlib's split candidates of a feature: all midpoints between its values if they are few, else those nearest to
    equal steps of their number."""
    value, where = np.unique(values, return_inverse=True)
    n = np.bincount(where, weights=counts, minlength=len(value))
    middle = (value[:-1] + value[1:]) / 2
    if len(middle) < bins:
        return middle
    found, step, so_far = [], n.sum() / bins, np.cumsum(n)
    target = step
    for i in range(1, len(value)):
        if abs(so_far[i - 1] - target) < abs(so_far[i] - target):
            found.append(middle[i - 1])
            target += step
    return np.array(found)


def _packed(cuts: list[np.ndarray], drawn: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            bins, labels, seats = (np.concatenate(part, axis=-1) for part in zip(*held))
            held.clear()
            return pa.RecordBatch.from_pydict({"bins": [bins.tobytes()], "labels": [labels.tobytes()], "seats": [seats.tobytes()]})

        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(cuts))
            bins = np.empty((len(cuts), len(x)), np.uint8)
            for f, cut in enumerate(cuts):
                bins[f] = np.searchsorted(cut, x[:, f])
            seats = batch.column(SEAT).to_numpy() if drawn else np.empty(0, np.int64)
            held.append((bins, batch.column("label").to_numpy(), seats))
            if sum(len(part[1]) for part in held) >= BLOCK_ROWS:
                yield block()
        if held:
            yield block()

    return run


def _kept(rdd: RDD) -> RDD:
    """`rdd` kept by the executors, one block at a time, so that `zip` takes it as it is."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1)).persist(StorageLevel.MEMORY_AND_DISK)


@contextmanager
def laid_out(rows: DataFrame, bins: int, seed: int, drawn: bool) -> Iterator[Blocks]:
    """`rows` of (features, label, seat) as blocks for any number of fits; `drawn` keeps the seats, which only fits to drawn
    rows need. The driver sees the rows that candidates come from, equal ones once."""
    spark = rows.sparkSession
    n, largest = rows.agg(F.count("*"), F.max(F.abs("label"))).first()
    wanted = max(bins * bins, SAMPLE_ROWS)
    taken = F.pmod(F.xxhash64(SEAT, F.lit(seed)), F.lit(1 << 31)) < math.ceil(wanted / max(n, 1) * (1 << 31))
    sample = rows.where(taken).groupBy(vector_to_array("features").alias("x")).agg(F.count("*").alias("n")).toArrow()
    counts = sample.column("n").to_numpy()
    x = sample.column("x").combine_chunks().flatten().to_numpy().reshape(len(counts), -1)
    cuts = [candidates(x[:, f], counts, bins) for f in range(x.shape[1])]
    parts = max(spark.sparkContext.defaultParallelism, -(-n // PART_ROWS))
    columns = rows.select(vector_to_array("features").alias("x"), "label", *[SEAT] * drawn)
    packed = columns.mapInArrow(_packed(cuts, drawn), "bins binary, labels binary, seats binary").repartition(parts).rdd
    width = len(cuts)

    def place(r) -> tuple:
        return np.frombuffer(r["bins"], np.uint8).reshape(width, -1), np.frombuffer(r["seats"], np.uint64) if drawn else None

    def label(r) -> tuple:
        labels = np.frombuffer(r["labels"], float)
        return labels, 0.0, float(np.abs(labels).max(initial=0.0))

    kept = _kept(packed.map(place)), _kept(packed.map(label))
    try:
        yield Blocks(*kept, cuts, n, float(largest or 0.0), spark)
    finally:
        for rdd in kept:
            rdd.unpersist()


# --- inside a task ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Draw:
    """How often a tree takes each row: a number of times for every 16 bits of a hash of the row's seat and the tree."""

    times: np.ndarray
    seed: int

    @classmethod
    def of(cls, share: float, replaced: bool, seed: int) -> Draw | None:
        """Poisson draws with replacement, else a share of the rows; None takes every row once."""
        if not replaced and share >= 1.0:
            return None
        at = (np.arange(1 << 16) + 0.5) / (1 << 16)
        if not replaced:
            return cls((at < share).astype(np.uint8), seed)
        chances = np.cumsum([math.exp(-share) * share**k / math.factorial(k) for k in range(32)])
        return cls(np.searchsorted(chances, at, side="right").astype(np.uint8), seed)

    def rows(self, seats: np.ndarray, tree: int) -> np.ndarray:
        start = np.random.SeedSequence([self.seed, tree]).generate_state(1, np.uint64)[0]
        h = seats ^ start
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return self.times[h >> np.uint64(48)]


def slots(bins: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The slot of every row in the level below `levels`, each of which has a feature and a cut for every slot."""
    n = bins.shape[1]
    slot, flat, at = np.zeros(n, np.intp), bins.reshape(-1), np.arange(n)
    for feature, cut in levels:
        if len(feature) == 1:
            slot = (bins[feature[0]] > cut[0]).astype(np.intp)
        else:
            slot = 2 * slot + (flat.take((feature * n)[slot] + at) > cut[slot])
    return slot


def add_up(tables: np.ndarray, bins: np.ndarray, place: np.ndarray, label: np.ndarray, times: np.ndarray | None) -> None:
    """Adds the rows to `tables` (2, features, places x bins): how often rows are taken, and the sums of `label`, which has been
    multiplied by that. Rows whose place is negative take no part."""
    inside = place >= 0
    rows = None if inside.all() else np.flatnonzero(inside)
    width = tables.shape[2]
    if rows is not None:
        place, label, times = place[rows], label[rows], None if times is None else times[rows]
    for f, column in enumerate(bins):
        at = place + (column if rows is None else column.take(rows))
        tables[0, f] += np.bincount(at, weights=times, minlength=width)
        tables[1, f] += np.bincount(at, weights=label, minlength=width)


def best_splits(tables: np.ndarray, n_cuts: np.ndarray, allowed: np.ndarray | None = None) -> list[np.ndarray]:
    """For nodes' tables (2, nodes, features, bins): the feature, cut and gain of the split that lowers the variance most, and the
    number and label sum of rows on its left; the first of equals. Gain is 0 where no split parts the rows."""
    whole = tables[:, :, :1].sum(axis=3, keepdims=True)
    left = np.cumsum(tables, axis=3)
    right = whole - left
    cuts = np.arange(tables.shape[3]) < n_cuts[:, None]
    parted = (left[0] > 0) & (right[0] > 0) & cuts
    if allowed is not None:
        parted &= allowed[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = left[1] / left[0] - right[1] / right[0]
        gain = np.where(parted, left[0] * right[0] / (whole[0] * whole[0]) * apart * apart, 0.0)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    at = np.arange(len(best))
    of = lambda part: part.reshape(len(gain), -1)[at, best]
    return [best // tables.shape[3], best % tables.shape[3], flat[at, best], of(left[0]), of(left[1])]


def features_of(share: str, tree: int, level: int, slots_of: np.ndarray, features: int, seed: int) -> np.ndarray | None:
    """Which features each node may split by: all, or a share of them drawn for the node."""
    if share == "all":
        return None
    n = math.ceil(float(share) * features)
    chosen = np.zeros((len(slots_of), features), bool)
    for i, slot in enumerate(slots_of):
        chosen[i, np.random.default_rng([seed, tree, level, int(slot)]).permutation(features)[:n]] = True
    return chosen


# --- trees ------------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """A tree while it grows: its levels for walking down, and (times, sum) and (feature, cut, gain) of its nodes by (level, slot).
    Label sums and gains are in the tree's own `scale`."""

    scale: float
    levels: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    totals: dict[tuple[int, int], tuple[float, float]] = field(default_factory=dict)
    splits: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)
    squares: np.ndarray | None = None

    def split(self, level: int, asked: list[int], found: list[np.ndarray]) -> list[tuple[int, int]]:
        """Takes the best splits of the asked slots; the pairs of slots of the next level that they lead to."""
        feature, cut = np.zeros(1 << level, np.int64), np.full(1 << level, ALL_LEFT, np.uint8)
        pairs = []
        for slot, f, c, gain, n, total in zip(asked, *found):
            if not gain > 0:
                continue
            feature[slot], cut[slot] = f, c
            self.splits[level, slot] = int(f), int(c), float(gain)
            all_n, all_total = self.totals[level, slot]
            self.totals[level + 1, 2 * slot] = float(n), float(total)
            self.totals[level + 1, 2 * slot + 1] = all_n - float(n), all_total - float(total)
            pairs.append((2 * slot, 2 * slot + 1))
        if pairs:
            self.levels.append((feature, cut))
        return pairs

    def means(self) -> np.ndarray:
        """The mean label of every slot below the last level; a leaf further up is the leftmost of those below it."""
        means, last = np.zeros(1 << len(self.levels)), len(self.levels)
        for (level, slot), (n, total) in self.totals.items():
            if (level, slot) not in self.splits:
                means[slot << (last - level)] = total / n / self.scale
        return means

    def nodes(self, cuts: list[np.ndarray], factor: float) -> list[dict]:
        """Rows of MLlib's node table, parents first, left before right; labels were `factor` times as large. Leaves of one split
        that predict the same become one, as in MLlib."""
        last, rows = len(self.levels), []

        def squares(level: int, slot: int) -> float:
            width = last - level
            return float(self.squares[slot << width : (slot + 1) << width].sum()) * factor * factor

        def add(level: int, slot: int) -> int:
            n, total = self.totals[level, slot]
            total *= factor / self.scale
            place, of_squares = len(rows), squares(level, slot)
            leaf = dict(
                id=place, prediction=total / n, impurity=max(of_squares / n - (total / n) ** 2, 0.0), impurityStats=[n, total, of_squares],
                rawCount=int(n), gain=-1.0, leftChild=-1, rightChild=-1,
                split=dict(featureIndex=-1, leftCategoriesOrThreshold=[], numCategories=-1))
            rows.append(leaf)
            if (level, slot) in self.splits:
                feature, cut, gain = self.splits[level, slot]
                left, right = add(level + 1, 2 * slot), add(level + 1, 2 * slot + 1)
                pair = rows[left], rows[right]
                if all(child["leftChild"] < 0 for child in pair) and pair[0]["prediction"] == pair[1]["prediction"]:
                    del rows[place + 1 :]
                else:
                    leaf.update(gain=gain * (factor / self.scale) ** 2, leftChild=left, rightChild=right, split=dict(
                        featureIndex=feature, leftCategoriesOrThreshold=[float(cuts[feature][cut])], numCategories=-1))
            return place

        add(0, 0)
        return rows


def _scale(n: int, largest: float) -> float:
    """The power of two that labels up to `largest` are multiplied by, so that sums of n of them stay whole and exact."""
    return 2.0 ** math.floor(SUM_BITS - math.log2(max(n, 1) * largest)) if largest > 0 else 1.0


def boosted(blocks: Blocks, depth: int, trees: int, rate: float, draw: Draw | None, share: str, bins: int, seed: int, cut_every: int) -> list[Tree]:
    """One tree after the other, each fitted to what the ones before have left. Of two sister nodes only the one with fewer rows is
    added up; the other is what remains of their parent."""
    width, n_cuts = len(blocks.cuts), np.array([len(c) for c in blocks.cuts])

    def level_tables(tree: int, levels: list, places: np.ndarray, scale: float):
        asked = int(places.max()) + 1

        def run(part: Iterator) -> Iterator[tuple]:
            tables, seen = None, (0.0, 0.0)
            for (columns, seats), (rest, squares, largest) in part:
                if tables is None:
                    tables = np.zeros((2, width, asked * bins))
                label, times = np.rint(rest * scale), None
                if draw is not None:
                    times = draw.rows(seats, tree).astype(float)
                    label *= times
                add_up(tables, columns, places[slots(columns, levels)] * bins, label, times)
                seen = seen[0] + squares, max(seen[1], largest)
            if tables is not None:
                yield tables, *seen

        return run

    def after(grown: Tree, tree: int):
        levels, means, step = grown.levels, grown.means(), 1.0 if tree == 0 else GRADIENT * rate

        def run(block: tuple) -> tuple:
            (columns, seats), (rest, _, _) = block
            slot = slots(columns, levels)
            times = 1.0 if draw is None else draw.rows(seats, tree)
            squares = np.bincount(slot, weights=rest * rest * times, minlength=len(means))
            left = rest - step * means[slot]
            return left, squares, float(np.abs(left).max(initial=0.0))

        return run, step * float(np.abs(means).max(initial=0.0))

    both = lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2]))
    state, grown, largest, earlier = blocks.labels, [], blocks.largest, None
    try:
        for tree in range(trees):
            new, at = Tree(_scale(blocks.n, largest)), blocks.bins.zip(state)
            tables, pairs, parents = {}, [(0,)], {}
            for level in range(depth):
                # of each pair the smaller one; its sister is the parent's rest
                small = [min(pair, key=lambda s: (new.totals[level, s][0], s)) if level else 0 for pair in pairs]
                places = np.full(1 << level, -1, np.intp)
                places[small] = np.arange(len(small))
                found, squares, seen = at.mapPartitions(level_tables(tree, new.levels, places, new.scale)).reduce(both)
                if level == 0:
                    largest = seen
                    if tree > 0:
                        grown[-1].squares = squares
                    if tree > 1:
                        earlier.unpersist()
                own = found.reshape(2, width, len(small), bins).transpose(2, 0, 1, 3)
                tables = dict(zip(small, own))
                for pair, slot in zip(pairs, small):
                    for sister in set(pair) - {slot}:
                        tables[sister] = parents[slot >> 1] - tables[slot]
                if level == 0:
                    new.totals[0, 0] = tuple(tables[0][:, 0].sum(axis=1).tolist())
                asked = sorted(tables)
                allowed = features_of(share, tree, level, np.array(asked), width, seed)
                splits = best_splits(np.stack([tables[s] for s in asked], axis=1), n_cuts, allowed)
                pairs, parents = new.split(level, asked, splits), tables
                if not pairs:
                    break
            run, moved = after(new, tree)
            grown.append(new)
            earlier, state = state, _kept(at.map(run))
            largest += moved
            if (tree + 1) % cut_every == 0 and tree + 1 < trees:
                state.checkpoint()
        grown[-1].squares = state.map(lambda block: block[1]).reduce(lambda a, b: a + b)
    finally:
        for rdd in (state, earlier):
            if rdd is not None and rdd is not blocks.labels:
                rdd.unpersist()
    return grown


def forest(blocks: Blocks, depth: int, trees: int, draw: Draw | None, share: str, bins: int, seed: int) -> list[Tree]:
    """All trees level by level, so many at a time as a task's tables have room for. Tables are exchanged by node, and nodes get
    their splits where their tables meet; the driver sees a row a node."""
    width, n_cuts = len(blocks.cuts), np.array([len(c) for c in blocks.cuts])
    scale = _scale(blocks.n, blocks.largest)
    at, parts = blocks.bins.zip(blocks.labels), blocks.bins.getNumPartitions()
    used = np.concatenate([f * bins + np.arange(len(c) + 1) for f, c in enumerate(blocks.cuts)])  # a table's bins that can hold rows

    def taken(columns: np.ndarray, seats: np.ndarray | None, label: np.ndarray, tree: int) -> tuple:
        if draw is None:
            return columns, label, None
        times = draw.rows(seats, tree)
        rows = np.flatnonzero(times)
        times = times[rows].astype(float)
        return columns.take(rows, axis=1), label[rows], times

    def level_tables(asked: dict[int, tuple[list, np.ndarray]], level: int):
        def run(part: Iterator) -> Iterator[tuple]:
            tables = {tree: np.zeros((2, width, (int(places.max()) + 1) * bins)) for tree, (_, places) in asked.items()}
            for (columns, seats), (label, _, _) in part:
                label = np.rint(label * scale)
                for tree, (levels, places) in asked.items():
                    own, rest, times = taken(columns, seats, label, tree)
                    place = places[slots(own, levels)] * bins
                    add_up(tables[tree], own, place, rest if times is None else rest * times, times)
            for tree, (_, places) in asked.items():
                table = tables.pop(tree).reshape(2, width, -1, bins).transpose(0, 2, 1, 3)
                for slot in np.flatnonzero(places >= 0):
                    counts, sums = table[:, places[slot]].reshape(2, -1)[:, used]
                    if counts.any():
                        yield tree << level | int(slot), (counts.astype(np.int32), sums)

        return run

    def split(level: int):
        def run(part: Iterator) -> Iterator[tuple]:
            tables: dict[int, np.ndarray] = {}
            for key, (counts, sums) in part:
                table = tables.setdefault(key, np.zeros((2, len(used))))
                table[0] += counts
                table[1] += sums
            for key, table in tables.items():
                whole = np.zeros((2, 1, width * bins))
                whole[:, 0, used] = table
                whole = whole.reshape(2, 1, width, bins)
                tree, slot = key >> level, key & ((1 << level) - 1)
                found = best_splits(whole, n_cuts, features_of(share, tree, level, np.array([slot]), width, seed))
                yield tree, slot, whole[:, 0, 0].sum(axis=1).tolist(), [x.item() for x in found]

        return run

    grown = [Tree(scale) for _ in range(trees)]
    active = {tree: [0] for tree in range(trees)}
    for level in range(depth):
        turns, room = [[]], 0
        for tree, asked in active.items():
            size = 16 * width * bins * len(asked)
            if turns[-1] and room + size > TABLE_BYTES:
                turns.append([])
                room = 0
            turns[-1].append(tree)
            room += size
        following = {}
        for turn in turns:
            plan = {}
            for tree in turn:
                places = np.full(1 << level, -1, np.intp)
                places[active[tree]] = np.arange(len(active[tree]))
                plan[tree] = grown[tree].levels, places
            keys = min(parts, sum(len(active[tree]) for tree in turn))
            found: dict[int, list] = {}
            by_node = at.mapPartitions(level_tables(plan, level)).partitionBy(keys, lambda key: key)
            for tree, slot, total, best in by_node.mapPartitions(split(level)).collect():  # one row a node
                if level == 0:
                    grown[tree].totals[0, 0] = tuple(total)
                found.setdefault(tree, []).append((slot, *best))
            for tree, rows in found.items():
                asked, *best = zip(*sorted(rows))
                pairs = grown[tree].split(level, list(asked), best)
                more = [s for pair in pairs for s in pair if grown[tree].totals[level + 1, s][0] > 1]
                if more:
                    following[tree] = more
        active = following
        if not active:
            break

    walks = [tree.levels for tree in grown]

    def squares(part: Iterator) -> Iterator[list[np.ndarray]]:
        sums = [np.zeros(1 << len(levels)) for levels in walks]
        for (columns, seats), (label, _, _) in part:
            for tree, levels in enumerate(walks):
                own, rest, times = taken(columns, seats, label, tree)
                sums[tree] += np.bincount(slots(own, levels), weights=rest * rest * (1.0 if times is None else times), minlength=len(sums[tree]))
        yield sums

    for tree, found in zip(grown, at.mapPartitions(squares).reduce(lambda a, b: [x + y for x, y in zip(a, b)])):
        tree.squares = found
    return grown


# --- MLlib's form ----------------------------------------------------------------------------------------------


NODE = pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
    ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
    ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])),
])


def _settings(spark: SparkSession, estimator) -> dict:
    """What MLlib writes about an estimator, with the name of its model."""
    path = scratch_path(spark, "estimator")
    estimator.write().save(path)
    found = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    kind = found["class"].replace("GBTRegressor", "GBTRegressionModel").replace("ForestRegressor", "ForestRegressionModel")
    return found | {"class": kind.replace("TreeRegressor", "TreeRegressionModel")}


def as_model(spark: SparkSession, estimator, blocks: Blocks, grown: list[Tree]) -> Model:
    """The trees as the model that `estimator` would give, put down in MLlib's saved form and loaded from there."""
    boosting = isinstance(estimator, GBTRegressor)
    later = lambda i: boosting and i > 0
    path = scratch_path(spark, "trees")
    settings = _settings(spark, estimator) | {"numFeatures": len(blocks.cuts), "numTrees": len(grown)}
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    plain = {name: estimator.getOrDefault(name) for name in ("maxDepth", "maxBins", "seed", "maxMemoryInMB")}
    tree = _settings(spark, DecisionTreeRegressor(**plain))
    weights = [(i, json.dumps(tree | {"uid": f"{tree['uid']}_{i}"}), estimator.getStepSize() if later(i) else 1.0) for i in range(len(grown))]
    spark.createDataFrame(weights, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes = [(i, node) for i, one in enumerate(grown) for node in one.nodes(blocks.cuts, GRADIENT if later(i) else 1.0)]
    table = pa.table({"treeID": pa.array([i for i, _ in nodes], pa.int32()), "nodeData": pa.array([node for _, node in nodes], NODE)})
    spark.createDataFrame(table).write.parquet(f"{path}/data")
    return DefaultParamsReader.loadParamsInstance(path, spark)


def draws(estimator) -> bool:
    """Whether trees are fitted to drawn rows, for which blocks need seats."""
    replaced = not isinstance(estimator, GBTRegressor) and estimator.getBootstrap()
    return replaced or estimator.getSubsamplingRate() < 1.0


def fit(estimator, blocks: Blocks) -> Model:
    """What `estimator`, a random forest or boosted trees, makes of the blocks."""
    replaced = not isinstance(estimator, GBTRegressor) and estimator.getBootstrap()
    depth, seed, share = estimator.getMaxDepth(), estimator.getSeed(), estimator.getFeatureSubsetStrategy()
    draw = Draw.of(estimator.getSubsamplingRate(), replaced, seed)
    if isinstance(estimator, GBTRegressor):
        grown = boosted(
            blocks, depth, estimator.getMaxIter(), estimator.getStepSize(), draw, share, estimator.getMaxBins(), seed,
            estimator.getCheckpointInterval())
    else:
        grown = forest(blocks, depth, estimator.getNumTrees(), draw, share, estimator.getMaxBins(), seed)
    return as_model(blocks.sparkSession, estimator, blocks, grown)
