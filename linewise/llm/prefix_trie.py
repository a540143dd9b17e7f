"""Prefix trie of conversations: sorted turn sequences, common-prefix lengths, and range minima over them by sparse table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewise.llm.common import in_small_batches, tidy
from linewise.session import materialize

#: Bytes of the digest that stands for a turn, and for a sequence of turns.
DIGEST = 16
#: Turns that a task sorts and searches, on average.
TASK_TURNS = 200_000
#: Ids joined to one piece of text on their way to a digest.
CHUNK = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()

NODE = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
        "saved_tokens bigint, ends_sha256 string")
COLUMNS = re.findall(r"(\w+) \w+", NODE)
#: What a task returns: kind 0 is a finished node, 1 its part of a node that may go on in other tasks, 2 ids that end at such a node.
PART = f"kind int, task int, {NODE}, node binary, parent binary, n_bytes bigint, ids string"


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """conv_id and turns (array of digest and text bytes) of every conversation, its beginning taken from its group's first.

    Conversation c gets the first h turns of conversation c - c % group (all if it has fewer, none if it is absent), then
    its own turns after the first h, where h is the unsigned crc32 of c in decimal, modulo `most`; `most` 1 leaves all
    conversations as they are. Turns are ordered by `turn`, NULL first, equal ones by a hash of role and text. NULL role or
    text is empty; rows without a conv_id belong to no conversation. Texts are hashed where they are read: one exchange, by
    group, of a few bytes a turn. The turns of one group (`group` conversations, about twice that round zero) are together in a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))
    conv = F.col("conv_id").cast("bigint")
    turns = conversations.where("conv_id is not null").select(
        conv.alias("conv_id"), (conv - conv % group).alias("first"), "turn", digest.alias("digest"),
        F.octet_length(text).cast("bigint").alias("n_bytes"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "digest", "n_bytes")))
    whole = turns.repartition("first").groupBy("first", "conv_id").agg(ordered.alias("own"))
    base = F.max(F.when(F.col("conv_id") == F.col("first"), F.col("own"))).over(Window.partitionBy("first"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    joined = whole.withColumns({"base": base, "h": taken.cast("int")}).select("conv_id", F.concat(
        F.coalesce(F.slice("base", F.lit(1), F.col("h")), F.slice("own", F.lit(1), F.lit(0))),
        F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))).alias("turns"))
    return joined.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["n_bytes"].alias("n_bytes"))))


def chained(sequences: DataFrame) -> DataFrame:
    """conv_id, path and sizes: for each turn the digest of all turns up to it, and its bytes. Sequences with the same first d
    turns have paths with the same first d digests, so sorted by path they stand together."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes = [], []
            for turns in batch.column("turns").to_pylist():
                at, path = b"", []
                for turn in turns:
                    at = hashlib.blake2b(at + turn["digest"], digest_size=DIGEST).digest()
                    path.append(at)
                paths.append(b"".join(path))
                sizes.append(np.array([t["n_bytes"] for t in turns], "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(paths, pa.binary()), pa.array(sizes, pa.binary())],
                                             names=["conv_id", "path", "sizes"])

    return in_small_batches(sequences).mapInArrow(tidy(chain), "conv_id bigint, path binary, sizes binary")


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share: their digests are equal up to some place, and nowhere after it."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        at = slice(DIGEST * (middle - 1), DIGEST * middle)
        low, high = (middle, high) if a[at] == b[at] else (low, middle - 1)
    return low


class Minima:
    """Sparse table: minima of all runs of 2**k values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def reach(self, at: np.ndarray, least: np.ndarray, forward: bool) -> np.ndarray:
        """How many values, from `at` on or back from it, are not below `least`: a binary search for each place, halving the steps."""
        n, gone = len(self.levels[0]), np.zeros(len(at), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = 1 << k
            begin = at + gone if forward else at - gone - step + 1
            inside = (begin >= 0) & (begin + step <= n)
            ok = inside & (self.levels[k][np.where(inside, begin, 0)] >= least)
            gone += step * ok
        return gone

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of values first..last, both included: two overlapping runs."""
        found = np.empty(len(first), self.levels[0].dtype)
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        for k in np.unique(level):
            own = level == k
            found[own] = np.minimum(self.levels[k][first[own]], self.levels[k][last[own] - (1 << k) + 1])
        return found


class Forest:
    """The nodes of sorted distinct paths, in the order (first path that has it, depth): parents before children, and the nodes
    under one node in one run.

    Path i brings the nodes of depths over common[i], its common prefix with the path before it; the first path brings the root too.
    """

    def __init__(self, paths: list[bytes], counts: np.ndarray, least: np.ndarray, sizes: list[np.ndarray]):
        n = len(paths)
        length = np.array([len(p) // DIGEST for p in paths], np.int64)
        common = np.array([-1, *(_common(a, b) for a, b in zip(paths, paths[1:]))], np.int64)
        begin = np.concatenate([[0], np.cumsum(length - common)])
        self.first = np.repeat(np.arange(n), length - common)
        self.depth = np.arange(begin[-1]) - begin[self.first] + common[self.first] + 1
        table = Minima(common)
        # members of (i, d): as far to both sides as the common prefixes stay at d or more; the parent's reach to the left says which path brings it
        self.last = self.first + table.reach(self.first + 1, self.depth, True)
        left = self.first - table.reach(self.first, self.depth, False)
        above = self.first - table.reach(self.first, self.depth - 1, False)
        self.parent = np.where(self.depth > 0, begin[above] + self.depth - 1 - common[above] - 1, -1)
        total = np.concatenate([[0], np.cumsum(counts)])
        self.n_convs = total[self.last + 1] - total[left]
        self.conv_id = Minima(least).between(left, self.last)
        self.n_bytes = np.zeros(len(self.depth), np.int64)
        flat, at = np.concatenate([*sizes, np.zeros(1, np.int64)]), np.concatenate([[0], np.cumsum(length)])
        deep = self.depth > 0
        self.n_bytes[deep] = flat[at[self.first[deep]] + self.depth[deep] - 1]
        self.n_children = np.bincount(self.parent[deep], minlength=len(self.depth))
        self.under = begin[self.last + 1]  # the run of nodes under node x is x..under[x]
        self.ends = begin[1:] - 1  # the node that path i ends at

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sum of `values` over each node's subtree."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.under] - total[: len(values)]


def _ids(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a task's share, sorted by (path, conv_id).

    Nodes on the first and the last path of the share may have members in other shares; all others are whole here.
    """
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is None or not len(table):
        return
    task = TaskContext.get().partitionId()
    every, conv = table.column("path").to_pylist(), table.column("conv_id").to_numpy()
    starts = np.array([i for i in range(len(every)) if not i or every[i] != every[i - 1]] + [len(every)], np.int64)
    paths = [every[i] for i in starts[:-1]]
    sizes = [np.frombuffer(x, "<i8") for x in table.column("sizes").take(pa.array(starts[:-1])).to_pylist()]
    t = Forest(paths, np.diff(starts), conv[starts[:-1]], sizes)
    is_open = (t.first == 0) | (t.last == len(paths) - 1)
    leaves, saved = t.below(t.n_children == 0), t.below((t.n_convs - 1) * t.n_bytes)
    # what closed nodes give to the open node above them
    hangs = ~is_open & np.where(t.parent >= 0, is_open[t.parent], False)
    given = np.zeros((3, len(t.depth)), np.int64)
    for sums, values in zip(given, (np.ones(len(t.depth), np.int64), leaves, saved)):
        np.add.at(sums, t.parent[hangs], values[hangs])

    def key(nodes: np.ndarray, up: int) -> list[bytes]:
        return [paths[i][max(0, DIGEST * (d - 1 - up)) : DIGEST * max(0, d - up)] for i, d in zip(t.first[nodes].tolist(), t.depth[nodes].tolist())]

    ends = np.full(len(t.depth), EMPTY, object)
    chunks = []
    for i, node in enumerate(t.ends):
        own = conv[starts[i] : starts[i + 1]]
        if not is_open[node]:
            ends[node] = hashlib.sha256(_ids(own).encode()).hexdigest()
        else:
            chunks += [(int(own[j]), paths[i][-DIGEST:], _ids(own[j : j + CHUNK])) for j in range(0, len(own), CHUNK)]

    def rows(kind: int, n: int, **columns) -> pa.RecordBatch:
        kinds = {"kind": pa.int32(), "task": pa.int32(), "ends_sha256": pa.string(), "node": pa.binary(), "parent": pa.binary(), "ids": pa.string()}
        columns |= {"kind": np.full(n, kind), "task": np.full(n, task)}
        names = ["kind", "task", *COLUMNS, "node", "parent", "n_bytes", "ids"]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names=names)

    done, held = np.flatnonzero(~is_open), np.flatnonzero(is_open)
    for at in range(0, len(done), 1 << 14):
        x = done[at : at + (1 << 14)]
        yield rows(0, len(x), conv_id=t.conv_id[x], depth=t.depth[x], n_convs=t.n_convs[x], n_children=t.n_children[x], n_leaves=leaves[x],
                   saved_tokens=saved[x], ends_sha256=ends[x], parent=[k if h else None for k, h in zip(key(x, 1), hangs[x])],
                   parent_conv_id=pa.array(t.conv_id[t.parent[x]], mask=hangs[x]))
    yield rows(1, len(held), conv_id=t.conv_id[held], depth=t.depth[held], n_convs=t.n_convs[held], n_children=given[0][held],
               n_leaves=given[1][held], saved_tokens=given[2][held], node=key(held, 0), parent=key(held, 1), n_bytes=t.n_bytes[held])
    for first, node, ids in chunks:
        yield rows(2, 1, conv_id=[first], node=[node], ids=[ids])


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole values of the nodes that several tasks share. There are two paths of them a task, whatever the number of conversations."""
    nodes = {r["node"]: r for b in batches for r in b.to_pylist()}
    order = sorted(nodes.values(), key=lambda r: -r["depth"])
    for r in order:
        r["n_leaves"] += r["n_children"] == 0 and not r.get("inner", False)
        r["saved_tokens"] += (r["n_convs"] - 1) * r["n_bytes"]
        r["parent_conv_id"] = None
        if r["depth"]:
            up = nodes[r["parent"]]
            up["inner"] = True
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
            r["parent_conv_id"] = up["conv_id"]
    names = ["node", *[c for c in COLUMNS if c != "ends_sha256"]]
    if order:
        kinds = [pa.binary(), *[pa.int64()] * (len(names) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in order], k) for c, k in zip(names, kinds)], names=names)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, which arrive piece by piece in order; nothing but the running digest is held."""
    at, running = None, None
    for batch in batches:
        found = []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if node != at:
                found += [] if at is None else [(at, running.hexdigest())]
                at, running = node, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.binary()), pa.array([d for _, d in found])], names=["node", "digest"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([running.hexdigest()])], names=["node", "digest"])


def trie(sequences: DataFrame) -> DataFrame:
    """One row for each distinct beginning of `sequences` (conv_id, turns), the textless root included: conv_id (its smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Paths are sorted over all tasks, (path, conv_id) being different for every conversation, so that neither a turn nor a
    whole conversation that very many share makes a share larger. In each share, every candidate (path, depth) finds its
    members' interval by two binary searches in a sparse table of common-prefix minima; sums over subtrees are differences of
    running sums, for a subtree's nodes stand in one run. Only nodes on a share's first and last path are put together across
    shares: their parts are grouped by node, and the tree of what is left, two paths a share, is summed in one task.

    saved_tokens is the sum, over the subtree's nodes, of (n_convs - 1) times the bytes of the node's last text; ends_sha256
    digests the decimal ids that end at the node, ascending. No sequences give no rows; a sequence without turns ends at the root.
    """
    spark = sequences.sparkSession
    paths = materialize(chained(sequences), "trie-paths")
    turns = paths.agg(F.sum(F.length("path"))).first()[0] or 0
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // DIGEST // TASK_TURNS + 1)
    dealt = paths.repartitionByRange(shares, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = materialize(dealt.mapInArrow(tidy(_search), PART), "trie-parts")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.where("kind = 1").groupBy("node", "parent", "depth", "n_bytes").agg(F.min("conv_id").alias("conv_id"), *sums)
    whole_kind = "node binary, " + ", ".join(f"{c} bigint" for c in COLUMNS if c != "ends_sha256")
    shared = materialize(merged.repartition(1).mapInArrow(tidy(_sum_up), whole_kind), "trie-shared")
    ids = parts.where("kind = 2").select("node", "conv_id", "ids").repartition("node").sortWithinPartitions("node", "conv_id")
    digests = ids.mapInArrow(tidy(_digest), "node binary, digest string")
    joint = shared.join(digests, "node", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(EMPTY)))
    # the share is part of the key: children of one node come from many shares, each with its own copy of the answer
    answers = parts.where("kind = 1").select("task", F.col("node").alias("parent")).join(
        shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("answer")), "parent")
    closed = parts.where("kind = 0")
    hanging = closed.where("parent is not null").join(answers, ["task", "parent"]).withColumn("parent_conv_id", F.col("answer"))
    return closed.where("parent is null").select(*COLUMNS).unionByName(hanging.select(*COLUMNS)).unionByName(joint.select(*COLUMNS))
