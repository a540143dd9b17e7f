"""Approximate nearest neighbours: cross-polytope hashing with multiprobe tables, exact scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewise.session import materialize

#: Rows of one side of a bucket that meet in one task; larger buckets are split into blocks.
BLOCK = 4096
#: Queries that the exact scan takes at once.
SCAN = 2048
#: Norms of a band differ by this factor at most; where there are several bands, those of at most SMALL_BAND rows are compared outright.
BAND, SMALL_BAND = 1.25, 2048
SEED = 11


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Each row times the normalised Hadamard matrix, by the fast transform."""
    n, width, half = len(x), x.shape[1], 1
    while half < width:
        pairs = x.reshape(n, -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def _rotate(x: np.ndarray, table: int) -> np.ndarray:
    """A pseudo-random rotation: three times random signs and a Hadamard transform."""
    signs = np.random.default_rng([SEED, table, x.shape[1]]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = _hadamard(x * s)
    return x


def _directions(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, with zeros up to a power-of-two width."""
    n, dim = vectors.shape
    out = np.zeros((n, 1 << int(dim).bit_length()))
    out[:, :dim] = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    return out


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each width, and their vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[starts[rows][:, None] + np.arange(dim)]


_HASHED = "dim int, hash_table int, bucket int, cid bigint, vector array<double>"


def _hasher(tables: int, probes: int, query: bool):
    """Mapper from (cid, vector) to one row a table (candidates) or one a table and probe (queries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _matrices(batch.column("vector")):
                points = _directions(vectors)
                for table in range(tables):
                    turned = _rotate(points, table)
                    # axis i is bucket 2i towards plus and 2i+1 towards minus
                    signed = np.stack([turned, -turned], axis=2).reshape(len(rows), -1)
                    taken = min(probes if query else 1, signed.shape[1])
                    best = np.argpartition(-signed, taken - 1, axis=1)[:, :taken]
                    at = np.repeat(rows, taken)
                    whole = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), vectors.shape[1], np.int32)), pa.array(np.full(len(at), table, np.int32)), pa.array(best.ravel().astype(np.int32)),
                         whole.column("cid"), whole.column("vector")], names=["dim", "hash_table", "bucket", "cid", "vector"])

    return run


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pa.Table:
    """For each query the k nearest of `vectors`, ties to the smaller id, scored in double precision."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(queries), 256):
        some = queries[at : at + 256]
        rough = some @ vectors.T
        if rough.shape[1] > k:
            bound = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
            q, c = np.nonzero(rough >= (bound - 1e-9 * (1 + np.abs(bound)))[:, None])
        else:
            q, c = np.divmod(np.arange(rough.size), rough.shape[1])
        score = (some[q] * vectors[c]).sum(axis=1)
        order = np.lexsort((ids[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        found.append((query_ids[at + q[keep]], ids[c[keep]], score[keep]))
    return pa.table(dict(zip(("qid", "cid", "score"), (np.concatenate(x) for x in zip(*found)))))


def _parted(rows: DataFrame, other: DataFrame, own_side: str, other_side: str) -> DataFrame:
    """`rows` of a bucket dealt into its own blocks by id, and repeated for the other side's blocks.

    There are at most tables x twice the width such counts, and one, for each width of vectors, so they are broadcast."""
    sizes = lambda x, name: x.groupBy("dim", "hash_table", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    key = ["dim", "hash_table", "bucket"]
    both = rows.join(F.broadcast(sizes(rows, "own_n")), key).join(F.broadcast(sizes(other, "other_n")), key)
    return both.select(*key, "cid", "vector", F.pmod(F.xxhash64("cid"), F.col("own_n")).cast("int").alias(own_side),
                       F.explode(F.sequence(F.lit(0), F.col("other_n") - 1)).alias(other_side))


def _vectors(x: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return x.column("cid").to_numpy(), next(_matrices(x.column("vector")))[1]


def nearest(vectors: DataFrame, is_query, k: int = 20, tables: int = 8, probes: int = 20) -> DataFrame:
    """The k nearest rows by inner product of each query among the rows of `vectors` (vec_id, embedding) but itself:
    query_id, rank from 1, vec_id, score; ties to the smaller vec_id. `is_query` is a condition on vec_id.

    Equal vectors form one class: it is hashed and compared once, and stands for its k + 1 smallest ids, which is all
    that a list of k can take from it. Tables go by direction alone, so that a few long vectors don't move the others.
    A list takes from each band of like norms those of the likest direction. They are a small share of a large band, so
    the tables find them; of a small band they may be most, so every query is compared with all of it (one more bucket).
    Other classes are in one bucket of each table, and a query looks into its `probes` nearest buckets of each. Buckets are
    compared in blocks, and scores come from the original vectors. Queries that the tables give too few rows for are
    answered by an exact scan in blocks of queries.

    Rows with a NULL id, and vectors that are NULL, empty, zero or hold NULL or non-finite components, take no part.
    Vectors of different widths are never compared. Rows that repeat an id with its vector count once; an id's own rows
    are not among its neighbours.
    """
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    rows = vectors.where(ok).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0)).distinct()
    first = Window.partitionBy("vector").orderBy("vec_id")
    classes = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    classes = classes.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    classes = materialize(classes.select(F.col("members")[0].alias("cid"), "vector", "members"), "nearest-classes")
    queries = rows.where(is_query).join(classes.select("cid", "vector"), "vector").select(F.col("vec_id").alias("query_id"), "cid")
    queries = materialize(queries, "nearest-queries")
    asked = classes.join(queries.select("cid").distinct(), "cid", "left_semi").select("cid", "vector")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    banded = classes.select(F.size("vector").alias("dim"), F.coalesce(F.round(F.log(norm) / math.log(BAND)).cast("int"), F.lit(-1 << 31)).alias("band"), "cid", "vector")
    # as many rows as there are powers of BAND among floating numbers at most, for each width
    sizes = banded.groupBy("dim", "band").agg(F.count("*").alias("n")).withColumn("bands", F.count("*").over(Window.partitionBy("dim")))
    banded = banded.join(F.broadcast(sizes), ["dim", "band"]).withColumn("small", (F.col("bands") > 1) & (F.col("n") <= SMALL_BAND))
    outright = lambda x: x.select(F.size("vector").alias("dim"), F.lit(-1).alias("hash_table"), F.lit(0).alias("bucket"), "cid", "vector")
    cells = banded.where(~F.col("small")).select("cid", "vector").mapInArrow(_hasher(tables, probes, False), _HASHED)
    cells = materialize(cells.unionByName(outright(banded.where("small"))), "nearest-tables")
    looks = asked.mapInArrow(_hasher(tables, probes, True), _HASHED)
    looks = materialize(looks.unionByName(outright(asked)), "nearest-probes")
    key = ["dim", "hash_table", "bucket", "c", "q"]

    def rank(candidates: pa.Table, probing: pa.Table) -> pa.Table:
        if not candidates.num_rows or not probing.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _best(*_vectors(probing), *_vectors(candidates), k + 1)

    found = _parted(cells, looks, "c", "q").groupBy(*key).cogroup(_parted(looks, cells, "q", "c").groupBy(*key)).applyInArrow(rank, "qid bigint, cid bigint, score double")
    found = _leading(found.distinct(), k + 1)
    found = materialize(found, "nearest-found")
    listed = materialize(_listed(found, classes, queries, k), "nearest-listed")
    # whoever got fewer than k rows from the tables: all classes, for a block of queries at a time
    got = listed.groupBy("query_id").agg(F.count("*").alias("n"))
    short = materialize(queries.join(got, "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id", "cid"), "nearest-short")
    blocks = -(-short.select("cid").distinct().count() // SCAN)
    if not blocks:
        return listed
    parts = [listed.join(short, "query_id", "left_anti")]
    for block in range(blocks):
        some = short.where(F.pmod(F.xxhash64("cid"), F.lit(blocks)) == block)
        block_rows = asked.join(some.select("cid").distinct(), "cid", "left_semi").toArrow()
        scanned = _leading(classes.select("cid", "vector").mapInArrow(_scanner(block_rows, k + 1), "qid bigint, cid bigint, score double"), k + 1)
        parts.append(_listed(materialize(scanned, "nearest-scan"), classes, some, k))
    for part in parts[1:]:
        parts[0] = parts[0].unionByName(part)
    return parts[0]


def _scanner(block: pa.Table, k: int):
    asked = [(block.column("cid").to_numpy()[rows], x) for rows, x in _matrices(block.column("vector"))] if block.num_rows else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch.column("vector")):
                for ids, own in asked:
                    if own.shape[1] == x.shape[1]:
                        yield from _best(ids, own, batch.column("cid").to_numpy()[rows], x, k).to_batches()

    return run


def _leading(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def _listed(found: DataFrame, classes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Class lists as rows of ids, for every query of a class."""
    rows = found.join(classes.select("cid", "members"), "cid").select(F.col("qid").alias("of"), "score", F.explode("members").alias("vec_id"))
    rows = queries.withColumnRenamed("cid", "of").join(rows, "of").where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
