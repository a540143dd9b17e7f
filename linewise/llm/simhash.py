"""SimHash near-duplicates: fingerprints, meet-in-the-middle ball hashing, connected components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise.llm.common import connected, in_small_batches, texts_of, tidy, with_free_names
from linewise.session import materialize

#: Fixed value: a word after lower-casing A-Z, over UTF-8 bytes.
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Fixed value: seed of the shingle hash.
SEED = 42
#: Variants that a task sorts at once, and that a partition of variants holds on average.
VARIANTS = 2_000_000
#: Shingles hashed at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    """64 bits: bit set if set in over half the hashes of all shingles; 0 without words."""
    words = WORD.findall(text.lower())
    if not words:
        return 0
    joined, width = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n, ones, hash_ = len(words) - width + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        end = min(n, at + BLOCK)
        cuts = zip(begins[at:end].tolist(), ends[at + width - 1 : end + width - 1].tolist())
        hashes = np.fromiter((hash_(joined[a:b], SEED) for a, b in cuts), "<u8", end - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """`docs` (whose columns include text) with the column fp, a signed 64-bit fingerprint."""
    names = docs.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x, shingle) for x in texts_of(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], names=[*names, "fp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return in_small_batches(docs).mapInArrow(tidy(mark), f"{kinds}, fp bigint")


def _flips(bits: int, most: int) -> list[int]:
    """All masks of `bits` bits with at most `most` ones, by number of ones."""
    masks, last = [0], [(0, 0)]
    for _ in range(most):
        last = [(m | 1 << i, i + 1) for m, at in last for i in range(at, bits)]
        masks += [m for m, _ in last]
    return masks


def _collide(prefix: int, depth: int, fps: np.ndarray, radius: int, distance: int) -> Iterator[np.ndarray]:
    """Pairs of fingerprints that share a variant whose first `depth` bits are `prefix`; too many variants are parted by one more bit."""
    rest = 64 - depth
    gone = np.bitwise_count((fps >> np.uint64(rest) if depth else fps * np.uint64(0)) ^ np.uint64(prefix)).astype(np.int64)
    fps, gone = fps[gone <= radius], gone[gone <= radius]
    masks = [np.array(_flips(rest, r), np.uint64) for r in range(radius + 1)]
    if sum(int((gone == r).sum()) * len(masks[radius - r]) for r in range(radius + 1)) > VARIANTS and rest > radius:
        for bit in (0, 1):
            yield from _collide(prefix << 1 | bit, depth + 1, fps, radius, distance)
        return
    low = np.uint64((1 << rest) - 1)
    base = (fps & low) | np.uint64(prefix << rest & (1 << 64) - 1)
    made, source, flips = [], [], []
    for r in range(radius + 1):
        own = np.flatnonzero(gone == r)
        made.append((base[own][:, None] ^ masks[radius - r]).ravel())
        source.append(np.repeat(own.astype(np.int32), len(masks[radius - r])))
        if distance % 2:
            flips.append(np.tile(np.bitwise_count(masks[radius - r]) + np.uint8(r), len(own)))
    variants, owner = np.concatenate(made), np.concatenate(source)
    del made, source
    order = np.lexsort((np.concatenate(flips), variants)) if distance % 2 else np.argsort(variants)
    same = np.flatnonzero(variants[order[1:]] == variants[order[:-1]])
    if not len(same):
        return
    # a run of equal variants is linked to its first member, which is within `distance` of all: at an even distance all
    # members are within half of it; at an odd one the first is the nearest, and a run without a member within the
    # smaller half says nothing, as any linked pair also shares a variant that is within it from one of the two
    head = np.concatenate([[True], same[1:] != same[:-1] + 1])
    first = order[same[head]][np.cumsum(head) - 1]
    if distance % 2:
        near = np.concatenate(flips)[first] <= distance // 2
        first, same = first[near], same[near]
    pairs = np.unique(np.stack([owner[first], owner[order[same + 1]]]).astype(np.int64), axis=1)
    a, b = fps[pairs[0]], fps[pairs[1]]
    true = np.bitwise_count(a ^ b) <= distance
    yield np.stack([a[true], b[true]])


def links(fps: DataFrame, distance: int, total: int) -> DataFrame:
    """Verified links (a, b) that connect all of the distinct fingerprints `fps` (fp) within `distance` bits of each other.

    Two fingerprints that differ in at most `distance` bits share a variant within half of it from both. Variants are
    shuffled by their first bits; as a variant's prefix says which flips made it, a fingerprint travels once to each
    prefix within the radius, and its variants there are made after the exchange instead of before it: the same
    collisions, without 2,081 rows for every fingerprint. The prefix grows with the number of fingerprints, so a
    partition's share stays the same; a task parts a larger share by further bits.
    """
    radius = (distance + 1) // 2
    balls = len(_flips(64, radius))
    depth = min(24, max(6, int(total * balls // VARIANTS).bit_length() + 1))
    near = F.array(*[F.lit(m) for m in _flips(depth, radius)])
    prefix = F.shiftrightunsigned("fp", 64 - depth)
    sent = fps.select("fp", F.explode(near).alias("flip")).select(prefix.bitwiseXOR(F.col("flip")).alias("prefix"), "fp")

    def pair(batch: pa.Table) -> pa.Table:
        own = batch.column("fp").to_numpy().view(np.uint64)
        found = list(_collide(batch.column("prefix")[0].as_py(), depth, own, radius, distance)) or [np.zeros((2, 0), np.uint64)]
        a, b = np.concatenate(found, axis=1).view(np.int64)
        return pa.table({"a": a, "b": b})

    return sent.groupBy("prefix").applyInArrow(pair, "a bigint, b bigint")


def _components(marked: DataFrame, distance: int, first) -> DataFrame:
    """(fp, root, first) for each fingerprint of `marked`: its component, and the least `first` (a column over `marked`) among its rows.

    Rows with equal fingerprints meet in one grouped row before any link is sought, so copies are never paired."""
    classes = materialize(marked.groupBy("fp").agg(F.min(first).alias("first")), "simhash-classes")
    roots = connected(links(classes.select("fp"), distance, classes.count()), "simhash-links")
    joined = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return joined.withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable over links, for each row of `docs` (doc_id, text).

    NULL, empty and wordless texts have fingerprint zero and are linked like any other. NULL ids take the id of their
    component; a component of NULL ids only has component_id NULL. Repeated rows stay. An empty table gives none. Texts
    of any length are hashed whole, in blocks of shingles.
    """
    marked = materialize(fingerprints(docs.select("doc_id", "text"), shingle).drop("text"), "simhash")
    joined = _components(marked, distance, F.col("doc_id"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    of = joined.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """`docs` with one row of each component: that of the smallest doc_id (a NULL id is larger than all; of equal rows, any one)."""

    def work(rows: DataFrame) -> DataFrame:
        marked = materialize(fingerprints(rows, shingle).withColumn("row", F.monotonically_increasing_id()), "simhash")
        first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
        best = _components(marked.select("doc_id", "fp", "row"), distance, first).groupBy("root").agg(F.min("first").alias("first"))
        return marked.join(best.select(F.col("first.row").alias("row")), "row", "left_semi").drop("row", "fp")

    return with_free_names(docs, {"row", "fp"}, work)
