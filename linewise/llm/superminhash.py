"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full sets, connected components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewise.llm.common import connected, in_small_batches, texts_of, tidy
from linewise.session import materialize

#: Fixed value: a word after lower-casing A-Z, over UTF-8 bytes.
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Bands, and rows of a band: a pair of similarity 0.8 shares no band once in 20 million times, (1 - 0.8 ** 4) ** 32.
BANDS, ROWS = 32, 4
#: Elements whose permutations are drawn at once, and shingles hashed at once.
BLOCK = 1 << 16
#: Sets are told apart by size in steps of this ratio.
SIZES = 1.1
UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `width` words; fewer words are one run, none give none."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n, hash_, parts = len(words) - width + 1, xxhash.xxh64_intdigest, []
    for at in range(0, n, BLOCK):
        end = min(n, at + BLOCK)
        cuts = zip(begins[at:end].tolist(), ends[at + width - 1 : end + width - 1].tolist())
        parts.append(np.unique(np.fromiter((hash_(joined[a:b]) for a, b in cuts), np.uint64, end - at)))
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lower(signature: np.ndarray, elements: np.ndarray, owner: np.ndarray) -> None:
    """Lowers `signature` (one row a set) by the elements, each of the set `owner`.

    Every element draws a random permutation of the positions, one place at a time, and offers step + fraction at the
    place of each step; a position keeps the least offer. Offers only grow from step to step, so an element stops
    at the first step that is above all its set's minima: a large set after a few steps, whatever the signature's length.
    All elements take a step together; the outcome is that of one after the other.
    """
    m, flat = signature.shape[1], signature.reshape(-1)
    places = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
    live = np.arange(len(elements))
    for step in range(m):
        open_ = signature.max(axis=1) >= np.uint64(step << 32)
        live = live[open_[owner[live]]]
        if not len(live):
            return
        drawn = _mix(elements[live] + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = step + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(m - step) >> np.uint64(32)).astype(np.int64)
        place = places[live, pick].astype(np.int64)
        places[live, pick] = places[live, step]
        np.minimum.at(flat, owner[live] * m + place, np.uint64(step << 32) | drawn >> np.uint64(32))


def signatures(sets: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash signatures, one row of `m` values a set; an empty set's values are all unset."""
    signature = np.full((len(sets), m), UNSET)
    at = 0
    while at < len(sets):  # as many sets as hold a block of elements; a larger one goes through block by block
        end, size = at + 1, len(sets[at])
        while end < len(sets) and size + len(sets[end]) <= BLOCK:
            size, end = size + len(sets[end]), end + 1
        elements = np.concatenate(sets[at:end])
        owner = np.repeat(np.arange(end - at), [len(x) for x in sets[at:end]])
        for i in range(0, size, BLOCK):
            _lower(signature[at:end], elements[i : i + BLOCK], owner[i : i + BLOCK])
        at = end
    return signature


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, the band's number included."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def _row_hashes() -> list[Column]:
    """Two hashes of id and text, 96 bits, that tell a row in a later scan."""
    return [F.xxhash64("doc_id", "text").alias("h1"), F.hash("doc_id", "text").alias("h2")]


def _marked(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, h1, h2, n, digest (of the set; NULL for an empty one) and bands of each row."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, width) for x in texts_of(batch.column("text"))]
            keys = bands(signatures(sets))
            digests = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
            new = [pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), listed]
            kept = [batch.column(c) for c in ("doc_id", "h1", "h2")]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=["doc_id", "h1", "h2", "n", "digest", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = in_small_batches(docs).select("doc_id", "text", *_row_hashes())
    return rows.mapInArrow(tidy(mark), f"doc_id {kind}, h1 bigint, h2 int, n bigint, digest binary, bands array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, items) for the classes of `wanted` (cls, h1, h2): their sets again, from the texts of these rows alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, width).view(np.int64) for x in texts_of(batch.column("text"))]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            items = pa.ListArray.from_arrays(starts, pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), items], names=["cls", "items"])

    rows = in_small_batches(docs).select("text", *_row_hashes()).join(wanted, ["h1", "h2"]).select("cls", "text")
    return rows.dropDuplicates(["cls"]).mapInArrow(tidy(cut), "cls bigint, items array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) that are similar enough, by their full sets."""
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("items").alias(f"{c}_items"))
    both = F.size(F.array_intersect("a_items", "b_items")).cast("long")
    union = F.size("a_items") + F.size("b_items") - both
    found = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * both >= percent * union)
    return materialize(found.select("a", "b"), "superminhash-links")


def _can_share(n: str, place: str, m, percent: int) -> Column:
    """Whether a set of n items has enough of them left from `place` on for the similarity with a set of m items."""
    return (100 + percent) * (F.col(n) - F.col(place)) >= percent * (F.col(n) + m)


def _rare_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of `members` (cls, n, root) with different roots, among them all that are similar enough.

    With the items of each set in one order, rarest first, the first item that two similar sets share leaves enough items after
    it in both, so it is near their beginnings: near copies meet at their rare items and not at what all of them have in common.
    Of an item's holders those of its commonest root are never paired with each other: only the others look for partners, by
    classes of size, which tell how near the beginning the item must be.
    """
    items = materialize(members.join(sets, "cls").select("cls", "n", "root", F.explode("items").alias("item")), "superminhash-items")
    held = items.groupBy("item").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("cls").orderBy("df", "item")) - 1
    size = lambda n: F.floor(F.log(SIZES, n.cast("double")) + 1e-9)
    early = items.join(held, "item").withColumn("place", place).where((F.col("df") > 1) & (100 * (F.col("n") - F.col("place")) >= percent * F.col("n")))
    early = materialize(early.select("item", "cls", "n", "root", "place", size(F.col("n")).alias("size")), "superminhash-early")
    roots = early.groupBy("item", "root").agg(F.count("*").alias("holders")).groupBy("item").agg(
        F.max_by("root", "holders").alias("common"), F.count("*").alias("roots")).where("roots > 1").select("item", "common")
    met = early.join(roots, "item")
    reach = int(np.ceil(np.log(100 / percent) / np.log(SIZES))) + 1
    least = F.greatest(F.pow(F.lit(SIZES), F.col("size")) * (1 - 1e-9), F.col("n") * percent / 100)
    seek = met.where("root <> common").select(
        "item", F.col("cls").alias("a"), F.col("n").alias("a_n"), F.col("root").alias("a_root"), F.col("place").alias("a_place"), "n",
        F.explode(F.sequence(F.col("size") - reach, F.col("size") + reach)).alias("size"))
    seek = seek.where(_can_share("a_n", "a_place", least, percent)).drop("n")
    pairs = seek.join(met, ["item", "size"]).where(
        (F.col("root") != F.col("a_root")) & ((F.col("root") == F.col("common")) | (F.col("cls") > F.col("a")))
        & _can_share("a_n", "a_place", F.col("n"), percent) & _can_share("n", "place", F.col("a_n"), percent))
    return pairs.select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct()


def _components(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(cls, root) of all classes with a link: classes that share a band and are similar enough are connected.

    Within a bucket (the classes with one key of a band) members are compared with a single one first, its hub: the
    member that shares most bands with others, hence the least changed of near copies, and the same in most bands. A bucket
    whose members are all connected by then has no more to say, nor has one of two members. Members of the other buckets are compared by
    their rare items; pairs in one component can't change the outcome and are never made.
    """
    keyed = classes.select("cls", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(keyed.join(shared, "key"), "superminhash-buckets")
    weights = materialize(members.groupBy("cls", "n").agg(F.sum("size").alias("weight")), "superminhash-weights")
    sets = materialize(_sets(docs, classes.join(weights.select("cls"), "cls").select("cls", "h1", "h2"), width), "superminhash-sets")
    hub = F.max(F.struct("weight", "cls", "n"))
    hubs = members.join(weights.drop("n"), "cls").groupBy("key").agg(hub.alias("hub"))
    alike = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
    pairs = members.join(hubs, "key").where(alike & (F.col("cls") != F.col("hub.cls"))).select(
        F.col("cls").alias("a"), F.col("hub.cls").alias("b")).distinct()
    roots = connected(_verified(pairs, sets, percent), "superminhash-near-hubs").select(F.col("node").alias("cls"), "root")
    placed = weights.select("cls", "n").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    placed = materialize(placed, "superminhash-placed")
    rooted = members.where("size > 2").select("key", "cls").join(placed, "cls")
    parted = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    left = materialize(rooted.join(parted, "key").select("cls", "n", "root").distinct(), "superminhash-open")
    if left.isEmpty():
        return placed.select("cls", "root")
    of = lambda c: left.select(F.col("cls").alias(c), F.col("root").alias(f"{c}_root"))
    late = _verified(_rare_pairs(left, sets, percent), sets, percent).join(of("a"), "a").join(of("b"), "b")
    joined = connected(late.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), "superminhash-late")
    return placed.join(joined.select(F.col("node").alias("root"), F.col("root").alias("into")), "root", "left").select(
        "cls", F.coalesce("into", "root").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept for each row of `docs` (doc_id, text).

    Two sets of `width`-word shingles are linked if their intersection is at least `percent` hundredths of their union,
    confirmed on the full sets. Rows with equal sets form a class by their digest before anything else, so copies are never
    paired. Shingles are told apart by 64-bit hashes, sets by 128 bits.

    NULL and wordless texts have no shingles and are linked with nothing, not with each other either. A NULL id takes the id
    of its component; one of NULL ids only has component_id NULL, and these rows are kept. Repeated rows stay, each with the
    same answer. A very long text is hashed block by block. Other columns are ignored. An empty table gives an empty result.
    """
    marked = materialize(_marked(docs, width).withColumn("row", F.monotonically_increasing_id()), "superminhash")
    full = marked.where("n > 0")
    # least id first (NULL last), and of its rows any one
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "h1", "h2", "n")).alias("first")
    grouped = full.groupBy("digest").agg(first).select(
        "digest", F.col("first.row").alias("cls"), *[F.col(f"first.{c}").alias(c) for c in ("doc_id", "h1", "h2", "n")])
    grouped = materialize(grouped, "superminhash-classes")
    drawn = full.select(F.col("row").alias("cls"), "bands").join(grouped.select("cls", "h1", "h2", "n"), "cls")
    roots = _components(docs, materialize(drawn, "superminhash-bands"), width, percent)
    placed = grouped.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = placed.select("digest", "root").join(least, "root").select("digest", "component_id")
    shown = lambda rows: rows.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
    alone = marked.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return shown(full.join(of, "digest")).unionByName(shown(alone))
