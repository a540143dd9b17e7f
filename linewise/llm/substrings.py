"""Removal of repeated 50-byte strings: column-wise construction over segments that lie at shared anchors."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise.llm.common import in_small_batches, texts_of, tidy
from linewise.session import materialize, scratch_path

#: Bytes of text that a shard holds (a longer text has a shard of its own), and that are hashed at once.
SHARD_BYTES, AT_ONCE = 4 << 20, 1 << 19
#: Anchor hashes that one task compares, on average.
BUCKET = 400_000
#: Segments that are ordered at once, and that are cut out at once.
ORDERED, CUT = 500_000, 8_192
#: How hard blobs are compressed: texts travel to their verdicts and back.
LEVEL = 3
#: Bytes that an anchor's hash covers.
CORE = 24
_ODD = 0x9E3779B97F4A7C15
LAST = np.iinfo(np.int64).max


def _slide(x: np.ndarray, width: int, take) -> np.ndarray:
    """`take` (minimum or maximum) over each stretch of `width` values."""
    size = 1
    while 2 * size <= width:
        x, size = take(x[:-size], x[size:]), 2 * size
    return take(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _core_hashes(symbols: np.ndarray) -> np.ndarray:
    """A hash, never 0, of the CORE bytes from each place."""
    power = lambda n: np.uint64(pow(_ODD, n, 1 << 64))
    h1 = symbols.astype(np.uint64) + np.uint64(1)
    levels = {1: h1}
    size = 1
    while 2 * size <= CORE:
        h = levels[size]
        levels[2 * size] = h[:-size] * power(size) + h[size:]
        size *= 2
    out, at = None, 0
    for size in sorted(levels, reverse=True):
        if CORE - at >= size:
            part = levels[size][at:]
            out = part if out is None else out[: len(part)] * power(size) + part[: len(out)]
            at += size
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out | np.uint64(1)


def anchors(symbols: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all anchors: the cores whose hash is the least in some string of `width` bytes of one text.

    `last` gives for each place the end of its text. Which core of a string is its anchor depends on the string alone, so
    equal strings have equal anchors at the same place in them.
    """
    within = width - CORE + 1
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at in range(0, max(0, len(symbols) - width + 1), AT_ONCE):
        # a string that begins in this stretch, and every core in it
        end = min(len(symbols), at + AT_ONCE + width - 1)
        h = _core_hashes(symbols[at:end])
        least = _slide(h, within, np.minimum)
        starts = np.arange(at, at + len(least))
        least = np.where(starts + width <= last[at : at + len(least)], least, np.uint64(0))
        none = np.zeros(within - 1, np.uint64)
        most = _slide(np.concatenate([none, least, none]), within, np.maximum)
        own = np.flatnonzero(most == h)
        places.append(own + at)
        hashes.append(h[own])
    places, hashes = np.concatenate(places), np.concatenate(hashes)
    # stretches overlap, so an anchor near their border may be found twice
    order = np.argsort(places, kind="stable")
    places, hashes = places[order], hashes[order]
    new = np.concatenate([[True], places[1:] != places[:-1]])[: len(places)]
    return places[new], hashes[new]


class Columns:
    """Segments laid side by side with their anchors in one column, read column by column from a file from last to first.

    Each round puts one symbol before the suffixes of all segments: the suffixes' order is sorted anew by that symbol
    alone, and the common prefix of neighbours is one more than the least of those between them before, or nothing if
    the symbols differ. The symbols in the order of the suffixes after them are that round's part of the collection's
    Burrows-Wheeler transform; as strings can only be equal in the same column, the parts of different columns never
    need merging. They and the columns go through unnamed files in sequence.
    """

    def __init__(self, matrix: np.ndarray):
        """`matrix`: a line for each segment; 0 for no byte, else the byte + 1."""
        self.n, self.width = matrix.shape
        # floor of the binary logarithm up to n, and room for the minima over stretches of so many places
        self.log = np.frexp(np.arange(self.n + 1, dtype=np.float64))[1].astype(np.uint8) - np.uint8(1)
        self.log[0] = 0
        self.levels = np.zeros((int(self.log[-1]) + 1, self.n), np.uint8)
        self.columns, self.transform = tempfile.TemporaryFile(), tempfile.TemporaryFile()
        for column in range(self.width - 1, -1, -1):
            matrix[:, column].astype("<u2").tofile(self.columns)
        self.columns.seek(0)

    def rounds(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each column from the last to the first: (column, order of the suffixes from there, common prefix of each with the one before it, up to `most`)."""
        order, common = np.arange(self.n), np.zeros(self.n, np.uint8)
        for column in range(self.width - 1, -1, -1):
            symbols = np.fromfile(self.columns, "<u2", self.n)[order]
            symbols.tofile(self.transform)
            by = np.argsort(symbols, kind="stable")
            now = symbols[by]
            same = np.concatenate([[False], (now[1:] == now[:-1]) & (now[1:] > 0)])
            common = np.where(same, np.minimum(self._least(common, by), most - 1) + 1, 0).astype(np.uint8)
            order = order[by]
            yield column, order, common
        self.columns.close()
        self.transform.close()

    def _least(self, common: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Least of common[a + 1 .. b] for each two neighbours (a, b) of `by` with a < b (others: anything)."""
        levels = self.levels
        levels[0] = common
        for k in range(1, len(levels)):
            step = 1 << k - 1
            np.minimum(levels[k - 1, : self.n - step], levels[k - 1, step:], out=levels[k, : self.n - step])
        a, b = by[:-1] + 1, by[1:]
        span = np.maximum(b - a + 1, 1)
        level = self.log[span]
        out = np.zeros(self.n, np.uint8)
        out[1:] = np.minimum(levels[level, np.minimum(a, self.n - 1)], levels[level, np.maximum(b + 1 - (1 << level.astype(np.int64)), 0)])
        return out


def earlier_strings(matrix: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """A line for each segment: whether the string of `width` bytes from each column on also begins, in the same column,
    in a segment of a smaller `least`."""
    found = np.zeros((len(matrix), matrix.shape[1] - width + 1), bool)
    for column, order, common in Columns(matrix).rounds(width):
        if column >= found.shape[1]:
            continue
        first = np.flatnonzero(common < width)
        smallest = np.minimum.reduceat(least[order], first)
        group = np.cumsum(common < width) - 1
        found[order, column] = smallest[group] < least[order]
    return found


def _packed(x: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(np.ascontiguousarray(x, kind).tobytes())


def _unpacked(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _shards(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) as rows of about SHARD_BYTES of text each: shard, ids, sizes, texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            whole = np.frombuffer(b"".join(texts), np.uint8)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([ids], pa.list_(pa.int64())), pa.array([_packed(np.array([len(x) for x in texts]), "<i8")], pa.binary()),
                 pa.array([_packed(whole, "u1")], pa.binary()), pa.array([len(whole)])], names=["shard", "ids", "sizes", "texts", "n_bytes"])

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                if ids and size + len(text) > SHARD_BYTES:
                    yield row()
                    shard, ids, texts, size = shard + 1, [], [], 0
                ids.append(name)
                texts.append(text)
                size += len(text)
        if ids:
            yield row()

    return in_small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run), "shard bigint, ids array<bigint>, sizes binary, texts binary, n_bytes bigint")


_SHARD = ["shard", "ids", "sizes", "texts", "n_bytes"]


def _written_by_shard(shards: DataFrame) -> DataFrame:
    """`shards` as a table in the shared folder, bucketed by shard: what is said about shards comes to their texts, which
    aren't exchanged again."""
    spark = shards.sparkSession
    path = scratch_path(spark, "substrings-shards")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards.write.format("parquet").option("path", path).bucketBy(partitions, "shard").saveAsTable(name)
    return spark.table(name)


class _Shard:
    def __init__(self, row: dict):
        self.ids = row["ids"]
        sizes = _unpacked(row["sizes"], "<i8")
        self.symbols = _unpacked(row["texts"], "u1")
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        # a NULL id is larger than all others
        self.order = np.array([LAST if x is None else x for x in self.ids], np.int64)

    def document_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")

    def anchors(self, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        small = np.uint32 if len(self.symbols) < 1 << 32 else np.int64
        places, hashes = anchors(self.symbols, np.repeat(self.ends.astype(small), self.ends - self.begins), width)
        return places, _codes(hashes, buckets)


def _rows(table) -> Iterator[dict]:
    for batch in table.to_batches() if isinstance(table, pa.Table) else table:
        for at in range(batch.num_rows):
            yield {name: batch.column(name)[at].as_py() for name in batch.schema.names}


def _shared_anchors(shards: DataFrame, width: int, buckets: int) -> DataFrame:
    """(shard, bucket, shared): a bit for each of the shard's different anchors of a bucket, in order of their codes:
    whether the anchor is found in two documents or more of the whole table."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            shard = _Shard(row)
            places, codes = shard.anchors(width, buckets)
            docs = shard.document_of(places)
            order = np.argsort(codes, kind="stable")
            codes, docs = codes[order], docs[order]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)])
            if not len(first):
                continue
            many = np.maximum.reduceat(docs, first) > np.minimum.reduceat(docs, first)
            codes = codes[first]
            bucket, low = codes >> 32, codes & 0xFFFFFFFF
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            spans = list(zip(cuts[:-1], cuts[1:]))
            steps = [_packed(np.diff(low[x:y], prepend=0), "<u4") for x, y in spans]
            flags = [_packed(np.packbits(many[x:y]), "u1") for x, y in spans]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(np.full(len(spans), row["shard"])), pa.array(steps, pa.binary()), pa.array(flags, pa.binary())], names=["bucket", "shard", "steps", "many"])

    def meet(rows: pa.Table) -> pa.Table:
        parts = [np.cumsum(_unpacked(x, "<u4").astype(np.int64)) for x in rows.column("steps").to_pylist()]
        sizes = [len(x) for x in parts]
        many = np.concatenate([np.unpackbits(_unpacked(x, "u1"), count=n) for x, n in zip(rows.column("many").to_pylist(), sizes)])
        _, group = np.unique(np.concatenate(parts), return_inverse=True)
        shared = ((np.bincount(group) > 1) | (np.bincount(group, many) > 0))[group]
        ends = np.cumsum(sizes)
        bits = [_packed(np.packbits(shared[y - n : y]), "u1") for y, n in zip(ends, sizes)]
        return pa.table({"shard": rows.column("shard"), "bucket": rows.column("bucket"), "shared": pa.array(bits, pa.binary())})

    sent = shards.select(*_SHARD).mapInArrow(tidy(send), "bucket bigint, shard bigint, steps binary, many binary")
    return sent.groupBy("bucket").applyInArrow(meet, "shard bigint, bucket bigint, shared binary")


def _known(codes: np.ndarray, replies: pa.Table) -> np.ndarray:
    """Those of a shard's codes that are shared, in order."""
    codes = np.unique(codes)
    bucket, found = codes >> 32, [np.zeros(0, np.int64)]
    for reply in _rows(replies):
        own = codes[np.searchsorted(bucket, reply["bucket"]) : np.searchsorted(bucket, reply["bucket"], side="right")]
        found.append(own[np.unpackbits(_unpacked(reply["shared"], "u1"), count=len(own)) > 0])
    return np.sort(np.concatenate(found))


def _codes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash, and 32 bits by which its anchors are told apart there. Two different anchors with the same
    code only mean that more is looked at."""
    # anchors have the least hashes around them, so their hashes are not even until they are mixed again
    mixed = hashes * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(_ODD)
    bucket = (mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return (bucket << np.uint64(32) | mixed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _inside(left: np.ndarray, size: np.ndarray, columns: int) -> np.ndarray:
    """A line for each segment: whether each column is in it."""
    column = np.arange(columns, dtype=np.int16)
    return (column >= left[:, None]) & (column < (left + size)[:, None])


def _segments(shards: DataFrame, shared: DataFrame, width: int, buckets: int) -> DataFrame:
    """Segments around the shared anchors, each different one of a shard once.

    Rows with bucket >= 0 hold segments for that bucket: number in the shard, first column, length, bytes, and the least
    order of the documents that have it. The row with bucket -1 tells where the shard's segments lie: number, place of the
    anchor, and whether its document comes after another of the shard that has the same segment.
    """
    before, across = width - CORE, 2 * width - CORE
    line = -(-across // 8) * 8

    def cut(rows: pa.Table, replies: pa.Table) -> pa.Table:
        out = {"bucket": [], "shard": [], "numbers": [], "ranges": [], "least": [], "bytes": []}
        for row in _rows(rows):
            shard = _Shard(row)
            places, own = shard.anchors(width, buckets)
            known = _known(own, replies)
            at = np.searchsorted(known, own)
            kept = known[np.minimum(at, len(known) - 1)] == own if len(known) else np.zeros(len(own), bool)
            places, own = places[kept], own[kept]
            if not len(places):
                continue
            doc = shard.document_of(places)
            first = np.maximum(shard.begins[doc], places - before)
            end = np.minimum(shard.ends[doc], places + width)
            left, size = first - (places - before), end - first
            # lines of whole 8-byte words; 0 stands outside of a segment's text
            padded = np.concatenate([np.zeros(before, np.uint8), shard.symbols, np.zeros(line, np.uint8)])
            matrix = np.lib.stride_tricks.sliding_window_view(padded, line)[places]
            matrix[:, across:] = 0
            for a in range(0, len(cropped := np.flatnonzero(size < across)), CUT):
                some = cropped[a : a + CUT]
                matrix[some] *= _inside(left[some], size[some], line)
            words = matrix.view(np.uint64)
            weights = np.random.default_rng(5).integers(0, 1 << 63, line // 8 + 2, np.uint64) * np.uint64(2) + np.uint64(1)
            mark = left.astype(np.uint64) * weights[-1] + size.astype(np.uint64) * weights[-2]
            for i in range(line // 8):
                mark += (words[:, i] ^ words[:, i] >> np.uint64(31)) * weights[i]
                mark ^= mark >> np.uint64(29)
            # equal segments share the one of the least order; a mark that two different ones have parts them again
            order = np.lexsort((shard.order[doc], mark))
            head = np.concatenate([[True], mark[order][1:] != mark[order][:-1]])
            like = order[np.flatnonzero(head)][np.cumsum(head) - 1]
            equal = np.zeros(len(places), bool)
            for a in range(0, len(places), CUT):
                some, other = order[a : a + CUT], like[a : a + CUT]
                equal[some] = (words[some] == words[other]).all(axis=1) & (left[some] == left[other]) & (size[some] == size[other]) & (own[some] == own[other])
            of = np.arange(len(places))
            of[order] = np.where(equal[order], like, order)
            later = shard.order[doc] > shard.order[doc[of]]
            single = np.flatnonzero(of == np.arange(len(places)))
            single = single[np.argsort(own[single], kind="stable")]
            number = np.empty(len(places), np.int64)
            number[single] = np.arange(len(single))
            add = lambda *row: [out[k].append(v) for k, v in zip(out, row)]
            add(-1, row["shard"], _packed(number[of], "<u4"), _packed(places, "<u4"), _packed(later, "u1"), b"")
            bucket = own[single] >> 32
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                some = single[a:b]
                add(int(bucket[a]), row["shard"], _packed(np.arange(a, b), "<u4"), _packed(np.stack([left[some], size[some]]), "u1"), _packed(shard.order[doc[some]], "<i8"), _packed(matrix[some, :across], "u1"))
        kinds = {"bucket": pa.int64(), "shard": pa.int64()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    return shards.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(cut, "bucket bigint, shard bigint, numbers binary, ranges binary, least binary, bytes binary")


def _earlier(segments: DataFrame, width: int) -> DataFrame:
    """(shard, numbers, ranges): the columns from which a segment's strings also begin in a document of smaller order, as first and last of each run."""
    across = 2 * width - CORE

    def meet(rows: pa.Table) -> pa.Table:
        rows = list(_rows(rows))
        numbers = [_unpacked(row["numbers"], "<u4").astype(np.int64) for row in rows]
        least = np.concatenate([_unpacked(row["least"], "<i8") for row in rows])
        owner, number = np.repeat(np.arange(len(rows)), [len(x) for x in numbers]), np.concatenate(numbers)
        matrix, at = np.empty((len(number), across), np.uint16), 0
        for row, own in zip(rows, numbers):
            here = matrix[at : at + len(own)]
            here[:] = _unpacked(row["bytes"], "u1").reshape(-1, across)
            here += 1
            left, size = _unpacked(row["ranges"], "u1").astype(np.int64).reshape(2, -1)
            cropped = np.flatnonzero(size < across)
            here[cropped] *= _inside(left[cropped], size[cropped], across)
            at += len(own)
        # parts by the anchor's bytes hold all segments that can share a string
        core = _core_hashes(np.zeros(CORE, np.uint8)) if not len(matrix) else _matrix_cores(matrix[:, width - CORE : width])
        parts = -(-len(matrix) // ORDERED)
        hit = np.zeros((len(matrix), across - width + 3), np.int8)  # with a border on both sides
        if parts == 1:
            hit[:, 1:-1] = earlier_strings(matrix, least, width)
        for part in range(parts if parts > 1 else 0):
            some = np.flatnonzero(core % np.uint64(parts) == part)
            if len(some):
                hit[some, 1:-1] = earlier_strings(matrix[some], least[some], width)
        edge = np.diff(hit, axis=1)
        segment, first = np.nonzero(edge > 0)
        runs = np.stack([first, np.nonzero(edge < 0)[1] - 1])
        who, names = owner[segment], number[segment]
        cuts = [np.flatnonzero(who == i) for i in np.unique(who)]
        return pa.table({"shard": pa.array([rows[int(who[c[0]])]["shard"] for c in cuts], pa.int64()), "numbers": pa.array([_packed(names[c], "<u4") for c in cuts], pa.binary()),
                         "ranges": pa.array([_packed(runs[:, c], "u1") for c in cuts], pa.binary())})

    return segments.where("bucket >= 0").groupBy("bucket").applyInArrow(meet, "shard bigint, numbers binary, ranges binary")


def _matrix_cores(core: np.ndarray) -> np.ndarray:
    """A hash of each line of core bytes."""
    out = np.zeros(len(core), np.uint64)
    for column in core.T:
        out = (out ^ column.astype(np.uint64)) * np.uint64(_ODD)
        out ^= out >> np.uint64(31)
    return out


def remove_repeats(docs: DataFrame, width: int = 50, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (first byte, end) for each row of `docs` (doc_id, text),
    and the bytes that stay if `keep_text`.

    A byte goes if a string of `width` bytes that covers it also begins in a document of smaller doc_id. Each string has
    an anchor, the core in it with the least hash. Shards send their anchors' hashes, each once, to buckets; those of two
    or more documents come back, and only around them are segments cut, each different one of a shard once (so a group
    of copies goes out as often as there are shards, not copies). A bucket lays its segments out at their anchors and
    orders them column by column; strings whose common prefix is `width` long take the least order of their documents.
    What is found returns to the shards, which mark, cut and digest their own texts. Every string is judged, by its bytes.

    Needs width > CORE and 2 * width - CORE < 256. NULL and empty texts, and texts shorter than `width`, keep all. Rows
    of equal doc_id are not smaller than each other. A NULL doc_id is larger than all others.
    """
    shards = _written_by_shard(_shards(docs))
    total = shards.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = int(2 * total / (width - CORE + 2) // BUCKET) + 1
    shared = materialize(_shared_anchors(shards, width, buckets), "substrings-anchors")
    segments = materialize(_segments(shards, shared, width, buckets), "substrings-segments")
    found = _earlier(segments, width).select("shard", "numbers", "ranges", F.lit(None).cast("binary").alias("least"))
    found = materialize(found.unionByName(segments.where("bucket = -1").select("shard", "numbers", "ranges", "least")), "substrings-found")
    before = width - CORE

    def mark(rows: pa.Table, verdicts: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": [], "kept": []}
        verdicts = list(_rows(verdicts))
        for row in _rows(rows):
            shard = _Shard(row)
            change = np.zeros(len(shard.symbols) + 1, np.int32)
            for where in (x for x in verdicts if x["least"] is not None):
                number, places, later = _unpacked(where["numbers"], "<u4").astype(np.int64), _unpacked(where["ranges"], "<u4").astype(np.int64), _unpacked(where["least"], "u1") > 0
                doc = shard.document_of(places)
                np.add.at(change, np.maximum(shard.begins[doc], places - before)[later], 1)
                np.add.at(change, np.minimum(shard.ends[doc], places + width)[later], -1)
                order = np.argsort(number, kind="stable")
                number, places = number[order], places[order]
                for x in (x for x in verdicts if x["least"] is None):
                    names, runs = _unpacked(x["numbers"], "<u4").astype(np.int64), _unpacked(x["ranges"], "u1").astype(np.int64).reshape(2, -1)
                    low, high = np.searchsorted(number, names), np.searchsorted(number, names, side="right")
                    n = high - low
                    at = places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)] - before
                    np.add.at(change, at + np.repeat(runs[0], n), 1)
                    np.add.at(change, at + np.repeat(runs[1], n) + width, -1)
            gone = np.cumsum(change[:-1]) > 0
            for name, a, b in zip(shard.ids, shard.begins.tolist(), shard.ends.tolist()):
                own = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]])))
                kept = shard.symbols[a:b][~own].tobytes() if len(edges) else shard.symbols[a:b].tobytes()
                spans = [{"first": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()]
                for k, v in zip(out, (name, b - a, b - a - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept)):
                    out[k].append(v)
        if not keep_text:
            out.pop("kept")
        kinds = {"kept_sha256": pa.string(), "kept": pa.binary(), "spans": pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<first: bigint, end: bigint>>" + ", kept binary" * keep_text
    return shards.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(mark, schema)
