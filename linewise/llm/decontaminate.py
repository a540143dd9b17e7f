"""Benchmark decontamination: an FM-index per training shard, searched for the phrases of test items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise.llm.common import in_small_batches, texts_of, tidy, with_free_names
from linewise.llm.fm_index import FMIndex
from linewise.session import materialize

#: Fixed value: a word after lower-casing A-Z, over UTF-8 bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words that one index holds at most.
SHARD_WORDS = 2_000_000
#: Bytes of test items that are searched (and broadcast) at once.
BLOCK_BYTES = 16 << 20


class Phrases:
    """Windows of the words of one block of test items, as numbers over the block's own words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        name_at = {name: i for i, name in enumerate(self.names)}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for name, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in WORD.findall(text.lower())]
            length = min(window, len(words))
            for i in range(len(words) - length + 1 if words else 0):
                by_length.setdefault(length, {}).setdefault(tuple(words[i : i + length]), set()).add(name_at[name])
        self.groups = []
        for length, found in sorted(by_length.items()):
            owners = [np.array(sorted(x), np.int64) for x in found.values()]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in owners])])
            self.groups.append((np.array(list(found), np.int64).reshape(-1, length), starts, np.concatenate(owners)))
        self.shortest = min(by_length, default=0)

    def occurrences(self, symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each phrase length: (length, positions, and the items as a list of owners with its starts per position)."""
        index = FMIndex(symbols, len(self.number) + 1)
        for phrases, starts, owners in self.groups:
            low, high = index.search(phrases)
            counts = high - low
            which = np.repeat(np.arange(len(phrases)), counts)
            rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
            if len(rows):
                n = starts[which + 1] - starts[which]
                item = owners[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[which], n)]
                yield phrases.shape[1], index.locate(rows), n, item


def _stretches(numbers: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and word positions of all stretches of known words that are long enough to hold a phrase.

    Words of no test item part the stretches, for no phrase can cross them.
    """
    known = np.concatenate([[False], numbers > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    begin, end = edges[::2], edges[1::2]
    keep = end - begin >= shortest
    begin, length = begin[keep], (end - begin)[keep] + 1
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)
    last = np.cumsum(length) - 1
    symbols = numbers[np.minimum(place, len(numbers) - 1)]
    symbols[last] = 0
    return symbols, place


class Shard:
    """Whole documents that share one index, and what was found in them."""

    def __init__(self, texts: list[bytes], phrases: Phrases):
        self.texts, self.phrases = texts, phrases
        words = [WORD.findall(x.lower()) for x in texts]
        self.n_words = np.array([len(x) for x in words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        get, numbers = phrases.number.get, np.zeros(self.start[-1], np.int64)
        for at, x in zip(self.start, words):
            numbers[at : at + len(x)] = np.fromiter((get(w, 0) for w in x), np.int64, len(x))
        self.hit = np.zeros(len(numbers) + 1, np.int64)
        pairs = [np.zeros((2, 0), np.int64)]
        if phrases.shortest and len(numbers):
            # pieces overlap by less than a phrase, so a document of any length is indexed in bounded memory
            longest = max(g[0].shape[1] for g in phrases.groups)
            for piece in range(0, len(numbers), SHARD_WORDS):
                symbols, place = _stretches(numbers[piece : piece + SHARD_WORDS + longest - 1], phrases.shortest)
                if len(symbols):
                    for length, found, n, item in phrases.occurrences(symbols):
                        at = place[found] + piece
                        np.add.at(self.hit, at, 1)
                        np.add.at(self.hit, at + length, -1)
                        doc = np.searchsorted(self.start, np.repeat(at, n), side="right") - 1
                        pairs.append(np.unique(np.stack([doc, item]), axis=1))
        self.hit = np.cumsum(self.hit)[:-1] > 0
        self.pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)

    def items(self) -> list[list[str]]:
        found: list[list[str]] = [[] for _ in self.texts]
        for doc, item in self.pairs.T:
            found[doc].append(self.phrases.names[item])
        return found

    def spans(self, doc: int) -> list[tuple[int, int]]:
        """Merged runs [first, end) of hit words."""
        hit = np.concatenate([[False], self.hit[self.start[doc] : self.start[doc + 1] - 1], [False]])
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """`text` without the words of `spans`; a line break stands in for each run."""
    if not spans:
        return text
    places = [m.span() for m in WORD.finditer(text.lower())]
    kept, at = [], 0
    for first, end in spans:
        kept += [text[at : places[first][0]], b"\n"]
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


def _merge(old: list[dict] | None, new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, end in sorted([*((x["first"], x["end"]) for x in old or ()), *new]):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((first, end))
    return merged


FOUND = "n_words bigint, spans array<struct<first: bigint, end: bigint>>, items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _searcher(phrases, keep_text: bool, cut: bool = False):
    """Mapper over (any columns, text, FOUND): adds what the block's phrases hit; `cut` then cuts all spans out of the texts."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = phrases.value
        for batch in batches:
            texts, at = texts_of(batch.column("text")), 0
            while at < len(texts):  # a shard: as many documents as hold SHARD_WORDS words, at six bytes a word
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= 6 * SHARD_WORDS:
                    size, end = size + len(texts[end]), end + 1
                shard, rows = Shard(texts[at:end], block), batch.slice(at, end - at)
                old = rows.column("spans").to_pylist(), rows.column("items").to_pylist()
                new = {
                    "n_words": pa.array(shard.n_words),
                    "spans": pa.array([[{"first": a, "end": b} for a, b in _merge(x, shard.spans(i))] for i, x in enumerate(old[0])], _SPANS),
                    "items": pa.array([sorted({*(x or ()), *y}) for x, y in zip(old[1], shard.items())], pa.list_(pa.string())),
                }
                if cut:
                    kept = [cut_words(t, [(x["first"], x["end"]) for x in s]) if s else None for t, s in zip(texts[at:end], new["spans"].to_pylist())]
                    whole = rows.column("text").cast(pa.binary()).to_pylist()
                    new["text"] = pa.array([t if k is None else k for t, k in zip(whole, kept)], pa.binary()).cast(pa.string())
                names = [c for c in batch.schema.names if keep_text or c != "text"]
                yield pa.RecordBatch.from_arrays([new[c] if c in new else rows.column(c) for c in names], names=names)
                at = end

    return search


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep_text: bool = False, cut: bool = False) -> DataFrame:
    """Adds n_words, spans (merged runs of hit words) and items (sorted ids as text) to `docs`, which has a column text.

    A phrase is `window` consecutive words of a test item, or the whole item if it has fewer. Each Arrow batch of
    documents is cut into shards; a shard gets an FM-index over its words, in which all phrases are searched backward
    at once. No document crosses the network. Test items come in blocks of bounded bytes: one block is broadcast and
    searched after the other, each continuing the spans of those before.

    NULL texts and texts without words have no spans; NULL or wordless items have no phrase. Repeated rows are judged
    one by one. An empty table of documents gives no rows, an empty one of items no spans. Columns of `docs` named n_words,
    spans or items, in any case, are replaced.
    """
    spark, docs = docs.sparkSession, docs.drop(*[c for c in docs.columns if c.lower() in ("n_words", "spans", "items")])
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    items = items.where("item is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    rows = in_small_batches(docs).withColumns({"n_words": F.lit(0).cast("bigint"), "spans": F.lit(None).cast("array<struct<first: bigint, end: bigint>>"),
                             "items": F.lit(None).cast("array<string>")})
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()  # BLOCK_BYTES at a time
        phrases = spark.sparkContext.broadcast(Phrases([(x["item"], bytes(x["text"])) for x in part], window))
        last = block == blocks - 1
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if keep_text or not last or f.name != "text")
        rows = rows.mapInArrow(tidy(_searcher(phrases, keep_text or not last, cut and last)), schema)
        if not last:
            rows = materialize(rows, "decontaminate")
            phrases.destroy()
    return rows


def digest(found: DataFrame) -> DataFrame:
    """One row per document: counts of words, hit words and items, and a digest of the items."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def remove_phrases(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """`docs` with the hit words cut out of their texts (and n_chars, if there, counted anew); other texts stay as they are.

    Cut and judged as find_phrases says. All columns and rows stay."""

    def work(rows: DataFrame) -> DataFrame:
        names = rows.columns
        left = find_phrases(rows, benchmark, window, keep_text=True, cut=True)
        if "n_chars" in names:
            left = left.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(rows.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
        return left.select(*names)

    return with_free_names(docs, {"n_words", "spans", "items"}, work)
