"""Ranked lexical search: documents reduced to the query items' vocabulary, equal bags of words scored once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewise.llm.common import in_small_batches, texts_of, tidy
from linewise.session import materialize

#: Fixed value: a term after lower-casing A-Z, over UTF-8 bytes.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of query items that are broadcast and searched at once.
BLOCK_BYTES = 4 << 20
#: Numbers in one matrix of a task: bags times terms, and bags times items.
CELLS = 1 << 22
#: Whole numbers up to here are exact in doubles.
EXACT = 1 << 53


class Items:
    """The distinct terms of a block of query items: numbers for the terms, and which items hold which."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.number: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        terms = [sorted({self.number.setdefault(t, len(self.number)) for t in TERM.findall(text.lower())}) for _, text in items]
        self.sizes = np.array([len(t) for t in terms], np.int64)
        self.item = np.repeat(np.arange(len(items)), self.sizes)
        self.term = np.array([t for own in terms for t in own], np.int64)


def _bags(docs: DataFrame, items) -> DataFrame:
    """doc_id, n (terms of the whole text) and bag of each row: the counts of the items' terms in it, as (term, count) pairs of
    little-endian 64-bit numbers in ascending order of terms; NULL if it has none of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = items.value.number.get
        for batch in batches:
            sizes, bags = [], []
            for text in texts_of(batch.column("text")):
                terms = TERM.findall(text.lower())
                found = Counter(map(get, terms))
                found.pop(None, None)
                sizes.append(len(terms))
                bags.append(np.array(sorted(found.items()), "<i8").tobytes() if found else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())],
                                             names=["doc_id", "n", "bag"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(tidy(count), f"doc_id {kind}, n bigint, bag binary")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df): a task's documents that hold a term, one row a term."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        held = b"".join(x for x in batch.column("bag").to_pylist() if x)
        found = np.bincount(np.frombuffer(held, "<i8")[::2])
        if len(found) > len(total):
            total, found = found, total
        total[: len(found)] += found
    term = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], names=["term", "df"])


def _scorer(items, weights, top: int):
    """Mapper over bags (cls, least, m, bag): the `top` best bags a task has for each item, equal scores by least id.

    A bag's row of w * ((1000000000 * tf) div (1000 * tf + 20 * m)) times the matrix of which item holds which term, block by
    block. The products are whole numbers; where an item could sum up to more than doubles hold, integers do it.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, w = items.value, weights.value
        n_items, n_terms = len(block.ids), len(block.number)
        most = int(w.max(initial=0)) * 1_000_000 * int(block.sizes.max(initial=0))
        kind = np.float64 if most < EXACT else np.int64
        holds = np.zeros((n_terms, n_items), kind)
        holds[block.term, block.item] = 1
        rows = max(1, CELLS // max(n_terms, n_items, 1))
        # the best so far: for each item a list of (score, no id, least id, class)
        best = [np.zeros((0, 4), np.int64) for _ in range(n_items)]

        def merge(cls, least, none, m, bags):
            parts = [np.frombuffer(b, "<i8").reshape(-1, 2) for b in bags]
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            term, tf = np.concatenate(parts).T
            gains = np.zeros((len(parts), n_terms), kind)
            gains[owner, term] = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
            scores = gains @ holds
            for i in range(n_items):
                own = scores[:, i]
                floor = best[i][-1, 0] if len(best[i]) == top else 1
                at = np.flatnonzero(own >= floor)
                if len(at):
                    new = np.stack([own[at].astype(np.int64), none[at], least[at], cls[at]], axis=1)
                    both = np.concatenate([best[i], new])
                    order = np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))[:top]
                    best[i] = both[order]

        for batch in batches:
            cls, m = batch.column("cls").to_numpy(), batch.column("m").to_numpy()
            none = batch.column("least").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            least = batch.column("least").fill_null(0).to_numpy()
            bags = batch.column("bag").to_pylist()
            for at in range(0, len(bags), rows):
                piece = slice(at, at + rows)
                merge(cls[piece], least[piece], none[piece], m[piece], bags[piece])
        for i, found in enumerate(best):
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array([block.ids[i]] * len(found), pa.int64()), pa.array(found[:, 0]), pa.array(found[:, 3])],
                                                 names=["item", "score", "cls"])

    return score


def _first_of(rows: DataFrame, by: list[str], order: list, n: int, rank: str) -> DataFrame:
    """The first `n` rows of each group; Spark keeps `n` rows a group in every task before it exchanges any."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def search(docs: DataFrame, queries: DataFrame, top: int = 50) -> DataFrame:
    """query (row of `queries`), rank, doc_id and score: the `top` best documents of `docs` (doc_id, text) for each row of
    `queries` (item: its number, text: binary). See `rank` for the measure."""
    spark = docs.sparkSession
    total = queries.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks, found = max(1, -(-total // BLOCK_BYTES)), None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()  # BLOCK_BYTES at a time
        items = spark.sparkContext.broadcast(Items([(r["item"], bytes(r["text"])) for r in part]))
        # bags of all documents: of those without a term of the items, only their sizes are asked for
        bags = materialize(_bags(docs, items).withColumn("row", F.monotonically_increasing_id()), "search-bags")
        n_docs, n_terms = bags.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = bags.where("bag is not null")
        counts = held.select("bag").mapInArrow(tidy(_frequencies), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
        df = np.zeros(len(items.value.number), np.int64)
        for r in counts.collect():  # one number a term of the block
            df[r["term"]] = r["df"]
        weights = spark.sparkContext.broadcast(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64))
        m = F.lit(50) + F.expr(f"(50 * n * {n_docs}L) div {max(n_terms, 1)}L")
        # a class: equal bag and equal m, told apart by the hash exchange and then by their bytes; its first `top` members by id
        order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
        by = Window.partitionBy("bag", "m").orderBy(*order)
        marked = held.select("doc_id", "row", "bag", m.alias("m")).withColumn("cls", F.first("row").over(by))
        members = materialize(_first_of(marked, ["bag", "m"], order, top, "place"), "search-members")
        classes = members.where("place = 1").select("cls", F.col("doc_id").cast("bigint").alias("least"), "m", "bag")
        best = classes.mapInArrow(tidy(_scorer(items, weights, top)), "item bigint, score bigint, cls bigint")
        # further classes can't have a member among the first `top` documents: each of these has one before it
        least = members.where("place = 1").select("cls", F.col("doc_id").alias("least"))
        best = _first_of(best.join(least, "cls"), ["item"], [F.desc("score"), F.col("least").asc_nulls_last(), F.col("cls")], top, "place")
        shown = best.select("item", "score", "cls").join(members.select("cls", "doc_id", "row"), "cls")
        ranked = _first_of(shown, ["item"], [F.desc("score"), *order], top, "rank")
        ranked = materialize(ranked.select(F.col("item").alias("query"), "rank", "doc_id", "score"), "search-found")
        found = ranked if found is None else found.unionByName(ranked)
        items.destroy()
        weights.destroy()
    return found


def rank(docs: DataFrame, benchmark: DataFrame, top: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: the `top` documents of `docs` (doc_id, text) with the highest score above 0 for
    each row of `benchmark` (item_id, text); equal scores by ascending doc_id.

    A term is a run of ASCII letters (A-Z lower-cased), digits and non-ASCII characters of the whole text. With N documents
    that hold a term, L terms in all, n in the document and df documents that hold a term, the term weighs
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), a document's m is 50 + (50 * n * N) div L, and its score is the sum of
    w * ((1000000000 * tf) div (1000 * tf + 20 * m)) over the item's distinct terms.

    One pass over the texts a block of items; what is exchanged are the counts of the items' terms. Documents with equal
    counts and m are one class, scored once: a task keeps `top` classes an item, and a class its `top` smallest ids. Neither
    limit loses a row, for no more are asked for.

    NULL and termless texts of either table match nothing. A NULL doc_id comes after all others of its score. Repeated
    documents are ranked one by one, repeated items answered one by one, also those with a NULL id. A very long text is one
    list of terms in its task. Other columns are ignored; empty tables give no rows.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    lined = benchmark.select("item_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    lined = materialize(lined.withColumn("item", F.monotonically_increasing_id()), "search-items")
    found = search(docs, lined.select("item", "text"), top)
    names = lined.select(F.col("item").alias("query"), F.col("item_id").cast(kind).alias("item_id"))
    return found.join(names, "query").select("item_id", "rank", "doc_id", "score")
