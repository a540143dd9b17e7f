"""Lexical retrieval packing: windows filled from a seed document and its unused BM25 neighbours."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise.llm.common import in_small_batches, tidy
from linewise.llm.tokens import encoder, forget
from linewise.session import materialize

#: Ids and documents that one shard of the index holds at most (a longer document has a shard of its own).
SHARD_IDS, SHARD_DOCS = 4_000_000, 8_192
#: A term that at least one in so many documents of a shard has is kept as a row of weights, others as a list.
COMMON = 4
#: Neighbours that are put in order at once.
AT_ONCE = 32
#: Terms by which documents are brought next to each other.
ROUTE_TERMS = 3
#: BM25's saturation and length norm.
K1, B = 1.2, 0.75


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and its ids with `end_id` behind, in two bytes each where the vocabulary fits there. Each task adds a row of
    width 0 with its number of documents, that of their ids, and how many of them have each term (eight bytes each)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        wide = "<u2" if max(tool.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        counts, id_type = np.zeros(2 + max(tool.vocabulary, end_id + 1), "<i8"), None
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for at in range(0, len(texts), 2048):
                ids = [np.append(x, np.uint32(end_id)).astype(wide) for x in tool(texts[at : at + 2048])]
                counts[:2] += len(ids), sum(map(len, ids))
                counts[2:] += np.bincount(_document_terms(ids)[1], minlength=len(counts) - 2)
                blobs = [x.tobytes() for x in ids]
                rows, id_type = batch.slice(at, len(blobs)), batch.schema.field("doc_id").type
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(blobs, pa.binary()), pa.array([int(wide[2])] * len(blobs), pa.int32())], names=["doc_id", "ids", "width"])
        if id_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.array([counts.tobytes()], pa.binary()), pa.array([0], pa.int32())], names=["doc_id", "ids", "width"])

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, ids binary, width int")


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, f"<u{w}") for x, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist())]


def _document_terms(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, how often) for each distinct pair, by document, then term. A term is a token id; the end mark,
    which every document has, is none."""
    terms = np.concatenate([x[:-1] for x in ids]) if len(ids) else np.zeros(0, "<u2")
    bits, kind = (16, np.uint32) if terms.itemsize == 2 and len(ids) <= 1 << 16 else (32, np.uint64)
    pair = np.repeat(np.arange(len(ids), dtype=kind) << kind(bits), [len(x) - 1 for x in ids])
    pair |= terms.astype(kind)
    pair.sort()
    first = np.flatnonzero(np.concatenate([[len(pair) > 0], pair[1:] != pair[:-1]]))
    often = np.diff(np.append(first, len(pair)))
    pair = pair[first]
    return (pair >> kind(bits)).astype(np.int64), (pair & kind((1 << bits) - 1)).astype(np.int64), often


def _frequencies(encoded: DataFrame) -> tuple[np.ndarray, int, float]:
    """Documents with each term, documents, and their mean length: over all rows. There are as many terms as the
    vocabulary has ids, however many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column("ids").to_pylist():
                counts = np.frombuffer(blob, "<i8")
                total = counts + total if len(total) else counts
        some = np.flatnonzero(total)
        # terms -2 and -1: documents, and ids in all
        yield pa.RecordBatch.from_arrays([pa.array(some - 2), pa.array(total[some])], names=["term", "n"])

    rows = encoded.where("width = 0").select("ids").mapInArrow(tidy(run), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    docs = found.pop(-2, 0)
    length = found.pop(-1, 0) / max(docs, 1)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return df, docs, length


class Scorer:
    """BM25 weights from counts of the whole corpus."""

    def __init__(self, df: np.ndarray, docs: int, length: float):
        self.idf = np.log1p((docs - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.shared, self.length = df > 1, max(length, 1.0)

    def weights(self, doc: np.ndarray, term: np.ndarray, often: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        norm = K1 * (1 - B + B * sizes / self.length)
        return self.idf[term] * (often * (K1 + 1) / (often + norm[doc])).astype(np.float32)


def _heaviest(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The ROUTE_TERMS heaviest terms of each document, heaviest first, ties by term; -1 where it has fewer."""
    top = np.full((n, ROUTE_TERMS), -1, np.int32)
    if len(doc):
        low = np.uint64(0xFFFFFFFF)
        # bits of floats that are not negative sort as they do; no term gives 0
        key = weight.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | (low - term.astype(np.uint64))
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        own, size = doc[starts], np.diff(np.append(starts, len(doc)))
        for place in range(ROUTE_TERMS):
            best = np.maximum.reduceat(key, starts)
            some = best > 0
            top[own[some], place] = (low - (best[some] & low)).astype(np.int32)
            key[key == np.repeat(best, size)] = 0
    return top


class Index:
    """Inverted index of one shard: documents and weights of each term. A document's query is all its terms."""

    def __init__(self, ids: list[np.ndarray], scorer: Scorer):
        doc, term, often = _document_terms(ids)
        weight = scorer.weights(doc, term, often, np.array([len(x) for x in ids], np.int64))
        n = len(ids)
        self.terms, self.query_of = term.astype(np.int32), np.searchsorted(doc, np.arange(n + 1))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(term))])
        del term, often
        order = np.argsort(self.terms, kind="stable")
        self.docs, self.weights = doc[order], weight[order].astype(np.float64)  # as bincount takes them
        del doc, weight, order
        # a row has at most COMMON times the entries of the list it stands for
        count = np.diff(self.first)
        common = np.flatnonzero((count > 0) & (count * COMMON >= n))
        self.row = np.full(len(count), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n), np.float32)
        for row, t in zip(self.rows, common.tolist()):
            row[self.docs[self.first[t] : self.first[t + 1]]] = self.weights[self.first[t] : self.first[t + 1]]
        self.used = np.zeros(n, bool)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all terms of `seed`; 0 for used ones."""
        terms = self.terms[self.query_of[seed] : self.query_of[seed + 1]]
        row = self.row[terms]
        common, score = row[row >= 0], np.zeros(len(self.used), np.float32)
        for at in range(0, len(common), 64):
            score += self.rows[common[at : at + 64]].sum(axis=0)
        spans = [slice(a, b) for a, b in zip(self.first[terms[row < 0]].tolist(), self.first[terms[row < 0] + 1].tolist())]
        if spans:
            listed = np.concatenate([self.docs[x] for x in spans])
            score += np.bincount(listed, np.concatenate([self.weights[x] for x in spans]), len(score)).astype(np.float32)
        score[self.used] = 0
        return score

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents that share a term with `seed`, the highest score first, ties by place; ordered as they are asked for."""
        score, some = self.scores(seed), AT_ONCE
        while True:
            least = np.partition(score, -some)[-some] if some < len(score) else 0
            found = np.flatnonzero((score >= least) & (score > 0))
            if not len(found):
                return
            yield from found[np.lexsort((found, -score[found]))].tolist()
            score[found] = 0
            some *= 4


def _pieces(ids: list[np.ndarray], scorer: Scorer, window: int, room: int) -> Iterator[tuple[int, int, int]]:
    """(document, start, length) in the order in which they fill windows, the first of which has `room` left.

    A seed is what is left of the document that was cut last, or else the first unused document. Its neighbours follow
    until the window is full; the last is cut to fit. A seed with too few neighbours is followed by the next seed.
    """
    index, n = Index(ids, scorer), len(ids)
    following, rest = 0, None
    while True:
        if rest is None:
            while following < n and index.used[following]:
                following += 1
            if following == n:
                return
            rest = (following, 0)
            index.used[following] = True
        seed, start = rest
        rest = None
        waiting = iter(())
        asked = False
        at = (seed, start)
        while at is not None:
            doc, start = at
            length = min(room, len(ids[doc]) - start)
            yield doc, start, length
            room -= length
            start += length
            at = (doc, start) if start < len(ids[doc]) else None
            if room == 0:
                room = window
                if at is not None and len(ids[doc]) - start < window or at is None:
                    rest = at  # a new window: its seed is what was cut off
                    break
                continue
            if not asked:
                waiting, asked = index.neighbours(seed), True
            at = next(((x, 0) for x in waiting if not index.used[x]), None)
            if at is not None:
                index.used[at[0]] = True


OUT = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Every id of every row of `docs` (doc_id, text; each with `end_id` behind) in one piece of one sequence.

    Texts are encoded once and written. Document frequencies count all documents (there are as many terms as ids in the
    vocabulary). Documents are then dealt into ranges of their heaviest shared terms, so that those that share rare terms
    lie in one shard, a range of a large group of copies being split by a hash; a task cuts its range into shards,
    indexes each and packs it. A window passes from a shard to the next, so a task leaves one window short at most.

    NULL and empty texts are `end_id` alone. Repeated rows are packed one by one. Documents of any length are cut.
    """
    encoded = materialize(_encoded(docs, tokenizer, end_id), "packing-ids")
    scorer = docs.sparkSession.sparkContext.broadcast(Scorer(*_frequencies(encoded)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    route = [f"t{i}" for i in range(ROUTE_TERMS)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch)
            doc, term, often = _document_terms(ids)
            weight = scorer.value.weights(doc, term, often, np.array([len(x) for x in ids], np.int64))
            weight[~scorer.value.shared[term]] = 0  # no neighbour has it
            top = _heaviest(doc, term, weight, len(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in top.T.copy())], names=[*batch.schema.names, *route])

    marked = encoded.where("width > 0").mapInArrow(tidy(mark), f"doc_id {kind}, ids binary, width int, " + ", ".join(f"{x} int" for x in route))
    order = [*route, F.xxhash64("doc_id", "ids")]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sequence, filled = TaskContext.get().partitionId() << 40, 0
        names, ids = [], []

        def flush() -> pa.RecordBatch:
            nonlocal sequence, filled
            rows = []
            for doc, start, length in _pieces(ids, scorer.value, window, window - filled):
                cut = ids[doc][start : start + length].astype("<u4")
                rows.append((names[doc], start, length, zlib.crc32(cut.tobytes()), len(ids[doc]), sequence, filled, *([cut.astype(np.int32)] if keep_ids else [])))
                filled += length
                if filled == window:
                    sequence, filled = sequence + 1, 0
            columns = list(zip(*rows))
            kinds = [id_type, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * keep_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids])

        size = 0
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for name, own in zip(batch.column("doc_id").to_pylist(), _ids(batch)):
                if ids and (size + len(own) > SHARD_IDS or len(ids) == SHARD_DOCS):
                    yield flush()
                    names, ids, size = [], [], 0
                names.append(name)
                ids.append(own)
                size += len(own)
        if ids:
            yield flush()

    return dealt.select("doc_id", "ids", "width").mapInArrow(tidy(run), OUT.format(id=kind) + ", ids array<int>" * keep_ids)
