"""Token-ID files: Re-Pair grammar compression per shard, with expansion lengths for random access."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewise.llm.common import in_small_batches, tidy
from linewise.llm.tokens import encoder
from linewise.session import scratch_path

#: Ids that a shard holds about; a longer document has a shard of its own.
SHARD_IDS = 2_000_000
#: Pairs replaced in a round at most, the share of the commonest pair's count that the others need, and how often a pair must
#: occur: a rule takes twelve bytes of the file, a place it is used at saves two.
PAIRS, NEAR, LEAST = 4096, 64, 8


@dataclass
class Grammar:
    """One shard. Symbols below `terminals` are ids; symbol terminals + r stands for the two symbols of rules[r]."""

    terminals: int
    rules: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray

    def length_of(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol expands to."""
        rule = symbols - self.terminals
        return np.where(rule < 0, 1, self.lengths[np.maximum(rule, 0)] if len(self.lengths) else 1)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        if self.terminals <= 1 << 20 and self.lengths.sum() <= 4 * len(symbols):  # all rules expanded are not much longer than what was asked for
            return self._by_table(symbols, np.append(np.ones(self.terminals, np.int64), self.lengths))
        while len(symbols) and symbols.max() >= self.terminals:
            rule = symbols - self.terminals
            wide = rule >= 0
            out = np.empty(len(symbols) + int(wide.sum()), np.int64)
            at = np.arange(len(symbols)) + np.cumsum(wide) - wide
            out[at] = np.where(wide, 0, symbols)
            out[at[wide]], out[at[wide] + 1] = self.rules[rule[wide]].T
            symbols = out
        return symbols.astype(np.uint32)

    def _by_table(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A rule's two symbols have smaller numbers, or come from the same or an earlier round: rules are expanded by length."""
        begin = np.cumsum(size) - size
        table = np.zeros(int(size.sum()), np.uint32)
        table[: self.terminals] = np.arange(self.terminals)
        order = np.argsort(self.lengths, kind="stable")
        length = self.lengths[order]
        for some in np.split(order, np.flatnonzero(length[1:] != length[:-1]) + 1) if len(order) else []:
            halves = self.rules[some]
            whole = begin[self.terminals + some]
            first = size[halves[:, 0]]
            table[_spans(whole, first)] = table[_spans(begin[halves[:, 0]], first)]
            table[_spans(whole + first, size[halves[:, 1]])] = table[_spans(begin[halves[:, 1]], size[halves[:, 1]])]
        return table[_spans(begin[symbols], size[symbols])]

    def slice(self, first: int, last: int, begin: int, end: int) -> np.ndarray:
        """Ids [begin, end) of the stretch sequence[first:last]: lengths tell which symbols hold them, and only those are expanded."""
        ends = np.cumsum(self.length_of(self.sequence[first:last].astype(np.int64)))
        if end <= begin or not len(ends):
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(ends, begin, side="right"), np.searchsorted(ends, end, side="left")
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.sequence[first + a : first + b + 1])[begin - before : end - before]


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after the other."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _pairs(at: np.ndarray, left: np.ndarray, right: np.ndarray, symbols: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, count) of the pairs that start at LEAST or more of the places `at`, and those places, ascending, pair after pair."""
    wide, far = (symbols - 1).bit_length(), n.bit_length()
    if 2 * wide + far <= 63:
        code = left.astype(np.int64)
        for bits, more in ((wide, right), (far, at)):
            code <<= bits
            code |= more
        code.sort()
        at = code & ((1 << far) - 1)
        code >>= far
    else:
        wide = 31
        code = left.astype(np.int64) << wide | right
        order = np.lexsort((at, code))
        code, at = code[order], at[order]
    first = np.flatnonzero(np.concatenate([[len(code) > 0], code[1:] != code[:-1]]))
    count = np.diff(np.append(first, len(code)))
    often = count >= LEAST
    first, count = first[often], count[often]
    code = code[first]
    return code >> wide, code & ((1 << wide) - 1), count, at[_spans(first, count)]


def compress(ids: np.ndarray, last: np.ndarray, terminals: int) -> tuple[Grammar, np.ndarray]:
    """A grammar for `ids`, none of whose symbols crosses a place where `last` is true, and where those places are now.

    Places are linked, and each frequent pair knows where it starts; replacing it touches its own places and their neighbours
    only, so all rounds together cost about as much as there are places. A pair of known symbols never gets more frequent, so
    pairs that are rare when they come up are not followed.

    A round takes the most frequent pairs and those nearly as frequent as rules and replaces them where they don't overlap: of
    two that do, the more frequent stays, and of a run of one pair every other. Rules that would be used fewer than two times
    are not made. Rounds go on until no pair is frequent. Where symbols would outgrow two bytes, which makes every one of them
    longer, rounds stop unless the pairs left would still shorten the sequence by half.
    """
    n = len(ids)
    room = (1 << 16) - terminals if terminals < 1 << 16 else 1 << 31
    seq, last = ids.astype(np.int32), last.copy()
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)  # place n is before the first and after the last
    before[:1] = n
    none = np.int32(PAIRS)
    pair_at, rank_at, stays, mark = np.full(n + 1, -1, np.int32), np.full(n + 1, none, np.int32), np.ones(n, bool), np.zeros(n + 1, bool)
    rules, lengths, n_rules, size = [np.zeros((0, 2), np.int64)], np.zeros(0, np.int64), 0, n

    free = np.flatnonzero(~last[:-1])
    left, right, count, some = _pairs(free, seq[free], seq[free + 1], max(terminals, int(seq.max(initial=0)) + 1), n)
    begin, listed = np.cumsum(count) - count, count.copy()
    pair_at[some] = np.repeat(np.arange(len(count), dtype=np.int32), count)
    places, filled = np.empty(3 * n, np.int64), len(some)  # every replacement starts two pairs at most
    places[:filled] = some

    while len(count) and (top := int(count.max())) >= LEAST:
        if n_rules >= room:
            if count[count >= LEAST].sum() < size:  # every place replaced takes two symbols' room: half of them at best
                break
            room = 1 << 31
        take = min(PAIRS, room - n_rules)
        chosen = np.flatnonzero(count >= max(LEAST, top // NEAR))
        if len(chosen) > take:
            chosen = chosen[np.argpartition(-count[chosen], take - 1)[:take]]
        chosen = chosen[np.lexsort((chosen, -count[chosen]))]
        at = places[_spans(begin[chosen], listed[chosen])]
        rank = np.repeat(np.arange(len(chosen), dtype=np.int32), listed[chosen])
        there = pair_at[at] == chosen[rank]
        at = at[there] << PAIRS.bit_length() | rank[there]
        at.sort()
        at, rank = at >> PAIRS.bit_length(), (at & ((1 << PAIRS.bit_length()) - 1)).astype(np.int32)
        # of a run of one pair (aaaa) every other place can be replaced
        run = np.zeros(len(at), bool)
        twin = np.flatnonzero((left[chosen] == right[chosen])[rank])
        run[twin[1:]] = (np.diff(twin) == 1) & (rank[twin[1:]] == rank[twin[:-1]]) & (after[at[twin[:-1]]] == at[twin[1:]])
        if run.any():
            here = np.arange(len(run))
            even = (here - np.maximum.accumulate(np.where(run, 0, here))) % 2 == 0
            at, rank = at[even], rank[even]
        rank_at[at] = rank
        found, ranks = [], []
        while len(at):  # what no overlapping pair of lower rank holds is replaced, and what it overlaps is not
            lowest = (rank < rank_at[before[at]]) & (rank < rank_at[after[at]])
            now = at[lowest]
            found.append(now)
            ranks.append(rank[lowest])
            rank_at[before[now]] = rank_at[after[now]] = none
            left_over = ~lowest & (rank_at[at] < none)
            rank_at[now] = none
            at, rank = at[left_over], rank[left_over]
        at, rank = np.concatenate(found), np.concatenate(ranks)
        used = np.bincount(rank, minlength=len(chosen))
        kept = np.flatnonzero(used >= 2)
        number = np.full(len(chosen), -1, np.int32)
        number[kept] = terminals + n_rules + np.arange(len(kept))
        at, symbol = at[number[rank] >= 0], number[rank[number[rank] >= 0]]
        rules.append(np.stack([left[chosen[kept]], right[chosen[kept]]], axis=1))
        known = Grammar(terminals, np.zeros((0, 2), np.int64), lengths, seq)
        lengths = np.concatenate([lengths, known.length_of(rules[-1][:, 0]) + known.length_of(rules[-1][:, 1])])
        n_rules += len(kept)
        second = after[at]
        for x in (at, second, before[at]):
            gone = pair_at[x]
            count -= np.bincount(gone[gone >= 0], minlength=len(count))
            pair_at[x] = -1
        seq[at], last[at], stays[second] = symbol, last[second], False
        size -= len(at)
        third = after[second]
        after[at], before[third] = third, at
        mark[at] = True
        ahead = before[at]
        ahead = ahead[~mark[ahead] & (ahead < n)]
        mark[at] = False
        at = np.concatenate([at, ahead])
        at = at[~last[at] & (after[at] < n)]
        # new pairs have a new symbol, so all their places are here
        *more, some = _pairs(at, seq[at], seq[after[at]], terminals + n_rules, n)
        pair_at[some] = np.repeat(np.arange(len(count), len(count) + len(more[2]), dtype=np.int32), more[2])
        begin = np.concatenate([begin, filled + np.cumsum(more[2]) - more[2]])
        left, right, count = (np.concatenate(x) for x in zip((left, right, count), more))
        listed = np.concatenate([listed, more[2]])
        places[filled : filled + len(some)] = some
        filled += len(some)
    width = np.uint16 if terminals + n_rules <= 1 << 16 else np.uint32
    return Grammar(terminals, np.concatenate(rules), lengths, seq[stays].astype(width)), np.flatnonzero(last[stays])


#: The file format: Parquet, a row for each shard; blobs are little-endian. `part` and `shard` put the shards in order of
#: doc_id; `doc_ids` has their documents, `ids_ends` (u4) where each ends among the shard's ids, `symbol_ends` (u4) where
#: it ends in `sequence` (symbols of `width` bytes), `rules` (u4 pairs) and `lengths` (u4, ids each rule expands to).
FORMAT = ("part int, shard int, terminals int, width int, n_ids bigint, doc_ids array<{id}>, ids_ends binary, symbol_ends binary, "
          "rules binary, lengths binary, sequence binary")


def _blob(x: np.ndarray, kind: str = "<u4") -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _row(part: int, shard: int, terminals: int, doc_ids: list, ids: list[np.ndarray]) -> dict:
    ends = np.cumsum([len(x) for x in ids])
    last = np.zeros(int(ends[-1]), bool)
    last[ends - 1] = True
    grammar, symbol_ends = compress(np.concatenate(ids), last, terminals)
    width = grammar.sequence.itemsize
    return {"part": part, "shard": shard, "terminals": terminals, "width": width, "n_ids": int(ends[-1]), "doc_ids": doc_ids, "ids_ends": _blob(ends),
            "symbol_ends": _blob(symbol_ends + 1), "rules": _blob(grammar.rules), "lengths": _blob(grammar.lengths), "sequence": _blob(grammar.sequence, f"<u{width}")}


def grammar_of(row: dict) -> Grammar:
    read = lambda name, kind="<u4": np.frombuffer(row[name], kind).astype(np.int64)
    return Grammar(row["terminals"], read("rules").reshape(-1, 2), read("lengths"), np.frombuffer(row["sequence"], f"<u{row['width']}"))


def document_ids(row: dict, place: int, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids [begin, end) of the document at `place` of a shard row, without expanding the others."""
    ids, symbols = (np.frombuffer(row[x], "<u4") for x in ("ids_ends", "symbol_ends"))
    size = int(ids[place]) - (int(ids[place - 1]) if place else 0)
    first = int(symbols[place - 1]) if place else 0
    return grammar_of(row).slice(first, int(symbols[place]), begin, size if end is None else min(end, size))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes the ids of every row of `docs` (doc_id, text), each with `end_id` behind, to `path` in ascending order of doc_id.

    Texts are dealt into ranges of doc_id (their hash parts equal ids) and encoded there; the ranges become shards of
    about SHARD_IDS ids. NULL texts are empty: their ids are `end_id` alone. NULL ids come first; rows of equal id come
    by the hash of their text, then the text.
    """
    rows = in_small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, shard = encoder(tokenizer), TaskContext.get().partitionId(), 0
        terminals = max(tool.vocabulary, end_id + 1)
        end = np.array([end_id], np.uint32)
        doc_ids, ids, size = [], [], 0

        def flush() -> pa.RecordBatch:
            row = _row(part, shard, terminals, doc_ids, ids)
            kinds = {"n_ids": pa.int64(), "doc_ids": pa.list_(id_type)}
            columns = [pa.array([v], kinds.get(k, pa.binary() if isinstance(v, bytes) else pa.int32())) for k, v in row.items()]
            return pa.RecordBatch.from_arrays(columns, names=list(row))

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(texts), 2048):
                for name, found in zip(names[at : at + 2048], tool(texts[at : at + 2048])):
                    if ids and size + len(found) >= SHARD_IDS:
                        yield flush()
                        doc_ids, ids, size, shard = [], [], 0, shard + 1
                    doc_ids.append(name)
                    ids.append(np.concatenate([found, end]))
                    size += len(found) + 1
        if ids:
            yield flush()

    rows.mapInArrow(tidy(encode), FORMAT.format(id=kind)).write.parquet(path)


def read_ids(spark, path: str, keep_ids: bool = False) -> DataFrame:
    """From the files of write_ids, for each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids if `keep_ids`."""
    shards = spark.read.parquet(path)
    # one number for each part, then for each shard of it
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    starts = shards.select("part", "shard", "n_ids").withColumn("within", within).join(parts, "part")
    starts = starts.select("part", "shard", (F.col("part_start") + F.col("within")).alias("first"))
    id_type = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names if name != "doc_ids"}
                ends = np.frombuffer(row["ids_ends"], "<u4").astype(np.int64)
                ids = grammar_of(row)
                ids = ids.expand(ids.sequence)
                begins = np.concatenate([[0], ends[:-1]])
                own = [ids[a:b] for a, b in zip(begins, ends)]
                n = len(ends)
                out = {"part": pa.array(np.full(n, row["part"], np.int32)), "shard": pa.array(np.full(n, row["shard"], np.int32)), "doc_id": batch.column("doc_ids")[at].values,
                       "begin": pa.array(begins), "n_tokens": pa.array(ends - begins), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())}
                if keep_ids:
                    out["ids"] = pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    schema = f"part int, shard int, doc_id {id_type}, begin bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    found = shards.mapInArrow(tidy(decode), schema).join(starts, ["part", "shard"])
    return found.select("doc_id", (F.col("first") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def encode_to_files(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """write_ids to `path` (a fresh one in the shared folder if none is given), then read_ids from there."""
    path = path or scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(docs.sparkSession, path)
