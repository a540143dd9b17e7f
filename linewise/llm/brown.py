"""Language-model scoring: a class-based bigram model whose word classes come from exchange clustering."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise.llm.common import in_small_batches, remainder, texts_of, tidy
from linewise.session import materialize

#: Fixed value: a word after lower-casing A-Z, over UTF-8 bytes.
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Longer words go by a hash of 33 bytes; a space leads it, which no word has.
LONG = 64
#: Distinct words that a task holds while counting.
HELD = 400_000
#: Ids of which a task counts the pairs at once.
PAIRS_AT_ONCE = 3_000_000
#: Ids that a task scores at once (a longer text alone).
SCORED_AT_ONCE = 500_000
#: Parts of the pair table; each is one row. A part has at most 2 x (exchanged words)**2 / BLOCKS pairs.
BLOCKS = 256
#: Ids whose neighbours' classes a task counts at once.
CONTEXTS_AT_ONCE = 1_000_000
#: Classes of the words that no class fits better: by what the word looks like.
SHAPES = 8
_DIGIT = re.compile(rb"[0-9]")


@dataclass
class Settings:
    """`exchanged` most frequent words get their class by exchange; `known` most frequent ones are held by every task
    (LONG bytes each at most), all others are joined. With `assigned`, each word that is not exchanged gets its best class
    after that; without, all of them stay in the classes of their shapes."""

    known: int = 200_000
    exchanged: int = 16_384
    classes: int = 64
    rounds: int = 8
    pull: float = 4.0
    assigned: bool = False


def shape(word: bytes) -> int:
    """4 for a digit in it, 2 for a byte beyond ASCII, 1 for an ASCII mark at its end."""
    if word.isalpha():
        return 0
    mark = word[-1] < 128 and not word[-1:].isalnum()
    if mark and word[:-1].isalpha():
        return 1
    return 4 * bool(_DIGIT.search(word)) + 2 * (not word.isascii()) + mark


def key(word: bytes) -> bytes:
    return word if len(word) <= LONG else b" " + hashlib.sha256(word).digest()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, shape, n) over the rows of `docs` (text): every distinct word with its number. The end of a text is the
    empty word, with shape -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w in held if w]
            rows = [(key(w), shape(w), held[w]) for w in words] + [(b"", -1, held[b""])] * (b"" in held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.int32(), pa.int64()))], names=["word", "shape", "n"])

        for batch in batches:
            for text in texts_of(batch.column("text")):
                held.update(WORD.findall(text.lower()))
                held[b""] += 1
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(tidy(run), "word binary, shape int, n bigint").groupBy("word", "shape").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words by rank, with counts and shapes; totals of all words. Ids: ranks, then `size` + shape
    for any other word, then the end."""

    words: list[bytes]
    counts: np.ndarray
    shapes: np.ndarray
    exchanged: int
    tokens: int
    distinct: int
    ends: int
    shape_tokens: np.ndarray
    shape_words: np.ndarray

    @property
    def size(self) -> int:
        return len(self.words)

    @property
    def end(self) -> int:
        return self.size + SHAPES


def vocabulary(counted: DataFrame, s: Settings) -> Vocabulary:
    top = counted.where("shape >= 0").orderBy(F.desc("n"), "word").limit(s.known).select("word", "shape", "n").toArrow()
    totals = {r["shape"]: r for r in counted.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    counts, shapes = top.column("n").to_numpy().astype(np.int64), top.column("shape").to_numpy().astype(np.int64)
    exchanged = min(s.exchanged, len(counts))
    of = lambda name: np.array([totals[i][name] if i in totals else 0 for i in range(SHAPES)], np.int64)
    own = shapes[:exchanged]
    return Vocabulary(
        top.column("word").to_pylist(), counts, shapes, exchanged, sum(r["n"] for r in totals.values()), sum(r["words"] for r in totals.values()),
        totals[-1]["n"] if -1 in totals else 0, of("n") - np.bincount(own, counts[:exchanged], SHAPES).astype(np.int64), of("words") - np.bincount(own, minlength=SHAPES))


def encode(docs: DataFrame, shared) -> DataFrame:
    """`docs` (doc_id, train, text) as ids (blob of u4, the end last), with the words that no task holds, their numbers, and
    which of them each such id is (blob of u4)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        rank = {w: i for i, w in enumerate(v.words)}
        for batch in batches:
            blobs, rare, numbers, orders = [], [], [], []
            for text in texts_of(batch.column("text")):
                words = WORD.findall(text.lower())
                ids = np.fromiter(map(rank.get, words, [-1] * len(words)), np.int64, len(words))
                others: Counter[bytes] = Counter()
                place: dict[bytes, int] = {}
                order = []
                for at in np.flatnonzero(ids < 0).tolist():
                    word = words[at]
                    ids[at] = rank.get(key(word), -1) if len(word) > LONG else -1
                    if ids[at] < 0:
                        ids[at] = v.size + shape(word)
                        word = key(word)
                        others[word] += 1
                        order.append(place.setdefault(word, len(place)))
                blobs.append(np.append(ids, v.end).astype("<u4").tobytes())
                rare.append(list(others))
                numbers.append(list(others.values()))
                orders.append(np.array(order, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("train"), pa.array(blobs, pa.binary()), pa.array(rare, pa.list_(pa.binary())), pa.array(numbers, pa.list_(pa.int32())), pa.array(orders, pa.binary())],
                names=["doc_id", "train", "ids", "rare", "numbers", "order"])

    return docs.mapInArrow(tidy(run), f"doc_id {kind}, train boolean, ids binary, rare array<binary>, numbers array<int>, order binary")


def _groups(v: Vocabulary) -> np.ndarray:
    """What an id is while words are exchanged: itself, or else exchanged + shape, or at last the end."""
    e = v.exchanged
    return np.concatenate([np.arange(e), e + v.shapes[e:], e + np.arange(SHAPES), [e + SHAPES]])


def pair_table(encoded: DataFrame, shared) -> DataFrame:
    """A row for each block of groups (group modulo BLOCKS): the groups after and before each of its groups, with their
    numbers, over all training rows. The end of a text also stands before its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _groups(shared.value)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

        for batch in batches:
            for blob in batch.column("ids").to_pylist():
                ids = groups[np.frombuffer(blob, "<u4")]
                held.append(np.concatenate([ids[-1:], ids[:-1]]) << 32 | ids)
                size += len(ids)
                if size >= PAIRS_AT_ONCE:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    pairs = encoded.where("train").select("ids").mapInArrow(tidy(run), "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other"), F.lit(1).alias("after")),
                             F.struct(F.col("b").alias("own"), F.col("a").alias("other"), F.lit(0).alias("after"))))
    dealt = pairs.select("n", both.alias("x")).select((F.col("x.own") % BLOCKS).alias("block"), "x.*", "n")

    def gather(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("own").to_numpy(), kind="stable")
        take = lambda name, kind: pa.array([rows.column(name).to_numpy()[order].astype(kind).tobytes()], pa.binary())
        return pa.table({"block": rows.column("block").slice(0, 1), "own": take("own", "<i4"), "other": take("other", "<i4"), "after": take("after", "i1"), "n": take("n", "<i8")})

    return dealt.groupBy("block").applyInArrow(gather, "block int, own binary, other binary, after binary, n binary")


def _contexts(row: dict, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of a block, and how often each class comes after and before each."""
    own, other = np.frombuffer(row["own"], "<i4").astype(np.int64), np.frombuffer(row["other"], "<i4")
    after, n = np.frombuffer(row["after"], "i1") != 0, np.frombuffer(row["n"], "<i8")
    groups, at = np.unique(own, return_inverse=True)
    cell = at * n_classes + classes[other]
    count = lambda rows: np.bincount(cell[rows], n[rows], len(groups) * n_classes).reshape(-1, n_classes)
    return groups, count(after), count(~after)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: batch.column(name)[at].as_py() for name in batch.schema.names}


def transitions(pairs: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """How often each class follows each: at most n_classes**2 numbers."""
    shared = pairs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_classes, n_classes))
        for row in _rows(batches):
            groups, after, _ = _contexts(row, shared.value, n_classes)
            np.add.at(total, shared.value[groups], after)
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b].astype(np.int64))], names=["a", "b", "n"])

    found = pairs.mapInArrow(tidy(run), "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((n_classes, n_classes))
    total[found.column("a").to_numpy(), found.column("b").to_numpy()] = found.column("n").to_numpy()
    return total


def best_classes(after: np.ndarray, before: np.ndarray, own: np.ndarray, table: np.ndarray, choices: int, cost: float = 0.0) -> np.ndarray:
    """For each word the class among the first `choices` under which its neighbours' classes are likeliest, all other
    words staying where they are. The word's own numbers are taken out of the table first; ties go to its own class, and a
    move must gain more than `cost`."""
    small = 0.1
    total, times = table.sum(axis=1), after.sum(axis=1)
    here = np.arange(len(own))
    forth = np.log(table + small) - np.log(total + small * len(total))[:, None]
    back = np.log(table + small) - np.log(total + small * len(total))[:, None]
    wide = max(choices, own.max(initial=0) + 1)
    gain = after @ forth[:wide].T + before @ back[:, :wide] - times[:, None] * np.log(total[:wide] + small)[None, :]
    gain[:, choices:] = -np.inf
    left = np.maximum(total[own] - times, 0)
    row = np.log(np.maximum(table[own] - after, 0) + small) - np.log(left + small * len(total))[:, None]
    column = np.log(np.maximum(table[:, own].T - before, 0) + small) - np.log(total + small * len(total))[None, :]
    gain[here, own] = (after * row).sum(axis=1) + (before * column).sum(axis=1) - times * np.log(left + small)
    best = gain.argmax(axis=1)
    return np.where(gain[here, best] > gain[here, own] + cost, best, own)


def cluster(pairs: DataFrame, v: Vocabulary, s: Settings) -> tuple[np.ndarray, np.ndarray, int]:
    """(class of each group, how often each class follows each, number of classes) after exchange clustering.

    At first the most frequent words have a class each and the others share them in turn. In each round half of the words
    move, each to its best class; a round that makes the text no likelier ends the search and is taken back.
    """
    n_classes = s.classes + SHAPES + 1
    classes = np.concatenate([np.arange(v.exchanged) % s.classes, s.classes + np.arange(SHAPES + 1)])
    table = transitions(pairs, classes, n_classes)

    def likelihood(t: np.ndarray) -> float:
        xlogx = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
        return xlogx(t) - xlogx(t.sum(axis=1)) - xlogx(t.sum(axis=0))

    for turn in range(s.rounds):
        shared = pairs.sparkSession.sparkContext.broadcast((classes, table))

        def run(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            old, t = shared.value
            for row in _rows(batches):
                groups, after, before = _contexts(row, old, n_classes)
                moving = (groups < v_exchanged) & ((groups // BLOCKS + groups + turn) % 2 == 0)
                groups, after, before = groups[moving], after[moving], before[moving]
                best = best_classes(after, before, old[groups], t, s.classes)
                moved = best != old[groups]
                yield pa.RecordBatch.from_arrays([pa.array(groups[moved]), pa.array(best[moved])], names=["word", "class"])

        v_exchanged = v.exchanged
        moves = pairs.mapInArrow(tidy(run), "word bigint, class bigint").toArrow()  # at most the exchanged words
        trial = classes.copy()
        trial[moves.column("word").to_numpy()] = moves.column("class").to_numpy()
        after = transitions(pairs, trial, n_classes)
        if moves.num_rows and likelihood(after) <= likelihood(table):
            break
        classes, table = trial, after
    return classes, table, n_classes


def assign(encoded: DataFrame, shared, classes: np.ndarray, table: np.ndarray, s: Settings) -> DataFrame:
    """(word, id, n, class) of every training word that is not exchanged: the class under which its neighbours' classes are
    likeliest, all other words staying where `cluster` left them. Leaving the class of its shape must gain more than it
    costs to name a class, log(classes), or the contexts of words seen once would be learnt by heart. A word's numbers are one for each class before and after
    it at most, whatever the input; `id` tells words that tasks hold, and is that of the shape for others."""
    n_classes = len(table)
    context = encoded.sparkSession.sparkContext.broadcast((classes, table))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, of = shared.value, context.value[0][_groups(shared.value)]
        place: dict[tuple[bytes, int], int] = {}
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            at, cell = np.divmod(codes, 2 * n_classes)
            rare = list(place)
            words = [v.words[i] if i < v.size else rare[i - v.end][0] for i in at.tolist()]
            ids = [i if i < v.size else rare[i - v.end][1] for i in at.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(ids, pa.int32()), pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "id", "cell", "n"])

        for batch in batches:
            for blob, order, rare in zip(*(batch.column(c).to_pylist() for c in ("ids", "order", "rare"))):
                ids = np.frombuffer(blob, "<u4").astype(np.int64)
                around, own = of[ids], ids.copy()
                here = np.flatnonzero((ids >= v.size) & (ids < v.end))
                first = np.frombuffer(order, "<u4")
                shapes = np.zeros(len(rare), np.int64)
                shapes[first] = ids[here]
                own[here] = v.end + np.array([place.setdefault(x, len(place)) for x in zip(rare, shapes.tolist())], np.int64)[first] if len(here) else 0
                here = np.flatnonzero((own >= v.exchanged) & (ids != v.end))  # the end comes last, so each word has one after it
                held += [own[here] * (2 * n_classes) + around[here + 1], own[here] * (2 * n_classes) + n_classes + around[here - 1]]
                size += len(ids)
                if size >= CONTEXTS_AT_ONCE:
                    yield flush()
                    held, size = [], 0
                    place.clear()
        if held:
            yield flush()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (_, t) = shared.value, context.value
        for batch in batches:
            sizes = [len(x) for x in batch.column("cells").to_pylist()]
            both = np.zeros((batch.num_rows, 2 * n_classes))
            flat = batch.column("cells").flatten()
            both[np.repeat(np.arange(batch.num_rows), sizes), flat.field("cell").to_numpy()] = flat.field("n").to_numpy()
            after, before = both[:, :n_classes], both[:, n_classes:]
            ids = batch.column("id").to_numpy()
            own = s.classes + np.where(ids < v.size, v.shapes[np.minimum(ids, v.size - 1)], ids - v.size)
            best = best_classes(after, before, own, t, s.classes, np.log(s.classes)) if s.assigned else own
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("id"), pa.array(after.sum(axis=1).astype(np.int64)), pa.array(best.astype(np.int32))], names=["word", "id", "n", "class"])

    cells = encoded.where("train").select("ids", "order", "rare").mapInArrow(tidy(count), "word binary, id int, cell int, n bigint")
    cells = cells.groupBy("word", "id", "cell").agg(F.sum("n").alias("n")).groupBy("word", "id").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    return cells.mapInArrow(tidy(choose), "word binary, id int, n bigint, class int")


@dataclass
class Model:
    """log10 probabilities: of a class after a class, and of an id within its class (words outside `known` lack their own
    weight and class: `room` has each class's weight)."""

    classes: np.ndarray
    follow: np.ndarray
    emit: np.ndarray
    room: np.ndarray
    base: np.ndarray
    seen: np.ndarray
    fitted: int


def model(v: Vocabulary, classes: np.ndarray, table: np.ndarray, s: Settings) -> Model:
    """`classes` has each id's; `shape_tokens` and `shape_words` of `v` count what is left in the classes of shapes."""
    n = len(table)
    share = (table.sum(axis=0) + 0.5) / (table.sum() + 0.5 * n)
    follow = np.log10((table + s.pull * share[None, :]) / (table.sum(axis=1) + s.pull)[:, None])
    room = np.log10(np.maximum(table.sum(axis=0), 1))
    room[s.classes : s.classes + SHAPES] = np.log10(v.shape_tokens + 0.5 * (v.shape_words + 1))
    fitted = classes[: v.size] < s.classes
    emit = np.concatenate([np.log10(v.counts + np.where(fitted, 0, 0.5)) - room[classes[: v.size]], -room[s.classes : s.classes + SHAPES], [0.0]])
    base_room = np.log10(v.tokens + 0.5 * (v.distinct + 1))
    base = np.concatenate([np.log10(v.counts + 0.5), np.zeros(SHAPES), [np.log10(v.ends + 0.5)]]) - base_room
    seen = np.concatenate([np.ones(v.size, np.int64), np.zeros(SHAPES, np.int64), [int(v.ends > 0)]])
    return Model(classes, follow, emit, room, base, seen, s.classes)


def _classed(rows: pa.RecordBatch, classes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: ids, their classes, where words are that no task holds, and the training counts of those."""
    end = len(classes) - 1
    for blob, order, found in zip(*(rows.column(c).to_pylist() for c in ("ids", "order", "found"))):
        ids = np.frombuffer(blob, "<u4")
        now, n = classes[ids], np.zeros(0, np.int64)
        here = np.flatnonzero((ids >= end - SHAPES) & (ids < end))
        if len(here):
            which = np.frombuffer(order, "<u4")
            known = np.array([(x["at"], x["class"], x["n"]) for x in found or []], np.int64).reshape(-1, 3)
            own, times = np.full(which.max() + 1, -1), np.zeros(which.max() + 1, np.int64)
            own[known[:, 0]], times[known[:, 0]] = known[:, 1], known[:, 2]
            now[here] = np.where(own[which] < 0, now[here], own[which])
            n = times[which]
        yield ids, now, here, n


def class_pairs(rows: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """How often each class follows each in the training rows, whatever class a word got."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_classes**2, np.int64)
        for batch in batches:
            for _, now, _, _ in _classed(batch, shared.value):
                total += np.bincount(np.concatenate([now[-1:], now[:-1]]) * n_classes + now, minlength=n_classes**2)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    found = rows.where("train").select("ids", "order", "found").mapInArrow(tidy(run), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(n_classes**2)
    total[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return total.reshape(n_classes, n_classes)


def _scores(m: Model, rows: pa.RecordBatch) -> pa.RecordBatch:
    ids, now, emit = [], [], []
    for own, classes, here, n in _classed(rows, m.classes):
        weight = m.emit[own]
        weight[here] = np.log10(n + np.where(classes[here] < m.fitted, 0, 0.5)) - m.room[classes[here]]
        ids.append(own)
        now.append(classes)
        emit.append(weight)
    sizes = np.array([len(x) for x in ids], np.int64)
    flat, starts, now = np.concatenate(ids), np.cumsum(sizes) - sizes, np.concatenate(now)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[starts] = m.classes[-1]  # an end stands before the first word
    total = lambda x: pa.array(np.add.reduceat(x, starts))
    sums = [total(m.seen[flat]), total(m.base[flat]), total(m.follow[before, now] + np.concatenate(emit))]
    names = ["doc_id", "train", "rest", "rest_seen"]
    return pa.RecordBatch.from_arrays([*map(rows.column, names), pa.array(sizes), *sums], names=[*names, "n_tokens", "n_seen", "base", "own"])


def score(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of `docs` (doc_id, text).

    Learns from the rows whose id has no remainder 1 (crc32 of it as text, modulo 5); a NULL id has remainder 0. Every
    word of those is counted, and every pair of neighbours. The most frequent words, a bounded number, are held by all
    tasks: they carry the common keys, so what is left to join by word is rare in the training rows.

    score is log10 of the product over the tokens of P(class | class before) x P(word | class). After the exchange every
    other training word, however rare, moves to its best class among theirs, or stays in that of its shape if none gains
    more than naming it costs. Words have their share of their class; in the class of a shape, where all unseen words are, a word
    seen c times weighs c + 0.5 and all unseen words together 0.5. P(class | class before) leans on the classes' shares by `pull` counts. NULL and empty
    texts are the end alone. Repeated rows are scored (and counted) one by one.
    """
    s, spark = settings or Settings(assigned=True), docs.sparkSession
    rows = in_small_batches(docs).select("doc_id", (remainder("doc_id", 5) != 1).alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    counted = materialize(count_words(rows.where("train").select("text")), "brown-words")
    v = vocabulary(counted, s)
    shared = spark.sparkContext.broadcast(v)
    encoded = materialize(encode(rows, shared).withColumn("row", F.monotonically_increasing_id()), "brown-ids")
    pairs = materialize(pair_table(encoded, shared), "brown-pairs")
    classes, table, _ = cluster(pairs, v, s)
    chosen = materialize(assign(encoded, shared, classes, table, s), "brown-classes")
    of = classes[_groups(v)]
    held = chosen.where(F.col("id") < v.size).select("id", "class").toArrow()  # at most the known words
    of[held.column("id").to_numpy()] = held.column("class").to_numpy()
    left = {r["class"] - s.classes: r["words"] for r in chosen.where(F.col("class") >= s.classes).groupBy("class").agg(F.count("*").alias("words")).collect()}
    rare = encoded.where(F.size("rare") > 0).select("row", F.posexplode(F.arrays_zip("rare", "numbers")).alias("at", "x")).select("row", "at", F.col("x.rare").alias("word"), F.col("x.numbers").alias("times"))
    rest = rare.join(chosen.where(F.col("id") >= v.size).select("word", "n", "class"), "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_seen"),
        F.collect_list(F.when(F.col("n") > 0, F.struct("at", "class", "n"))).alias("found"))
    classed = materialize(encoded.drop("rare", "numbers").join(rest, "row", "left"), "brown-classed")
    table = class_pairs(classed, of, len(table))
    tokens = table.sum(axis=0)[s.classes : s.classes + SHAPES]
    v = replace(v, shape_tokens=tokens, shape_words=np.array([left.get(i, 0) for i in range(SHAPES)]))
    weights = spark.sparkContext.broadcast(model(v, of, table, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = weights.value
        for batch in batches:
            sizes = [len(x) // 4 for x in batch.column("ids").to_pylist()]
            at = 0
            while at < len(sizes):
                end, size = at + 1, sizes[at]
                while end < len(sizes) and size + sizes[end] <= SCORED_AT_ONCE:
                    size, end = size + sizes[end], end + 1
                yield _scores(m, batch.slice(at, end - at))
                at = end

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = classed.select("doc_id", "train", "rest", "rest_seen", "ids", "order", "found").mapInArrow(
        tidy(run), f"doc_id {kind}, train boolean, rest double, rest_seen bigint, n_tokens bigint, n_seen bigint, base double, own double")
    none = lambda c: F.coalesce(c, F.lit(0))
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_seen") + none("rest_seen")).cast("bigint").alias("n_known"),
        F.lit(v.tokens).cast("bigint").alias("train_tokens"), (F.col("base") + none("rest")).alias("base_score"), F.col("own").alias("score"))
