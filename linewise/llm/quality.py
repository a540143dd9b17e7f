"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.llm.common import in_small_batches, remainder, texts_of, tidy, with_free_names

#: Bytes of a block; a chunk is two neighbouring blocks, so chunks overlap by half and cover the whole text.
BLOCK = 128
#: Bytes under a filter, and bytes from one place of it to the next.
WIDTH, STRIDE = 8, 2
#: Symbol after a text's last byte.
PAD = 256
#: Blocks convolved at once, and bytes of texts scored at once (a longer text alone).
SLICE, SCORED_BYTES = 1024, 1 << 20


@dataclass
class Settings:
    """`rows` bounds the labelled rows learnt from (half of each label, the lowest hashes of doc_id). Of a text of over
    `row_chars` characters, `row_parts` stretches of `row_chars` in all are learnt from, evenly spaced from its beginning to
    its end. Scoring has no bounds."""

    rows: int = 2400
    row_chars: int = 16_384
    row_parts: int = 8
    filters: int = 32
    embedding: int = 8
    hidden: int = 24
    steps: int = 600
    batch: int = 32
    rate: float = 0.004
    seed: int = 7


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each padded to whole blocks (by WIDTH at least), and the first block of each."""
    sizes = np.array([-(-(len(x) + WIDTH) // BLOCK) for x in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    symbols = np.full(first[-1] * BLOCK + WIDTH, PAD, np.uint16)
    for at, x in zip(first * BLOCK, texts):
        symbols[at : at + len(x)] = np.frombuffer(x, np.uint8)
    return symbols, first


@dataclass
class Network:
    """Embedding and filters, chunk layer, and the last layer over the largest and the mean chunk."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    chunk: np.ndarray
    chunk_bias: np.ndarray
    last: np.ndarray
    offset: np.ndarray
    shift: float = field(default=0.0)

    LEARNT = ("embedding", "filters", "bias", "chunk", "chunk_bias", "last", "offset")

    @classmethod
    def new(cls, s: Settings) -> Network:
        rng, f32 = np.random.default_rng(s.seed), np.float32
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(f32)
        return cls(draw(PAD + 1, s.embedding, scale=0.5), draw(WIDTH * s.embedding, s.filters, scale=(WIDTH * s.embedding) ** -0.5), np.zeros(s.filters, f32),
                   draw(s.filters, s.hidden, scale=s.filters**-0.5), np.zeros(s.hidden, f32), draw(2 * s.hidden, scale=0.1), np.zeros(1, f32))

    def pool(self, symbols: np.ndarray, first: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest answer of each filter in each block, and where it was."""
        blocks, per = int(first[-1]), BLOCK // STRIDE
        pooled = np.empty((blocks, self.filters.shape[1]), np.float32)
        where = np.empty(pooled.shape, np.int64) if places else None
        ends = first[1:] - 1
        for at in range(0, blocks, SLICE):
            end = min(blocks, at + SLICE)
            rows = self.embedding[symbols[at * BLOCK : end * BLOCK + WIDTH]]
            window = np.lib.stride_tricks.sliding_window_view(rows.ravel(), rows.shape[1] * WIDTH)[:: rows.shape[1] * STRIDE][: (end - at) * per]
            answers = (window @ self.filters).reshape(end - at, per, -1)
            # a text's last places would look into the text after it
            answers[ends[(ends >= at) & (ends < end)] - at, per - WIDTH // STRIDE :] = -np.inf
            pooled[at:end] = answers.max(axis=1)
            if places:
                where[at:end] = answers.argmax(axis=1)
        return pooled + self.bias, where

    def forward(self, texts: list[bytes], places: bool = False) -> dict[str, np.ndarray]:
        symbols, first = _laid_out(texts)
        pooled, where = self.pool(symbols, first, places)
        active = np.maximum(pooled, 0)
        after = np.arange(len(active)) + 1
        after[first[1:] - 1] -= 1  # the last block of a text has none after it
        chunks = np.maximum(active, active[after])
        hidden = np.maximum(chunks @ self.chunk + self.chunk_bias, 0)
        counts = np.diff(first)
        top = np.maximum.reduceat(hidden, first[:-1], axis=0)
        mean = np.add.reduceat(hidden, first[:-1], axis=0) / counts[:, None]
        logit = np.concatenate([top, mean], axis=1) @ self.last + self.offset
        return {"symbols": symbols, "first": first, "where": where, "active": active, "after": after, "chunks": chunks, "hidden": hidden, "top": top, "mean": mean, "logit": logit}

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.forward(texts)["logit"].astype(np.float64) + self.shift, -50, 50)))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        x = self.forward(texts, places=True)
        first, counts, n = x["first"], np.diff(x["first"]), len(texts)
        of = np.repeat(np.arange(n), counts)
        d_logit = ((1 / (1 + np.exp(-x["logit"])) - labels) / n).astype(np.float32)
        both, units = np.concatenate([x["top"], x["mean"]], axis=1), x["top"].shape[1]
        d_both = d_logit[:, None] * self.last
        at_top = x["hidden"] == x["top"][of]
        share = at_top / np.add.reduceat(at_top.astype(np.float32), first[:-1], axis=0)[of]
        d_hidden = (share * d_both[of, :units] + d_both[of, units:] / counts[of, None]) * (x["hidden"] > 0)
        d_chunks = d_hidden @ self.chunk.T
        own = x["active"] >= x["active"][x["after"]]
        d_active = d_chunks * own
        np.add.at(d_active, x["after"], d_chunks * ~own)
        d_active *= x["active"] > 0
        block, unit = np.nonzero(d_active)
        d = d_active[block, unit]
        places = (block * BLOCK + x["where"][block, unit] * STRIDE)[:, None] + np.arange(WIDTH)
        seen = x["symbols"][places]
        d_filters = np.zeros_like(self.filters)
        weighted = self.embedding[seen].reshape(len(d), -1) * d[:, None]
        d_rows = (self.filters.T[unit] * d[:, None]).reshape(-1, self.embedding.shape[1])
        order = np.argsort(unit, kind="stable")
        units_seen, starts = np.unique(unit[order], return_index=True)
        if len(starts):
            d_filters[:, units_seen] = np.add.reduceat(weighted[order], starts, axis=0).T
        d_embedding = np.stack([np.bincount(seen.ravel(), c, PAD + 1) for c in d_rows.T], axis=1).astype(np.float32)
        return {"embedding": d_embedding, "filters": d_filters, "bias": d_active.sum(axis=0), "chunk": x["chunks"].T @ d_hidden,
                "chunk_bias": d_hidden.sum(axis=0), "last": both.T @ d_logit, "offset": d_logit.sum(keepdims=True)}


def train(texts: list[bytes], labels: list[int], share: float, settings: Settings | None = None) -> Network:
    """A network fitted to labelled texts by Adam, both labels weighing the same; `share` is the share of label 1 among
    all labelled rows, to which the scores are shifted afterwards. With one label only, every score is `share`."""
    s = settings or Settings()
    net, y, rng = Network.new(s), np.array(labels, np.float32), np.random.default_rng(s.seed)
    if not 0 < y.sum() < len(y):
        net.last[:] = 0
        net.shift = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return net
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in net.LEARNT}
    # one more of the rarer label until both weigh the same
    rows = [np.flatnonzero(y == v) for v in (0, 1)]
    size, step = max(map(len, rows)), 0
    while step < s.steps:
        order = np.concatenate([np.resize(rng.permutation(r), size) for r in rows])
        order = order[rng.permutation(len(order))]
        for at in range(0, len(order), s.batch):
            if step == s.steps:
                break
            some, step = order[at : at + s.batch], step + 1
            rate = s.rate * (1 - (step - 1) / s.steps)
            for k, g in net.gradients([texts[i] for i in some], y[some]).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                setattr(net, k, (getattr(net, k) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
    share = min(max(share, 0.01), 0.99)
    net.shift = float(np.log(share / (1 - share)))
    return net


def _sampled(text: Column, s: Settings) -> Column:
    """The text, or the evenly spaced stretches of a long one."""
    part = s.row_chars // s.row_parts
    room = F.length(text) - part
    starts = [F.floor(room * i / max(1, s.row_parts - 1)).cast("int") + 1 for i in range(s.row_parts)]
    return F.when(F.length(text) <= s.row_chars, text).otherwise(F.concat(*[F.substring(text, x, F.lit(part)) for x in starts]))


def learn(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Network:
    """Fits a network to a bounded sample of `docs` (doc_id, text) with `labels` (doc_id, quality 0 or 1).

    Rows whose id has remainder 2 (crc32 of it as text, modulo 4) are held out. Other labels, NULL labels and NULL ids
    are passed over. Only texts go into the network, long ones by stretches of them (Settings).
    """
    s = settings or Settings()
    usable = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(remainder("doc_id", 4) != 2).distinct()
    share = usable.agg(F.avg("quality")).first()[0]
    rank = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):
        part = docs.join(usable.where(F.col("quality") == label), "doc_id").where("text is not null")
        part = part.select("doc_id", "quality").orderBy(rank, "doc_id").limit(s.rows // 2)
        chosen = part if chosen is None else chosen.union(part)
    # a few thousand ids; then their texts
    sample = docs.where("text is not null").join(F.broadcast(chosen.distinct()), "doc_id").select("doc_id", "quality", _sampled(F.col("text"), s).alias("text"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "text", "quality").limit(s.rows).collect()
    return train([x["text"].encode() for x in sample], [x["quality"] for x in sample], 0.5 if share is None else share, s)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """`docs` with the column score: the probability of label 1, from the whole text (NULL counts as empty).

    A column of that name, in any case, is replaced. Texts of any length are scored whole, in slices of blocks."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "score"])
    shared, names = docs.sparkSession.sparkContext.broadcast(net), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            scores, at = [np.zeros(0)], 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= SCORED_BYTES:
                    size, end = size + len(texts[end]), end + 1
                scores.append(shared.value.score(texts[at:end]))
                at = end
            scores = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return in_small_batches(docs).mapInArrow(tidy(run), f"{kinds}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, settings: Settings | None = None) -> DataFrame:
    """The rows of `docs` that score `threshold` or more, with a network learnt from them."""
    net = learn(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), labels, settings)
    return with_free_names(docs, {"score"}, lambda rows: score(rows, net).where(F.col("score") >= threshold).drop("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs` (doc_id, text).

    An empty or NULL text is scored as one chunk of padding, a very long one whole. Repeated rows get equal scores; a NULL
    id is not held out. An empty table gives no rows; without usable labels every score is 0.5.
    """
    net = learn(docs, labels, settings)
    scored = score(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), net)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
