"""Token counts: byte-pair merging with a heap of adjacent pairs over a linked list of symbols."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from linewise.llm.common import in_small_batches, tidy

#: Fixed value: how byte-level vocabularies of this kind cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts of words that a task remembers; beyond it, it forgets them all and starts anew.
REMEMBERED = 400_000
#: Words longer than this are counted each time instead of being remembered.
REMEMBERED_CHARS = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + i)
    return [letters[b] for b in range(256)]


class Merges(dict):
    """Token count of a word, remembered; a word not seen yet is merged."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        unlike = [spec["normalizer"], model["unk_token"], model["end_of_word_suffix"], model["continuing_subword_prefix"], model["ignore_merges"]]
        if model["type"] != "BPE" or any(unlike) or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.first = [vocab[x] for x in byte_letters()]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for i, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[left], vocab[right]] = i, vocab[left + right]

    def __missing__(self, word: str) -> int:
        n = self.count(word.encode())
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n

    def count(self, word: bytes) -> int:
        """Symbols of `word` less the merges: always the pair of lowest rank, the leftmost of equals."""
        n, rank = len(word), self.rank
        symbols = [self.first[b] for b in word]
        heap = [(*found, i) for i in range(n - 1) if (found := rank.get((symbols[i], symbols[i + 1])))]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, left = [*range(1, n), -1], [*range(-1, n - 1)], n
        while heap:
            _, merged, i = heapq.heappop(heap)
            j = after[i]
            # stale: one of the two symbols has gone or has become another since
            if symbols[i] < 0 or j < 0 or (now := rank.get((symbols[i], symbols[j]))) is None or now[1] != merged:
                continue
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                if found := rank.get((merged, symbols[k])):
                    heapq.heappush(heap, (*found, i))
            if (h := before[i]) >= 0 and (found := rank.get((symbols[h], merged))):
                heapq.heappush(heap, (*found, h))
        return left


class Counter:
    """Token counts of texts; a special string inside a text is one token, as the vocabulary's library has it."""

    def __init__(self, path: str):
        self.merges, self.words = Merges(path), regex.compile(WORDS)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merges.specials, key=len, reverse=True))))

    def __call__(self, text: str) -> int:
        if not self.merges.specials or not self.special.search(text):
            return sum(map(self.merges.__getitem__, self.words.findall(text)))
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(sum(map(self.merges.__getitem__, self.words.findall(x))) for x in pieces)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each file in a Python worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether there are over `limit` tokens, for each row of `docs` (doc_id, text).

    `path` names the vocabulary file, at the same place on every executor. One pass, no exchange. A NULL or empty text
    has no bytes and no tokens; repeated rows are counted one by one; a NULL doc_id stays NULL.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = counter(path)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            tokens = [tokens_of(x) for x in texts]
            sizes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(tidy(count), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
