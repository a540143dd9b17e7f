import random
import zlib

import numpy as np
import pytest
from helpers import frame, odd_rows, prose
from tokenizers import Tokenizer

from linewise.llm import repair, tokens
from linewise.llm.queries import vocabulary

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(6)
    signs = [*" \n\t\r\x0b\x0c\x1c\x85  　", *"'’.,!?;:019²Ⅷaéİ漢字😀́‍Σς½", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'s", "'LL", " the", "  ", "\n\n", "word.", "É", " x!?,", "he's. ", "²!"]
    return [t or "" for _, t in odd_rows()] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunked_ids_equal_the_library(path, monkeypatch):
    texts, library = odd_texts(), Tokenizer.from_file(path)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.Encoder(path)(texts)] == want
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 500)
    assert [x.tolist() for x in tokens.Encoder(path)(texts)] == want


def plain(ids, least):
    """Re-Pair one pair at a time: (rules, symbols left)."""
    seq, n = list(ids), 0
    while True:
        counts, before = {}, None
        for i, pair in enumerate(zip(seq, seq[1:])):
            if pair == before and pair[0] == pair[1]:  # overlaps the one before
                before = None
                continue
            counts[pair], before = counts.get(pair, 0) + 1, pair
        if not counts or max(counts.values()) < least:
            return n, len(seq)
        best, out, i = max(counts, key=counts.get), [], 0
        while i < len(seq):
            if tuple(seq[i : i + 2]) == best:
                out.append(10**6 + n)
                i += 2
            else:
                out.append(seq[i])
                i += 1
        seq, n = out, n + 1


def test_copies_shrink_to_about_one_symbol_each():
    rng = np.random.default_rng(4)
    passage, own = rng.integers(0, 49_000, 1000), rng.integers(0, 49_000, 200_000)
    ids = np.tile(passage, 1000)
    grammar, _ = repair.compress(ids, np.arange(1, len(ids) + 1) % 1000 == 0, 49_152)
    assert len(grammar.sequence) <= 1100 and len(grammar.rules) <= 1100
    # also among other ids
    grammar, _ = repair.compress(np.concatenate([ids, own]), np.zeros(len(ids) + len(own), bool), 49_152)
    assert len(grammar.sequence) <= 201_500
    # a run halves until its pairs are rare
    grammar, _ = repair.compress(np.full(1 << 16, 7), np.zeros(1 << 16, bool), 49_152)
    assert len(grammar.sequence) <= 2 * repair.LEAST


@pytest.mark.parametrize("seed", range(3))
def test_grammar_is_not_much_larger_than_one_pair_at_a_time(seed):
    rng = random.Random(seed)
    vocabulary = [[rng.randrange(300) for _ in range(rng.randint(1, 6))] for _ in range(80)]
    ids = [i for _ in range(1500) for i in vocabulary[int(rng.paretovariate(0.7)) % 80]]
    rules, left = plain(ids, repair.LEAST)
    grammar, _ = repair.compress(np.array(ids), np.zeros(len(ids), bool), 300)
    assert 2 * len(grammar.rules) + len(grammar.sequence) <= 1.2 * (2 * rules + left)


def test_grammar_expands_to_what_it_was_made_from():
    rng = np.random.default_rng(2)
    for n, kinds in ((0, 5), (1, 5), (2, 1), (5000, 1), (5000, 3), (20_000, 40), (3000, 60_000)):
        ids = rng.integers(0, kinds, n)
        ids = np.concatenate([ids, ids, ids[: n // 2]])
        last = rng.random(len(ids)) < 0.01
        grammar, ends = repair.compress(ids, last, 60_000)
        assert grammar.expand(grammar.sequence).tolist() == ids.tolist()
        sizes = np.cumsum(grammar.length_of(grammar.sequence.astype(np.int64)))
        assert (sizes[ends] - 1).tolist() == np.flatnonzero(last).tolist()
        if n >= 5000 and kinds < 100:
            assert len(grammar.rules) and len(grammar.sequence) < 0.8 * len(ids)
        for a, b in ((0, 0), (0, len(ids)), (len(ids) // 3, len(ids) // 2)):
            assert grammar.slice(0, len(grammar.sequence), a, b).tolist() == ids[a:b].tolist()


def test_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(repair, "SHARD_IDS", 5000)
    rows = odd_rows() + [(100 + i, prose(i, 200)) for i in range(60)]
    docs, library = frame(spark, rows), Tokenizer.from_file(WORD)
    path = repair.scratch_path(spark, "test-ids")
    repair.write_ids(docs, path, WORD)
    got = sorted([tuple(r) for r in repair.read_ids(spark, path, keep_ids=True).collect()], key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([d for d, _ in rows], key=lambda d: (d is not None, d))
    want = sorted([(str(d), library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows])
    assert sorted([(str(r[0]), r[4]) for r in got]) == want
    start = 0
    for _, first, n, crc, ids in got:
        assert (first, n) == (start, len(ids)) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += n
    by_id = {r[0]: r[4] for r in got if r[0] != 2}
    for row in spark.read.parquet(path).collect()[:6]:
        for place, doc in enumerate(row["doc_ids"]):
            if doc in by_id:
                assert repair.document_ids(row.asDict(), place, 3, 50).tolist() == by_id[doc][3:50]
                assert repair.document_ids(row.asDict(), place).tolist() == by_id[doc]


def test_empty_table(spark):
    assert repair.encode_to_files(frame(spark, []), WORD).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_and_marks_need_no_call_of_the_whole_library(path, monkeypatch):
    rng = random.Random(8)
    letters = [*"abcXYZ", *"éÄñœſŒİ"[:-1], *"0123", *"'.,$%-@", "'s", "'LL ", " ", "  ", "\n", " \n "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    encoder, calls = tokens.Encoder(path), []
    library = encoder._library
    monkeypatch.setattr(encoder, "_library", lambda x: calls.extend(x) or library(x))
    assert [x.tolist() for x in encoder(texts)] == want
    assert not calls


def test_chunks_are_remembered_over_generations(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    encoder, library = tokens.Encoder(WORD), Tokenizer.from_file(WORD)
    for turn in range(30):
        texts = ["common words stay " + prose(turn, 15), prose(turn, 3) + "."]
        assert [x.tolist() for x in encoder(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.known) < 100 and (turn == 0 or b" words" in {**encoder.known, **encoder.before})


def test_rounds_together_touch_each_place_a_few_times(monkeypatch):
    rng = np.random.default_rng(9)
    words = [rng.integers(0, 3000, rng.integers(2, 40)) for _ in range(2000)]
    ids = np.concatenate([words[int(i) % 2000] for i in rng.pareto(0.6, 20_000) * 3])
    touched, pairs = [], repair._pairs
    monkeypatch.setattr(repair, "_pairs", lambda at, *rest: touched.append(len(at)) or pairs(at, *rest))
    grammar, _ = repair.compress(ids, np.zeros(len(ids), bool), 3000)
    assert grammar.expand(grammar.sequence).tolist() == ids.tolist()
    assert len(touched) > 5 and sum(touched) <= 3 * len(ids)


def test_wide_symbols_and_deep_rules():
    rng = np.random.default_rng(10)
    ids = np.tile(rng.integers(0, 1 << 30, 500), 40)
    grammar, _ = repair.compress(ids, np.zeros(len(ids), bool), 1 << 30)
    assert grammar.expand(grammar.sequence).tolist() == ids.tolist() and len(grammar.sequence) < 1000
    ids = np.concatenate([np.full(1 << 12, 1), rng.integers(0, 5, 3000)])
    grammar, _ = repair.compress(ids, np.zeros(len(ids), bool), 5)
    assert grammar.expand(grammar.sequence).tolist() == ids.tolist()
    assert grammar.slice(0, len(grammar.sequence), 4000, 4200).tolist() == ids[4000:4200].tolist()
