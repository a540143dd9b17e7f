import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import frame, odd_rows, prose
from tokenizers import Tokenizer

from linewise.llm import packing
from linewise.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def check(rows, got, window):
    library = Tokenizer.from_file(PATH)
    want = sorted((str(d), library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert 0 < r["length"] <= window and r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces[str(r["doc_id"])].append((r["start"], r["length"], list(r["ids"]), r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    by_id = defaultdict(list)
    for d, ids in want:
        by_id[d].append(ids)
    assert set(by_id) == set(pieces)
    for d, lists in by_id.items():
        assert sum(x[1] for x in pieces[d]) == sum(map(len, lists))
        if len(lists) == 1:
            assert [i for x in sorted(pieces[d]) for i in x[2]] == lists[0] and {x[3] for x in pieces[d]} == {len(lists[0])}
    return sequences


def test_every_id_once_and_little_padding(spark, monkeypatch):
    rows = odd_rows() + [(100 + i, prose(i % 40, 50 + 7 * i)) for i in range(200)]
    got = packing.pack(frame(spark, rows), PATH, window=256, keep_ids=True).collect()
    sequences = check(rows, got, 256)
    short = [s for s in sequences.values() if sum(n for _, n in s) < 256]
    assert len(short) <= 4  # one for each partition
    monkeypatch.setattr(packing, "SHARD_DOCS", 3)
    monkeypatch.setattr(packing, "SHARD_IDS", 500)
    check(rows, packing.pack(frame(spark, rows), PATH, window=64, keep_ids=True).collect(), 64)


def test_neighbours_share_a_window():
    rng = np.random.default_rng(0)
    ids = [np.append(rng.integers(100 * (i % 10), 100 * (i % 10) + 60, 40), 1).astype(np.uint16) for i in range(100)]
    df = np.bincount(np.concatenate([np.unique(x[:-1]) for x in ids]), minlength=1000)
    pieces = list(packing._pieces(ids, packing.Scorer(df, 100, 41.0), 410, 410))
    assert sum(n for _, _, n in pieces) == 4100
    topics = [d % 10 for d, _, _ in pieces]
    assert sum(a == b for a, b in zip(topics, topics[1:])) >= 85


@pytest.mark.parametrize("common, at_once", [(8, 32), (1, 3), (1000, 1)])
def test_scores_equal_plain_bm25(monkeypatch, common, at_once):
    monkeypatch.setattr(packing, "COMMON", common)
    monkeypatch.setattr(packing, "AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    ids = [np.append(rng.integers(0, 50, rng.integers(0, 30)), 99) for _ in range(40)]
    df = np.bincount(np.concatenate([np.unique(x[:-1]) for x in ids]), minlength=50)
    index = packing.Index(ids, packing.Scorer(df, 40, 16.0))
    def weight(t, x):
        tf = int((x[:-1] == t).sum())
        return np.log1p((40 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / 16.0))
    for seed in range(40):
        query = {*ids[seed][:-1].tolist()}
        score = [sum(weight(t, x) for t in query) for x in ids]
        found = list(index.neighbours(seed))
        assert set(found) == {i for i in range(40) if score[i] > 0}
        assert all(score[a] >= score[b] - 1e-4 for a, b in zip(found, found[1:]))


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_terms_are_counted_while_encoding(spark):
    rows = odd_rows() + [(100 + i, prose(i % 7, 30)) for i in range(50)]
    library = Tokenizer.from_file(PATH)
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    encoded = packing._encoded(frame(spark, rows), PATH, 1).cache()
    assert encoded.where("width > 0").count() == len(rows)
    df, docs, length = packing._frequencies(encoded)
    assert docs == len(rows) and length == pytest.approx(sum(len(x) + 1 for x in ids) / len(rows))
    want = np.bincount([t for x in ids for t in set(x)], minlength=len(df))
    assert df.tolist() == want[: len(df)].tolist() and want[len(df) :].sum() == 0
    encoded.unpersist()


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_document_terms(kind):
    rng = np.random.default_rng(11)
    ids = [np.append(rng.integers(0, 60_000 if kind == "<u2" else 1 << 31, rng.integers(0, 40)) % 50 * 1200, 1).astype(kind) for _ in range(200)] + [np.array([1], kind)]
    want = sorted((d, int(t), int((x[:-1] == t).sum())) for d, x in enumerate(ids) for t in set(x[:-1].tolist()))
    assert list(zip(*(x.tolist() for x in packing._document_terms(ids)))) == want
    assert [len(x) for x in packing._document_terms([])] == [0, 0, 0]


def test_heaviest_terms():
    rng = np.random.default_rng(12)
    pairs = sorted({(int(d), int(t)) for d, t in zip(rng.integers(0, 300, 1500), rng.integers(0, 50, 1500))})
    doc, term = (np.array(x) for x in zip(*pairs))
    weight = rng.choice([0, 0.5, 1.25, 7.5], len(doc)).astype(np.float32)
    top = packing._heaviest(doc, term, weight, 301)
    for d in range(301):
        want = [t for _, t in sorted((-w, t) for x, t, w in zip(doc.tolist(), term.tolist(), weight.tolist()) if x == d)][: packing.ROUTE_TERMS]
        assert top[d].tolist() == want + [-1] * (packing.ROUTE_TERMS - len(want))
    assert packing._heaviest(doc[:0], term[:0], weight[:0], 2).tolist() == [[-1] * packing.ROUTE_TERMS] * 2
