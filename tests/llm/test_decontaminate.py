import hashlib
import re

import numpy as np
from helpers import frame, odd_rows, prose

from linewise.llm import decontaminate
from linewise.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    phrases = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in phrases:
                    hit.update(range(i, i + n))
                    found |= phrases[p]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


def cases():
    long = prose(50, 40)
    items = [(1, long), (2, prose(51, 10)), (3, "Kalo MI"), (4, None), (5, "?!"), (6, long), (None, "tutu"), (17, prose(7, 40_000)[5000:5200])]
    docs = odd_rows() + [(100 + i, f"{prose(i, 30)} {prose(50, 40)[i * 3:]} {prose(60 + i, 20)}") for i in range(12)]
    docs += [(200, prose(51, 10).upper().replace("É", "É")), (201, "x kalo, mi. y"), (202, f"{prose(51, 10)} {prose(51, 10)}")]
    return docs, items


def test_equal_to_brute_force(spark):
    docs, items = cases()
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.digest(decontaminate.find_phrases(frame(spark, docs).select("doc_id", "text"), table)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(docs, [x for x in items if x[0] is not None])


def test_blocks_and_pieces_give_the_same(spark, monkeypatch):
    docs, items = cases()
    table = spark.createDataFrame(items, "item_id bigint, text string")
    whole = decontaminate.digest(decontaminate.find_phrases(frame(spark, docs).select("doc_id", "text"), table)).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    parts = decontaminate.digest(decontaminate.find_phrases(frame(spark, docs).select("doc_id", "text"), table)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts))
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 37)
    phrases = decontaminate.Phrases([(str(i), (t or "").encode()) for i, t in items if i is not None], 10)
    shard = decontaminate.Shard([(t or "").encode() for _, t in docs], phrases)
    want = {r["doc_id"]: r["n_hit"] for r in whole if r["doc_id"] not in (None, 2)}
    got = {d: sum(b - a for a, b in shard.spans(i)) for i, (d, _) in enumerate(docs) if d in want}
    assert got == want


def test_removal_leaves_other_texts_alone(spark):
    docs, items = cases()
    table = spark.createDataFrame(items, "item_id bigint, text string")
    left = {r["doc_id"]: r for r in decontaminate.remove_phrases(frame(spark, docs), table).collect() if r["doc_id"] is not None}
    judged = {x[0]: x for x in brute(docs, [x for x in items if x[0] is not None])}
    for doc, text in docs:
        if doc is not None and not judged[doc][5]:
            assert left[doc]["text"] == text
        elif doc is not None:
            assert len(plain_words(left[doc]["text"])) == judged[doc][1] - judged[doc][2]
            assert left[doc]["n_chars"] == len(left[doc]["text"])


def test_empty_tables(spark):
    docs, items = cases()
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert all(not r["contaminated"] for r in decontaminate.digest(decontaminate.find_phrases(frame(spark, docs).select("doc_id", "text"), none)).collect())
    some = spark.createDataFrame(items, "item_id bigint, text string")
    assert decontaminate.digest(decontaminate.find_phrases(frame(spark, []).select("doc_id", "text"), some)).count() == 0


def test_index_finds_and_locates():
    rng = np.random.default_rng(3)
    symbols = rng.integers(1, 4, 500)
    symbols[[20, 21, 140, 300, 499]] = 0
    index = FMIndex(symbols, 4)
    for n in (1, 2, 5):
        phrases = np.unique(rng.integers(1, 4, (60, n)), axis=0)
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(500 - n + 1) if (symbols[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want
