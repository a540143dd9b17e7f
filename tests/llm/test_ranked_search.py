"""Ranked search against scoring every document for every item."""

import math
import random
from collections import Counter

import pytest
from helpers import frame, odd_rows, prose, words

from linewise.llm import ranked_search as R


def brute(docs, items, top):
    bags = [(d, Counter(R.TERM.findall((t or "").encode().lower()))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        terms = set(R.TERM.findall((text or "").encode().lower()))
        scored = []
        for (doc, bag), size in zip(bags, sizes):
            m = 50 + (50 * size * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m))
                        for t in terms if bag[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for place, (score, none, doc) in enumerate(sorted(scored)[:top], 1):
            out.append((item, place, None if none else doc, -score))
    return sorted(out, key=str)


def check(spark, docs, items, top=50):
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((tuple(r) for r in R.rank(frame(spark, docs), benchmark, top).collect()), key=str)
    assert got == brute(docs, items, top)
    return got


def corpus():
    rng, vocabulary = random.Random(4), words(1, 60)
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(300)]
    docs += [(2000 - i, "copy of one text ka lo") for i in range(120)]  # one class, more members than asked for
    docs += [(3000 + i, f"ka lo and other{i} ones") for i in range(90)]  # equal on the items' words, unlike in others
    return docs


def test_copies_and_near_copies(spark):
    rng, vocabulary = random.Random(9), words(1, 60)
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(20)] + [(50, "copy of"), (51, "ka lo"), (52, "KA unseen")]
    found = check(spark, corpus(), items)
    assert sum(r[0] == 50 for r in found) == 50
    check(spark, corpus(), items, top=3)


def test_odd_rows(spark):
    items = [(1, None), (2, ""), (3, " -- "), (None, prose(1, 5)), (4, prose(7, 30)), (4, prose(7, 30)), (5, "É é İ 😀word"), (6, "x" * 300_000), (7, "nul endoftext")]
    check(spark, odd_rows() + [(20, "x" * 300_000), (None, prose(1, 60)), (30, "É é İ 😀word A_b")], items)


def test_a_word_in_all_documents_weighs_nothing(spark):
    docs = [(i, "the end") for i in range(700)] + [(9000, "the")]
    found = check(spark, docs, [(0, "the"), (1, "end the"), (2, "none")], 4)
    assert [r[0] for r in found] == [1, 1, 1, 1]


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None), (2, "!")], [(1, "a")])])
def test_nothing_to_find(spark, docs, items):
    assert check(spark, docs, items) == []


def test_blocks_of_items_and_narrow_matrices(spark, monkeypatch):
    docs, items = corpus(), [(i, prose(i, 4) + " ka") for i in range(30)]
    monkeypatch.setattr(R, "BLOCK_BYTES", 300)
    monkeypatch.setattr(R, "CELLS", 64)
    check(spark, docs, items)


def test_integers_where_doubles_would_round(spark, monkeypatch):
    monkeypatch.setattr(R, "EXACT", 0)
    check(spark, corpus(), [(1, "ka lo copy"), (2, prose(1, 20))])


def test_clashing_columns(spark):
    docs = frame(spark, [(1, "a b"), (2, "a")]).selectExpr("*", "1 AS n", "2 AS bag", "3 AS row", "4 AS cls", "5 AS m")
    benchmark = spark.createDataFrame([(7, "b")], "item_id bigint, text string").selectExpr("*", "1 AS item", "2 AS query", "3 AS rank")
    assert [tuple(r)[:3] for r in R.rank(docs, benchmark).collect()] == [(7, 1, 1)]
