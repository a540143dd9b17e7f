import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import frame, odd_rows, prose

from linewise.llm import brown
from linewise.llm.common import documents

SMALL = brown.Settings(known=40, exchanged=15, classes=4, rounds=4)


def plain(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w] + [None]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 1


def rows():
    out = odd_rows() + [(100 + i, prose(i % 7, 20 + i)) for i in range(60)] + [(300, "q" * 70), (301, "q" * 70 + " " + "q" * 70), (302, "NEW wörds 123, x!")]
    return out + [(400 + i, " ".join(random.Random(i).choice(["le la", "der das", "the of"]).split() * 12)) for i in range(40)]


def test_base_score_and_counts(spark):
    docs = rows()
    count = Counter(w for d, t in docs if not held(d) for w in plain(t))
    n, v = sum(count.values()), len(count)
    want = []
    for d, t in docs:
        w = plain(t)
        want.append((d, held(d), len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    got = [tuple(r)[:6] for r in brown.score(frame(spark, docs).select("doc_id", "text"), SMALL).collect()]
    for a, b in zip(sorted(got, key=str), sorted(want, key=str)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_score_is_the_class_model(spark):
    """Against a plain version with the same classes: counts, pairs, transitions, emissions."""
    docs = rows()
    frame_ = frame(spark, docs).select("doc_id", "text")
    train = [plain(t) for d, t in docs if not held(d)]
    count = Counter(w for x in train for w in x)
    ranked = sorted((w for w in count if w is not None), key=lambda w: (-count[w], brown.key(w.encode())))
    caught = {}
    original = brown.model

    def spy(v, classes, table, s):
        caught.update(v=v, classes=classes, table=table)
        return original(v, classes, table, s)

    brown.model = spy
    try:
        got = {r["doc_id"]: r["score"] for r in brown.score(frame_, SMALL).collect() if r["doc_id"] not in (None, 2)}
    finally:
        brown.model = original
    assert caught["v"].words == [brown.key(w.encode()) for w in ranked[:40]]
    group = {w: i for i, w in enumerate(ranked[:15])}
    of = lambda w: 12 if w is None else int(caught["classes"][group[w]]) if w in group else 4 + brown.shape(w.encode())
    pairs = Counter((of(a), of(b)) for x in train for a, b in zip([None, *x], x))
    table = np.zeros((13, 13))
    for (a, b), k in pairs.items():
        table[a, b] = k
    assert (table == caught["table"]).all()
    members = Counter(of(w) for w in count)
    size = Counter()
    for w, k in count.items():
        size[of(w)] += k
    share = (table.sum(axis=0) + 0.5) / (table.sum() + 6.5)

    def emit(w):
        c = of(w)
        if w is None:
            return 1.0
        return count[w] / size[c] if w in group else (count[w] + 0.5) / (size[c] + 0.5 * (members[c] + 1))

    for d, t in docs:
        if d in got:
            x = plain(t)
            want = sum(math.log10((table[of(a), of(b)] + 4 * share[of(b)]) / (table[of(a)].sum() + 4) * emit(b)) for a, b in zip([None, *x], x))
            assert got[d] == pytest.approx(want, rel=1e-9)


def test_exchange_raises_likelihood_and_finds_languages(spark):
    docs = frame(spark, rows()).select("doc_id", "text")
    counted = brown.count_words(docs.select("text"))
    v = brown.vocabulary(counted, SMALL)
    from pyspark.sql import functions as F

    shared = spark.sparkContext.broadcast(v)
    encoded = brown.encode(docs.withColumn("train", F.lit(True)), shared)
    pairs = brown.materialize(brown.pair_table(encoded, shared), "test-pairs")
    xlogx = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    gain = lambda t: xlogx(t) - xlogx(t.sum(1)) - xlogx(t.sum(0))
    start = brown.transitions(pairs, np.concatenate([np.arange(v.exchanged) % 4, 4 + np.arange(9)]), 13)
    _, table, _ = brown.cluster(pairs, v, SMALL)
    assert gain(table) > gain(start) and table.sum() == start.sum() == v.tokens


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    found = brown.score(documents(spark, "/root/testdata/sf0.01")).where("held_out").toPandas()
    print(found.score.sum() / found.base_score.sum(), found.n_tokens.sum(), found.score.sum(), found.base_score.sum())
    assert found.score.sum() > found.base_score.sum()


def test_empty_and_without_training_rows(spark):
    assert brown.score(frame(spark, []).select("doc_id", "text"), SMALL).count() == 0
    only = next(i for i in range(100) if held(i))
    r = brown.score(frame(spark, [(only, "a b")]).select("doc_id", "text"), SMALL).first()
    assert r["held_out"] and (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] <= 0


def test_words_beyond_the_exchanged_get_their_best_class(spark, monkeypatch):
    """Known and rare ones: classes raise the likelihood, and scores are those of a plain model with them."""
    docs = rows()
    train = [plain(t) for d, t in docs if not held(d)]
    count = Counter(w for x in train for w in x)
    ranked = sorted((w for w in count if w is not None), key=lambda w: (-count[w], brown.key(w.encode())))
    caught, assign, model = {}, brown.assign, brown.model
    monkeypatch.setattr(brown, "assign", lambda *a: caught.update(core=a[2], first=a[3], chosen=assign(*a)) or caught["chosen"])
    monkeypatch.setattr(brown, "model", lambda v, classes, table, s: caught.update(classes=classes, table=table) or model(v, classes, table, s))
    scored = brown.score(frame(spark, docs).select("doc_id", "text"), brown.Settings(known=40, exchanged=15, classes=4, rounds=4, assigned=True)).collect()
    chosen = {bytes(r["word"]): r for r in caught["chosen"].collect()}
    assert set(chosen) == {brown.key(w.encode()) for w in ranked[15:]}
    assert all(chosen[brown.key(w.encode())]["n"] == count[w] for w in ranked[15:])
    group = {w: i for i, w in enumerate(ranked[:15])}
    first = lambda w: 12 if w is None else int(caught["core"][group[w]]) if w in group else 4 + brown.shape(w.encode())
    after, before = {w: np.zeros(13) for w in ranked}, {w: np.zeros(13) for w in ranked}
    for x in train:
        for a, b, c in zip([None, *x], x, x[1:]):
            before[b][first(a)] += 1
            after[b][first(c)] += 1
    words = ranked[15:]
    best = brown.best_classes(np.array([after[w] for w in words]), np.array([before[w] for w in words]), np.array([first(w) for w in words]), caught["first"], 4, np.log(4))
    assert [chosen[brown.key(w.encode())]["class"] for w in words] == best.tolist()
    assert (best[:25] < 4).any() and (best[25:] < 4).any()

    def of(w):
        if w is None:
            return 12
        if w in group:
            return int(caught["classes"][group[w]])
        return chosen[brown.key(w.encode())]["class"] if w in count else 4 + brown.shape(w.encode())

    table = np.zeros((13, 13))
    for x in train:
        for a, b in zip([None, *x], x):
            table[of(a), of(b)] += 1
    assert (table == caught["table"]).all()
    xlogx = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    gain = lambda t: xlogx(t) - xlogx(t.sum(1)) - xlogx(t.sum(0))
    assert gain(table) > gain(caught["first"])
    left = Counter(of(w) for w in count)
    size, share = table.sum(axis=0), (table.sum(axis=0) + 0.5) / (table.sum() + 6.5)

    def emit(w):
        c = of(w)
        return 1.0 if w is None else count[w] / size[c] if c < 4 else (count[w] + 0.5) / (size[c] + 0.5 * (left[c] + 1))

    got = {r["doc_id"]: r["score"] for r in scored if r["doc_id"] not in (None, 2)}
    for d, t in docs:
        if d in got:
            x = plain(t)
            want = sum(math.log10((table[of(a), of(b)] + 4 * share[of(b)]) / (table[of(a)].sum() + 4) * emit(b)) for a, b in zip([None, *x], x))
            assert got[d] == pytest.approx(want, rel=1e-9)
