import zlib

import numpy as np
import pytest
from helpers import frame, odd_rows, prose
from pyspark.sql import functions as F

from linewise.llm import quality
from linewise.llm.common import documents, table

SF = "/root/testdata/sf0.1"


def small():
    return quality.Settings(rows=80, filters=6, embedding=3, hidden=4, steps=10, batch=8)


def test_gradients_equal_differences():
    net = quality.Network.new(small())
    net.embedding, net.last = net.embedding.astype(np.float64), net.last.astype(np.float64)
    texts, y = [prose(i, 20 + 30 * i).encode() for i in range(4)] + [b""], np.array([0, 1, 1, 0, 1.0])

    def loss():
        p = 1 / (1 + np.exp(-net.forward(texts)["logit"].astype(np.float64)))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = net.gradients(texts, y)
    rng = np.random.default_rng(1)
    for name in net.LEARNT:
        setattr(net, name, getattr(net, name).astype(np.float64))
    for name in net.LEARNT:
        values = getattr(net, name)
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in values.shape)
            if name == "embedding":
                at = (ord("k"), at[1])
            kept, ways = values[at], []
            for step in (1e-4, -1e-4):
                values[at] = kept + step
                ways.append(loss())
            values[at] = kept
            assert found[name][at] == pytest.approx((ways[0] - ways[1]) / 2e-4, abs=2e-3, rel=0.05)


def test_scores_do_not_depend_on_neighbours_or_slices(monkeypatch):
    net = quality.Network.new(small())
    texts = [prose(i, 9 * i).encode() for i in range(40)] + [b"", b"x" * 100_000, b"\xff" * 120, b"y" * 128]
    want = net.score(texts)
    assert np.allclose([net.score([t])[0] for t in texts], want, atol=1e-6)
    monkeypatch.setattr(quality, "SLICE", 3)
    assert np.allclose(net.score(texts), want, atol=1e-6)


def plain_logit(net, text):
    """The same network written place by place; each text is padded by WIDTH at least, so the place that ends with it is all padding."""
    size = -(-(len(text) + quality.WIDTH) // quality.BLOCK) * quality.BLOCK
    symbols = list(text) + [quality.PAD] * (size - len(text))
    answers = []
    for block in range(0, size, quality.BLOCK):
        places = [p for p in range(block, block + quality.BLOCK, quality.STRIDE) if p + quality.WIDTH < size]
        seen = [np.concatenate([net.embedding[s] for s in symbols[p : p + quality.WIDTH]]) @ net.filters for p in places]
        answers.append(np.maximum(np.max(seen, axis=0) + net.bias, 0))
    chunks = [np.maximum(a, b) for a, b in zip(answers, answers[1:] + answers[-1:])]
    hidden = np.array([np.maximum(c @ net.chunk + net.chunk_bias, 0) for c in chunks])
    return np.concatenate([hidden.max(axis=0), hidden.mean(axis=0)]) @ net.last + net.offset[0] + net.shift


def test_scores_equal_a_plain_convolution():
    texts = [prose(i, 11 * i).encode() for i in range(12)] + [b"", b"z" * 119, b"z" * 120, b"z" * 121, bytes(range(256)) * 3]
    net = quality.train(texts, [i % 2 for i in range(len(texts))], 0.4, small())
    want = [1 / (1 + np.exp(-plain_logit(net, t))) for t in texts]
    assert np.allclose(net.score(texts), want, atol=1e-5)


def test_long_labelled_texts_are_learnt_from(spark):
    s = quality.Settings(rows=40, row_chars=800, row_parts=4, steps=60, filters=8, hidden=8)
    rows = [(i, prose(i, 400) + (" SPAM!! " * 300 if i % 2 else "")) for i in range(60)]
    sampled = spark.createDataFrame([(t,) for _, t in rows], "text string").select(quality._sampled(F.col("text"), s).alias("t")).collect()
    for (_, text), r in zip(rows, sampled):
        assert len(r["t"]) == 800 and r["t"].startswith(text[:200]) and r["t"].endswith(text[-200:])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id bigint, quality int")
    net = quality.learn(frame(spark, rows), labels, s)
    scores = net.score([t.encode() for _, t in rows])
    assert scores[0::2].min() > scores[1::2].max()


def test_own_score_column_is_replaced(spark):
    docs = frame(spark, odd_rows()).withColumnRenamed("lang", "Score")
    assert quality.score(docs, quality.Network.new(small())).select("score").dtypes == [("score", "double")]


def test_end_of_long_text_counts():
    texts = [prose(i, 300).encode() for i in range(60)]
    bad = [t + b" " + b"SPAM!! " * 20 for t in texts]
    net = quality.train(texts[:40] + bad[:40], [1] * 40 + [0] * 40, 0.5, quality.Settings(steps=60, filters=8, hidden=8))
    clean = (prose(1000, 20_000)).encode()
    assert net.score([clean])[0] > 0.5 > net.score([clean + b" " + b"SPAM!! " * 20])[0]


def test_held_out_accuracy(spark):
    found = quality.classify(documents(spark, SF), table(spark, SF, "labels")).join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert len(found) > 500 and (found.predicted == found.quality).mean() > 0.97
    assert found[found.quality == 1].predicted.mean() > 0.99


def test_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(i, q) for i, q in [(1, 1), (2, 0), (2, 0), (3, None), (4, 1), (None, 0), (10, 7), (7, 1), (99, 0), (12, 0)]], "doc_id bigint, quality int")
    rows = odd_rows()
    docs = frame(spark, rows)
    found = quality.classify(docs, labels, settings=small()).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    none = quality.classify(docs, labels.limit(0), settings=small()).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.classify(docs.limit(0), labels, settings=small()).count() == 0
