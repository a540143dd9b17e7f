import numpy as np
import pytest
from pyspark.sql import functions as F

from linewise.llm import nearest
from linewise.llm.common import table

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=20, step=20):
    ok = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for i, v in ok:
        if i % step == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], 0) for i, v in rows], SCHEMA)
    return [tuple(r) for r in nearest.nearest(df.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, **kw).collect()]


def same(got, want):
    key = lambda r: r[:2]
    assert [r[:3] for r in sorted(got, key=key)] == [r[:3] for r in sorted(want, key=key)]
    assert np.allclose([r[3] for r in sorted(got, key=key)], [r[3] for r in sorted(want, key=key)], atol=1e-12)


def test_all_probes_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(6) * rng.choice([0.1, 1, 5])]) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)] + [(2000 + i, [0.5, 1, 0, 0, 0, 0]) for i in range(3)]  # copies and ties
    rows += [(20, [1.0, None, 0, 0, 0, 0]), (40, None), (60, []), (80, [0.0] * 6), (100, [float("nan")] * 6), (120, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [rows[0], rows[0], (4000, [1.0, 2.0]), (4001, [1.0, 3.0]), (4020, [3.0, -1.0])]
    monkeypatch.setattr(nearest, "BLOCK", 7)
    same(run(spark, rows, probes=10**6, tables=1), brute(rows))


def test_few_rows_are_all_listed(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(5)]) for i in range(0, 60, 5)]
    same(run(spark, rows, probes=1, tables=1), brute(rows))
    assert run(spark, []) == [] and run(spark, [(20, [1.0])]) == []


def test_recall(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding")
    rows = [(r[0], r[1]) for r in vectors.collect()]
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    got = {}
    for q, _, j, s in [tuple(r) for r in nearest.nearest(vectors, F.col("vec_id") % 20 == 0).collect()]:
        got.setdefault(q, set()).add(j)
    hits = []
    for at in np.flatnonzero(ids % 20 == 0):
        order = [j for j in ids[np.lexsort((ids, -(x @ x[at])))] if j != ids[at]][:20]
        hits.append(len(got[ids[at]] & set(order)) / 20)
        assert len(got[ids[at]]) == 20
    assert np.mean(hits) >= 0.9, np.mean(hits)
    print("recall", np.mean(hits))


@pytest.mark.parametrize("norms, small_band", [("one long", 0), ("spread", 256)])
def test_recall_with_unequal_norms(spark, monkeypatch, norms, small_band):
    monkeypatch.setattr(nearest, "SMALL_BAND", small_band, raising=False)  # so that the tables have their share
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    x *= np.where(np.arange(len(x)) == 7, 5, 1)[:, None] if norms == "one long" else np.random.default_rng(0).lognormal(0, 0.5, len(x))[:, None]
    x = x.astype(np.float32).astype(np.float64)
    got = {}
    for q, _, j, _ in run(spark, list(zip(ids.tolist(), x.tolist()))):
        got.setdefault(q, set()).add(j)
    hits = []
    for at in np.flatnonzero(ids % 20 == 0):
        order = [j for j in ids[np.lexsort((ids, -(x @ x[at])))] if j != ids[at]][:20]
        hits.append(len(got[ids[at]] & set(order)) / 20)
    assert len(hits) == 100 and np.mean(hits) >= 0.9, np.mean(hits)
    print("recall", norms, small_band, np.mean(hits))
