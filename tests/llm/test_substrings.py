import hashlib
import random

import numpy as np
import pytest
from helpers import frame, odd_rows, prose

from linewise.llm import substrings


def brute(rows, width):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        order = float("inf") if d is None else d
        for i in range(len(b) - width + 1):
            s = b[i : i + width]
            least[s] = min(order, least.get(s, order))
    out = []
    for d, t in rows:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        order = float("inf") if d is None else d
        reach = 0
        for i in range(len(b) - width + 1):
            if least[b[i : i + width]] < order:
                for j in range(max(i, reach), i + width):
                    gone[j] = 1
                reach = i + width
        spans = [(i, j) for i, j in runs(gone)]
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans))
    return sorted(out, key=str)


def runs(gone):
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(bytes(gone), np.uint8), [0]])))
    return edges.reshape(-1, 2).tolist()


def rows():
    rng = random.Random(1)
    out = [r for r in odd_rows() if r[1] is None or len(r[1]) < 250_000]
    shared = [prose(1000 + i, 30) for i in range(6)]
    for i in range(120):
        parts = [prose(i, 12), rng.choice(shared)[rng.randint(0, 60) :], prose(i + 300, 5), rng.choice(shared)[: rng.randint(20, 150)], prose(i + 600, 3)]
        out.append((1000 - i if i % 2 else 2000 + i, " ".join(parts)))
    out += [(3000 + i, prose(77, 80)) for i in range(30)] + [(4000, "ab" * 400), (4001, "ba" * 60 + "z"), (4002, "x" * 500), (4003, "x" * 49), (4004, "x" * 50), (3999, "x" * 51)]
    return out + [(5000 + i, prose(77, 80)[i : 110 + i] + "\x00" * i) for i in range(20)]


def check(spark, data, width=50):
    got = substrings.remove_repeats(frame(spark, data).select("doc_id", "text"), width).collect()
    got = [(*tuple(r)[:5], [list(x) for x in r["spans"]]) for r in got]
    want = [(*r[:5], [list(x) for x in r[5]]) for r in brute(data, width)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_equal_to_brute_force(spark):
    check(spark, rows())


def test_small_shards_buckets_and_parts(spark, monkeypatch):
    for name, value in (("SHARD_BYTES", 700), ("AT_ONCE", 333), ("BUCKET", 50), ("ORDERED", 20)):
        monkeypatch.setattr(substrings, name, value)
    check(spark, [r for r in rows() if r[1] is None or len(r[1]) < 5000])


@pytest.mark.parametrize("width", [25, 37, 80])
def test_other_widths(spark, width):
    check(spark, [r for r in rows() if r[1] is None or len(r[1]) < 2000][:120], width)


def test_anchors_do_not_depend_on_where_stretches_end(monkeypatch):
    texts = [t.encode() for _, t in rows() if t] + [b"", b"z" * 49, b"z" * 50, b"ab" * 100]
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    last = np.repeat(ends, [len(t) for t in texts])
    places, hashes = substrings.anchors(symbols, last, 50)
    monkeypatch.setattr(substrings, "AT_ONCE", 777)
    again = substrings.anchors(symbols, last, 50)
    assert (places == again[0]).all() and (hashes == again[1]).all()
    # every string of 50 bytes within one text holds an anchor's core
    starts = np.flatnonzero(np.arange(len(symbols)) + 50 <= last)
    assert (np.searchsorted(places, starts + 27) > np.searchsorted(places, starts)).all()


def test_columns_order_and_common_prefixes():
    rng = np.random.default_rng(0)
    matrix = rng.integers(0, 3, (200, 30)).astype(np.uint16)
    matrix[50:90] = matrix[:40]
    for column, order, common in substrings.Columns(matrix).rounds(12):
        lines = [tuple(matrix[i, column:]) for i in order]
        assert lines == sorted(lines)
        for i in range(1, 200):
            n = 0
            while n < 12 and n < len(lines[i]) and lines[i][n] == lines[i - 1][n] and lines[i][n] > 0:
                n += 1
            assert common[i] == n


def test_all_copies_and_empty_tables(spark):
    copies = [(i, prose(5, 100)) for i in range(300)]
    check(spark, copies)
    assert substrings.remove_repeats(frame(spark, []).select("doc_id", "text")).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in substrings.remove_repeats(frame(spark, copies[:3]).select("doc_id", "text"), keep_text=True).collect()}
    assert bytes(kept[0]).decode() == copies[0][1] and bytes(kept[2]) == b""
