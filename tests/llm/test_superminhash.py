"""SuperMinHash near-duplicates against all pairs of sets, and the signatures' own promises."""

import random

import numpy as np
from helpers import frame, odd_rows, prose, words

from linewise.llm import superminhash as S


def brute(rows, width=4, percent=80):
    """(n_shingles, component_id) of each row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = S.WORD.findall((text or "").encode().lower())
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return sorted(((d, len(s), least.get(g)) for (d, _), s, g in zip(rows, sets, group)), key=str)


def result(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["component_id"] is None) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)


def test_odd_rows(spark):
    rows = odd_rows() + [(20, "three little words"), (21, "Three little WORDS"), (22, "three little"), (23, None), (None, "  ")]
    assert result(S.near_duplicates(frame(spark, rows))) == brute(rows)


def edited(base, rng, n):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.random()}"
    return " ".join(w)


def test_near_copies_round_the_threshold(spark):
    rng, rows = random.Random(5), []
    for g in range(12):
        base = words(g, 60)
        rows += [(100 * g + i, edited(base, rng, rng.randint(0, 4))) for i in range(14)]
    expected = brute(rows)
    assert len({c for _, _, c in expected}) > 20  # some copies are too far, some are reached through others only
    assert result(S.near_duplicates(frame(spark, rows))) == expected


def test_a_bucket_whose_hubs_link_little(spark):
    """A chain: neighbours are alike, others are not, yet many share bands."""
    base, rows = words(3, 300), []
    for i in range(24):
        rows.append((i, " ".join([*(f"new{j}" for j in range(4 * i)), *base[4 * i :]])))
    rows += [(100 + i, prose(50 + i, 40)) for i in range(5)]
    assert result(S.near_duplicates(frame(spark, rows))) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert S.near_duplicates(frame(spark, [])).collect() == []
    rows = [(1, prose(1, 30)), (2, prose(1, 30))]
    clash = frame(spark, rows).selectExpr("doc_id", "text", "1 AS n", "2 AS cls", "3 AS row", "'x' AS component_id", "4 AS h1")
    assert result(S.near_duplicates(clash)) == brute(rows)


def plain_signature(elements, m):
    """One element after the other, one step after the other, without stopping early."""
    least = [S.UNSET] * m
    for e in elements:
        places = list(range(m))
        for step in range(m):
            drawn = int(S._mix(np.array([e], np.uint64) + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2**64))[0])
            pick = step + ((drawn & 0xFFFFFFFF) * (m - step) >> 32)
            places[step], places[pick] = places[pick], places[step]
            least[places[step]] = min(least[places[step]], np.uint64(step << 32 | drawn >> 32))
    return least


def test_early_stop_changes_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 0, 7, 40, 300)]
    expected = np.array([plain_signature(x, 16) for x in sets], np.uint64)
    for block in (1 << 16, 11):  # whole sets, and sets that go through in pieces
        monkeypatch.setattr(S, "BLOCK", block)
        assert (S.signatures(sets, 16) == expected).all()


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for share in (0.2, 0.5, 0.8, 0.95):
        for _ in range(60):
            pool = rng.integers(0, 2**63, 60).astype(np.uint64)
            common = round(share * 60)
            rest = (60 - common) // 2
            a, b = pool[: common + rest], np.concatenate([pool[:common], pool[common + rest :]])
            true = common / 60
            x, y = S.signatures([a, b])
            errors.append(((x == y).mean() - true) / np.sqrt(true * (1 - true) / S.BANDS / S.ROWS))
    # unbiased, and with less spread than as many independent minima have (1)
    assert abs(np.mean(errors)) < 0.2 and np.std(errors) < 0.95
