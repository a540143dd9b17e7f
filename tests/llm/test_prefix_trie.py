"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest
from helpers import prose

from linewise.llm import prefix_trie as T

KIND = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, group=5, most=9):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in turns.items()}
    nodes = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % most
        rest = abs(c) % group * (1 if c >= 0 else -1)
        whole = own.get(c - rest, [])[:h] + t[h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((c, len(whole)))
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        under = children.get(path, [])
        leaves[path] = sum(leaves[p] for p in under) if under else 1
        saved[path] = sum(saved[p] for p in under) + ((len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0)
    out = []
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c, n in members if n == len(path))))
        parent = min(c for c, _ in nodes[path[:-1]]) if path else None
        out.append((min(c for c, _ in members), len(path), parent, len(members), len(children.get(path, [])), leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **how):
    got = T.trie(T.rebuilt(spark.createDataFrame(rows, KIND), **how))
    assert got.columns == T.COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, **how)


def chats(seed, n, most_turns=7, vocabulary=4):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["Étion", "a", "", "b c", "dd"][:vocabulary]))
            for c in range(-n // 3, n) for t in range(rng.randint(1, most_turns))]


@pytest.mark.parametrize("seed", range(3))
def test_random_chats(spark, seed):
    check(spark, chats(seed, 150))


@pytest.mark.parametrize("most", [1, 4])
def test_other_parameters(spark, most):
    check(spark, chats(7, 60), group=3, most=most)


def test_hot_first_turn_and_hot_conversation(spark):
    """More members of one node than a share holds: nodes and their ids are put together across shares."""
    rows = [(c, 0, "user", "hello") for c in range(400)] + [(c, 1, "assistant", prose(c, 3)) for c in range(0, 400, 3)]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1400) for t in range(9)]
    check(spark, rows, most=1)
    check(spark, rows)


def test_odd_rows(spark):
    long = prose(3, 60_000)
    rows = [
        (1, None, None, None), (1, None, "user", "x"), (1, 3, "user", ""), (2, 5, None, "x"), (2, 5, None, "x"), (None, 0, "user", "lost"),
        (3, 0, "us", "erx"), (4, 0, "user", "x"), (9, 0, "user", long), (8, 0, "user", long), (8, 1, "user", "1:"), (-1, 0, "", "1:"),
        *[(40, t, "user", f"{t}") for t in range(700)], *[(41, t, "user", f"{t}") for t in range(650)],
    ]
    rows = [r for r in rows if r[:2] != (1, None)] + [(1, None, None, None)]
    check(spark, rows)
    check(spark, rows, most=1)


def test_turnless_and_empty(spark):
    check(spark, [])
    # crc32 takes all of the only turn, and the group's first is absent or short
    rows = [(c, 0, "user", "y") for c in (1, 2, 3, 6, 7)]
    assert any(r[1] == 0 and r[7] != T.EMPTY for r in brute(rows))
    check(spark, rows)


def test_extra_columns_are_ignored(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a")]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "'x' AS first", "1 AS depth", "2 AS own", "3 AS digest")
    assert sorted((tuple(r) for r in T.trie(T.rebuilt(df)).collect()), key=str) == brute(rows)


def test_pieces_of_ids(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 7)
    check(spark, [(c, 0, "user", "same") for c in range(50)], most=1)
