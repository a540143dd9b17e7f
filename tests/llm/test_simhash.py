import random

import numpy as np
import xxhash
from helpers import frame, odd_rows, prose

from linewise.llm import simhash


def brute_fingerprint(text, width=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        lowered = lowered.replace(c, " ")
    w = [x for x in lowered.split(" ") if x]
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, distance):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def check(spark, rows, distance=4):
    got = sorted(map(tuple, simhash.near_duplicates(frame(spark, rows).select("doc_id", "text"), 4, distance).collect()), key=str)
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    roots = brute_components({f for _, f in fps}, distance)
    least = {}
    for d, f in fps:
        if d is not None:
            least[roots[f]] = min(d, least.get(roots[f], d))
    assert got == sorted([(d, f"{f:016x}", least.get(roots[f])) for d, f in fps], key=str)
    return got


def test_odd_rows_against_brute_force(spark):
    check(spark, odd_rows())


def test_near_copies_and_wide_distance(spark):
    rng, rows = random.Random(5), []
    for i in range(60):
        w = prose(i // 6, 150).split(" ")
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i * 3, " ".join(w)))
    for distance in (0, 3, 4):
        got = check(spark, rows, distance)
    assert len({x[2] for x in got}) < len(rows)


def test_ball_hashing_finds_every_pair(spark, monkeypatch):
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:120]:
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            f ^= 1 << bit
        fps.add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    monkeypatch.setattr(simhash, "VARIANTS", 20_000)
    frame_ = spark.createDataFrame(signed, "fp bigint")
    # the smaller share makes tasks part their variants again
    edges = simhash.links(frame_, 4, 5000 * 20).collect()
    mask = (1 << 64) - 1
    linked = {}
    for a, b in edges:
        assert bin((a ^ b) & mask).count("1") <= 4
        linked.setdefault(a & mask, set()).add(b & mask)
    want = brute_components(fps, 4)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, others in linked.items():
        for b in others:
            root[find(a)] = find(b)
    groups = lambda of: sorted(sorted(f for f in fps if of(f) == r) for r in {of(f) for f in fps})
    assert groups(find) == groups(lambda f: want[f])


def test_odd_distances_lose_no_link():
    rng = random.Random(4)
    for _ in range(40):
        centre, distance = rng.getrandbits(64), rng.choice([1, 3])
        fps = {centre}
        while len(fps) < 12:  # tight groups: many fingerprints at just about the distance
            f = centre
            for bit in rng.sample(range(8), rng.randint(1, 4)):
                f ^= 1 << bit
            fps.add(f)
        own = np.array(sorted(fps), np.uint64)
        radius, root = (distance + 1) // 2, {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for prefix in range(64):
            near = own[np.bitwise_count((own >> np.uint64(58)) ^ np.uint64(prefix)) <= radius]
            for pairs in simhash._collide(prefix, 6, near, radius, distance):
                for a, b in pairs.T.tolist():
                    assert bin(a ^ b).count("1") <= distance
                    root[find(a)] = find(b)
        assert len({find(f) for f in fps}) == len(set(brute_components(fps, distance).values()))


def test_empty_table_and_clashing_columns(spark):
    assert simhash.near_duplicates(frame(spark, []).select("doc_id", "text")).count() == 0
    extra = frame(spark, odd_rows()).withColumnsRenamed({"lang": "root", "source": "fp", "n_chars": "row"})
    assert simhash.near_duplicates(extra).columns == ["doc_id", "fingerprint", "component_id"]
    kept = simhash.keep_first(extra)
    assert kept.columns == extra.columns and kept.select("fp").distinct().count() == 1


def test_one_row_of_each_component_stays(spark):
    rows = odd_rows() + [(None, prose(9, 30)), (None, None), (1, prose(1, 60))]
    found = [tuple(r) for r in simhash.near_duplicates(frame(spark, rows)).collect()]
    kept = simhash.keep_first(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({c for _, _, c in found if c is not None})
    assert [r["text"] for r in kept if r["doc_id"] is None] == [prose(9, 30)]
