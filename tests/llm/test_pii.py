import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import regex
from helpers import frame, odd_rows, prose

from linewise.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")),
            "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    # Python tries a long run again from each of its places, so it is spared runs that can't match
    text = re.sub("[a-z.]{9999,}(?!@[a-z])", lambda m: "?" * len(m[0]), text or "")
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if good(k, m[0])]


def values(rng):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = digits(15)
    card += next(c for c in "0123456789" if luhn(card + c))
    return rng.choice([
        f"u{digits(2)}@mail.example.org", f"a.b+c@x-{digits(1)}.de.", f"{rng.randint(0, 300)}.{rng.randint(0, 255)}.00{rng.randint(0, 99)}.1",
        card, "-".join(card[i : i + 4] for i in range(0, 16, 4)), "+" + digits(2) + " (0) " + digits(rng.randint(4, 12)), "a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8",
        "+1 ))))", "aaa@", "@b.c", "x@y", "9 9-9  9", "+12 3456789" + card, card + "@x.yz", "😀a@b.co😀", "...@..a", "+" + card, "ä@b.cd", "1..2.3.4",
    ])


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(2)
    rows = odd_rows() + [(1000 + i, rng.choice(["", " ", ",", "é "]).join(x for _ in range(rng.randint(1, 12)) for x in (values(rng), prose(i, 1)))) for i in range(300)]
    rows += [(5000, "a" * 200_000), (5001, "a." * 60_000 + "@"), (5002, "1." * 50_000), (5003, "+1" + ")" * 50_000), (5004, " ".join(f"u{i}@a.bc" for i in range(3000)))]
    got = sorted([tuple(r) for r in pii.digest(pii.find_private(frame(spark, rows).select("doc_id", "text"), support=10**9)).collect()], key=str)
    want = []
    for d, t in rows:
        spans = brute(t)
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((d, *[sum(x[0] == k for x in spans) for k in PLAIN], hashlib.sha256(written.encode()).hexdigest(), written))
    assert got == sorted(want, key=str)


def test_masking_covers_every_span_once(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(x for _ in range(5) for x in (values(rng), prose(i, 2)))) for i in range(150)] + [(999, None), (998, "clean text")]
    got = {r["doc_id"]: r for r in pii.mask(frame(spark, rows), labels={k: "\x01" for k in pii.KINDS}, support=10**9).collect()}
    for d, t in rows:
        spans = sorted((a, b) for _, a, b in brute(t))
        out, at = [], 0
        for a, b in spans:
            if a >= at:
                out.append(t[at:a] + "\x01")
            at = max(at, b)
        want = "".join(out) + t[at:] if spans else t
        assert got[d]["text"] == want and (t is None or got[d]["n_chars"] == len(want))


def test_disclosing_terms(spark):
    secret = "boss@corp.example"
    rows = [(i, f"{prose(i, 15)} Zaphodel wrote from {secret} in {prose(i + 500, 15)}") for i in range(8)]
    rows += [(100 + i, f"{prose(1000 + i, 25)} wrote from somewhere {prose(2000 + i, 4)}") for i in range(200)]
    rows += [(400, "only zaphodel. Zaphodels and ZAPHODEL"), (401, f"{prose(77, 10)} copied unique {secret}")]
    rows += [(500 + i, f"quuxword other@corp.example {prose(9, 30)}") for i in range(50)]  # copies are no evidence
    docs = frame(spark, rows).select("doc_id", "text")
    terms, _ = pii.revealing_terms(docs)
    assert {r["term"] for r in terms.collect()} == {"zaphodel"}
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_private(docs)).collect()}
    assert got[400] == "term:5:13,term:29:37"
    assert got[100] == "" and "term" in got[3] and "term" not in got[500]
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs, labels={"term": ""}).collect()}
    assert masked[400] == "only . Zaphodels and "


def plain_terms(rows, support=3, likelihood=0.5, bits=3.0):
    """The estimator in plain Python, from the same definitions."""
    tokens = lambda t: regex.findall(r"[\p{L}\p{Nd}]+", t.lower())
    total, found, words, holding = len(rows), defaultdict(dict), {}, Counter()
    copies = Counter(t or "" for _, t in rows)
    for t, n in copies.items():
        for w in {x for x in tokens(t) if len(x) >= 3}:
            holding[w] += n
        spans = brute(t)
        for k, a, b in spans:
            v = {"email": t[a:b].lower(), "ip": ".".join(str(int(x)) for x in t[a:b].split(".")) if k == "ip" else ""}.get(k, re.sub("[^0-9]", "", t[a:b]))
            left, right = regex.sub(r"^[\p{L}\p{Nd}]+", "", t[max(0, a - 80) : a]), regex.sub(r"[\p{L}\p{Nd}]+$", "", t[b : b + 80])
            found[k, v].setdefault(t, set()).add(left + " " + right)
        rest, at = "", 0
        for a, b in sorted((a, b) for _, a, b in spans):
            rest += t[at:a] + " " if a >= at else ""
            at = max(at, b)
        w = tokens(rest + t[at:])
        places = defaultdict(set)
        for i, x in enumerate(w):
            places[x].add((*w[max(0, i - 2) : i], None, *w[i + 1 : i + 3]))
        words[t] = {x: p for x, p in places.items() if len(x) >= 3}
    out = set()
    for texts in found.values():
        times = sum(copies[t] for t in texts)
        for term in {x for t in texts for x in words[t]}:
            own = [t for t in texts if term in words[t]]
            given = sum(copies[t] for t in own) / holding[term]
            # the fixtures give every text one surrounding of the value, one of a disclosing term, and origins of its own
            contexts, places = len({min(texts[t]) for t in own}), len({min(words[t][term], key=str) for t in own})
            if min(contexts, places, len({tuple(t.split()[:6]) for t in own})) >= support and given >= likelihood and math.log2(given * total / times) >= bits:
                out.add(term)
    return out


def test_terms_equal_the_plain_estimator(spark):
    rng, rows = random.Random(11), []
    spelt = {0: ["Ann.Lee@corp.example", "ann.lee@CORP.example"], 1: ["+49 30 1234567", "+49 (30) 123-4567"], 2: ["10.0.7.1", "010.0.07.1"], 3: ["4539 1488 0343 6467", "4539148803436467"]}
    names = {0: "zaphodel", 1: "cust77031", 2: "Vyx", 3: "9040411"}
    for i in range(400):
        t = [prose(3000 + 9 * i, rng.randint(40, 60))]
        if i % 10 < 4 and i < 120:
            v = i % 10
            t += [names[v]] * (i % 3 > 0) + [prose(9000 + i, 30)] + [rng.choice(spelt[v])]
        elif i % 50 == 7:
            t += [names[i // 50 % 4]]
        rows.append((i, " ".join([*t, prose(20_000 + i, 20)])))
    rows += [(900 + i, rows[i][1]) for i in range(5)]
    terms, _ = pii.revealing_terms(frame(spark, rows).select("doc_id", "text"))
    want = plain_terms(rows)
    assert {"zaphodel", "cust77031", "vyx", "9040411"} <= want  # some 200 characters from the value
    assert {r["term"] for r in terms.collect()} == want


def test_near_copies_and_shared_passages_are_no_evidence(spark):
    rng, rows, base = random.Random(5), [], prose(1, 120).split(" ")
    for i in range(40):  # one text, each copy with other words near the value and elsewhere
        w = list(base)
        for _ in range(6):
            w[rng.randrange(120)] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join([*w[:60], "Qorvex", *w[60:], prose(500 + i, 12), "near@corp.example", prose(700 + i, 12)])))
    passage = prose(2, 70) + " Trillianne " + prose(3, 70)
    rows += [(100 + i, f"{prose(4000 + i, 40)} {passage} {prose(5000 + i, 40)} far@corp.example {prose(6000 + i, 20)}") for i in range(12)]
    rows += [(1000 + i, prose(8000 + i, 80)) for i in range(600)]
    terms, _ = pii.revealing_terms(frame(spark, rows).select("doc_id", "text"))
    found = {r["term"] for r in terms.collect()}
    assert "qorvex" not in found and "trillianne" not in found


def test_clashing_columns(spark):
    docs = frame(spark, odd_rows()).withColumnsRenamed({"lang": "Key", "source": "terms", "n_chars": "spans"})
    found = pii.find_private(docs)
    assert found.columns == ["doc_id", "text", "Key", "terms", "spans"] and found.count() == len(odd_rows())
    assert dict(found.dtypes)["spans"].startswith("array")


def test_empty_table_and_plan(spark):
    assert pii.digest(pii.find_private(frame(spark, []).select("doc_id", "text"))).count() == 0
    found = pii.digest(pii.find_private(frame(spark, odd_rows()).select("doc_id", "text")))
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
