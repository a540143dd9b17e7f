"""Small tables and plain-Python versions that the operators' results are held against."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(["ka", "lo", "mi", "tu", "ren", "É", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(seed: int, n: int) -> str:
    return " ".join(words(seed, n))


def frame(spark, rows):
    """documents rows from (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCUMENTS)


#: Every odd case at once: NULL id, NULL, empty and blank text, repeated rows, ties, one very long text, odd signs.
def odd_rows():
    return [
        (1, prose(1, 60)), (2, prose(1, 60)), (2, prose(1, 60)), (3, None), (4, ""), (5, " \n\t "), (6, "x" * 300_000),
        (7, prose(7, 40_000)), (8, "Ünïcödé 😀 word\x00nul <|endoftext|> tail"), (None, prose(9, 30)), (10, prose(10, 12)),
        (-11, "a b"), (12, prose(1, 60) + " zz"), (13, "İstanbul ΑΣ \x85  \x1c end  \n\n x"),
    ]
