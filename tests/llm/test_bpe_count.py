import random

from helpers import frame, odd_rows, prose
from tokenizers import Tokenizer

from linewise.llm import bpe_count
from linewise.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def test_counts_equal_the_library(spark):
    rng = random.Random(4)
    signs = list(" \n\t\r\x0b\x1c\x1d\x85  　'’.,!?019²Ⅷaé漢字😀́‍\x00") + ["<|endoftext|>", "'s", "'ll", " the", "  "]
    rows = odd_rows() + [(1000 + i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(5000, "a" * 5000), (5001, "ab" * 40_000), (5002, " " * 3000 + "x"), (5003, prose(3, 3000).upper())]
    library = Tokenizer.from_file(PATH)
    want = sorted([(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows], key=str)
    got = bpe_count.count_tokens(frame(spark, rows), PATH).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_forgetting_changes_nothing(monkeypatch):
    counter = bpe_count.Counter(PATH)
    text = prose(12, 500)
    want = counter(text)
    monkeypatch.setattr(bpe_count, "REMEMBERED", 3)
    assert bpe_count.Counter(PATH)(text) == want


def test_empty_table(spark):
    assert bpe_count.count_tokens(frame(spark, []), PATH).count() == 0
