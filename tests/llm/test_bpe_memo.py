import random

from treeloom.llm import bpe


def test_frequent_pieces_stay_in_the_memo():
    codec = bpe.Codec([(bytes([b]), b) for b in range(256)] + [(b"ab", 256)], r"\S+", remember=20).start()
    asked, find = [], codec.table.find
    codec.table.find = lambda key: (asked.append(key), find(key))[1]
    for i in range(200):
        assert codec.encode(f"abab x{i}")[:2] == [256, 256]
    assert asked.count(b"abab") == 1 and len(codec.cache) <= 20 and len(codec.older) <= 20


def test_short_merges_are_those_of_the_heap(monkeypatch):
    rng = random.Random(4)
    words = sorted({bytes(rng.choices(b"abc", k=k)) for k in (2, 2, 3, 3, 4, 5) for _ in range(8)})
    rng.shuffle(words)  # a longer one may have the lower rank
    codec = bpe.Codec([(bytes([b]), b) for b in range(256)] + [(w, 256 + i) for i, w in enumerate(words)], r"\S+").start()
    pieces = [bytes(rng.choices(b"abcd", k=k)) for k in range(1, 60) for _ in range(5)]
    short = [codec.merge(p) for p in pieces]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert short == [codec.merge(p) for p in pieces]
