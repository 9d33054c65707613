import random
import zlib

import numpy as np
import pytest

from foldview.llm import packing

TOKENIZER = packing.default_tokenizer()


@pytest.fixture(scope="module")
def tokenizer():
    return packing.ByteTokenizer(TOKENIZER)


def test_ids_are_the_librarys(tokenizer):
    rnd = random.Random(2)
    parts = [" ", "\n", "\t", "a", "B", "1", "'s", "'", "é", "日", ".", "!", " ", "\r", "\x1c", "<|endoftext|>", "\x85", "　", "ab", "$$$", "²", "\U0001d54f", "\x00", "re"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        assert tokenizer.encode(text) == tokenizer.slow(text)


def test_plan_places_every_rank_once_and_packs_tightly():
    rnd = random.Random(3)
    for _ in range(20):
        histogram = {rnd.randint(1, 64): rnd.randint(1, 40) for _ in range(rnd.randint(1, 50))}
        used, spans = {}, {}
        for length, rank, count, first, offset in packing.plan(histogram, 64):
            for i in range(count):
                assert (length, rank + i) not in used
                used[length, rank + i] = first + i
                spans.setdefault(first + i, []).append((offset, length))
        assert len(used) == sum(histogram.values())
        for pieces in spans.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 64
        full = sum(n * c for n, c in histogram.items())
        assert len(spans) <= 11 / 9 * -(-full // 64) + sum(1 for n in histogram if n > 32) * 40
    assert packing.plan({}, 64) == []


@pytest.mark.parametrize("size", [1024, 16, 1])
def test_pieces_round_trip(frame, odd_rows, tokenizer, size):
    got = packing.pack(frame(odd_rows), TOKENIZER, size).collect()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    want = []
    for d, t, *_ in odd_rows:
        ids = [*tokenizer.slow(t or ""), 2]
        head = len(ids) % size or min(size, len(ids))
        for k, a in enumerate([0, *range(head, len(ids), size)]):
            part = ids[a : head if k == 0 else a + size]
            want.append((d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)


def test_empty_table(frame):
    assert packing.pack(frame([]), TOKENIZER).count() == 0
