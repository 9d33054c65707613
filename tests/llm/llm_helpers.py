"""Texts and sums that several tests use."""

import random
import zlib

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text_of(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def edited(rnd, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return " ".join(words)


def crc(x):
    return zlib.crc32(str(x).encode()) % 4
