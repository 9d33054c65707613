import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from foldview.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def enc():
    return pieces.MergeEncoder(MODEL)


ODD = ["", "  ", " a", "a ", "\n", "\n\n a\n", "a \n b", "▁x ▁", "日本語 テスト　x", "\x00a", "x" * 300 + "  yy  zz\n \n", "é́ ½ ﬁ", "<s> </s> <unk> <0x0A>", "\t\t a\r\n", "word, word. word!! ▁"]


def test_odd_texts(enc):
    for text in ODD:
        assert np.frombuffer(enc.encode_bytes(text), "<u4").tolist() == enc.lib.encode(text) == enc.encode_plain(text)
    enc.check()


def test_random_texts_and_both_agendas(enc):
    rnd = random.Random(4)
    parts = ["the", "ing", "tion", "a", "b", " ", " ", "\n", ".", ",", "!!", "é", "ß", "漢", "𝕏", "1", "23", "▁", "-", "$$$"]
    for _ in range(2000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        assert np.frombuffer(enc.encode_bytes(text), "<u4").tolist() == enc.lib.encode(text), text
        assert enc._scan(list(text)) == enc._heap(list(text))
    enc.check()


def test_cache_that_is_emptied():
    small = pieces.MergeEncoder(MODEL, cache=50)
    rnd = random.Random(5)
    for _ in range(200):
        text = " ".join(f"word{rnd.randint(0, 300)}," for _ in range(20)) + "\nend"
        assert np.frombuffer(small.encode_bytes(text), "<u4").tolist() == small.lib.encode(text)
    small.check()


def test_words_in_use_outlive_a_full_cache():
    small = pieces.MergeEncoder(MODEL, cache=50)
    merged = []
    split = small._split
    small._split = lambda word, mark: merged.append(word) or split(word, mark)
    for at in range(0, 400, 20):
        text = " ".join(["always", "again.", *(f"only{n}" for n in range(at, at + 20))])
        assert np.frombuffer(small.encode_bytes(text), "<u4").tolist() == small.lib.encode(text)
        small.check()
    assert merged.count("always") == merged.count("again.") == 1
    assert len(small.marked) <= 50 and len(small.aged[pieces.MARK]) <= 50


def test_rows(frame, odd_rows, enc):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.encode_rows(frame(odd_rows), MODEL).collect()}
    want = set()
    for d, t, *_ in odd_rows:
        ids = enc.lib.encode(t or "", add_bos=True, add_eos=True)
        want.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(enc.lib.decode(ids).encode()).hexdigest()))
    assert got == want
    assert pieces.encode_rows(frame([]), MODEL).count() == 0
