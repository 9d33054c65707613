import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_helpers import SCHEMA, edited, text_of  # noqa: E402


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents with copies, near copies, shared passages, odd texts, ties and nulls."""
    rnd = random.Random(5)
    texts = [text_of(rnd, rnd.randint(20, 200)) for _ in range(40)]
    passage = text_of(rnd, 60)
    texts += [texts[0]] * 6 + [texts[1].upper()] + [edited(rnd, texts[2], e) for e in (1, 1, 2, 3, 5, 8, 12, 20)]
    texts += [text_of(rnd, rnd.randint(10, 300)) + " " + passage + " " + text_of(rnd, rnd.randint(5, 80)) for _ in range(12)]
    texts += [edited(rnd, texts[3], 4) for _ in range(25)]
    texts += [None, "", " \n\t ", "one", "One", "one two three", "one two three", "a\x1fb c d e", "éß漢\U0001d54f " * 30, "same same same " * 80, text_of(rnd, 6000)]
    return [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s0", "s1"]), None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_rows(corpus):
    """The corpus with rows that come twice and rows without an id."""
    return [*corpus, corpus[5], corpus[5], (None, corpus[0][1], "en", "s0", 1), (None, None, None, None, None)]


@pytest.fixture()
def frame(spark):
    def make(rows, parts=3):
        return spark.createDataFrame(list(rows), SCHEMA).repartition(parts)

    return make
