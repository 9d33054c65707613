"""Secret scans: pattern candidates, false positives removed by a random forest.

Candidates are private keys, values assigned to names such as token or password (in quotes up to the closing quote,
whatever stands before the name), signed tokens of three parts with dots, and what these leave of runs of key characters
with a digit.  Each candidate is described by length, character transitions, dictionary coverage, path and neighbouring
words; a forest of bootstrapped trees, trained from labelled findings, gives the probability that it is a secret.
`labelled_findings` makes the labelled set (a bounded, seeded number of rows, by parameter); a caller may give its own
rows instead.  The dictionary is the words of a public tokenizer's vocabulary, whose path is a parameter.  The model is
a few hundred tree nodes and at most DICTIONARY words and is broadcast; scanning is one pass over whole texts with no
shuffle.

Defined results: null and empty texts have no findings; candidates do not overlap: keys come first, then assigned
values, then signed tokens, and runs take what is left; repeated rows are scanned each on its own; very long texts are
scanned whole; a null source is an empty path; an empty table gives an empty table; `scan` ignores extra columns and
`redact` keeps them, replacing each secret by MASK and n_chars, where there is one, by the new length.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import bounded, needed, numbered, table, with_texts

MASK = "[SECRET]"
CUT = 0.5
NAMES = "token|secret|passwd|password|pwd|api_key|apikey|api-key|access_key|auth|credential|private_key|bearer"
#: one pattern that both RE2 and Python read alike; it finds every document that has a candidate
LIKELY = r"(?i)[a-z0-9_+/=\-]{16,}|eyj[a-z0-9_\-]{8,}\.|(?:" + NAMES + r")[a-z_]{0,12}[\"']?\s{0,3}[:=]|-----BEGIN"
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?!-----(?:BEGIN|END) )[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----")
#: a value in quotes goes up to the closing quote; a bare one may have punctuation, but an & before name= is a URL's
ASSIGNED = re.compile(
    r"(?i:(?:" + NAMES + r")[a-z_]{0,12}[\"']?\s{0,3}[:=]\s{0,3})"
    r"(?:\"(?P<double>(?:[^\"\\\r\n]|\\.){6,}+)\"|'(?P<single>(?:[^'\\\r\n]|\\.){6,}+)'"
    r"|[\"']?(?P<bare>(?:[A-Za-z0-9_+/=.~@!#$%^*?|:\-]|&(?![A-Za-z0-9_]+=)){6,}))",
    re.ASCII,
)
RUN = re.compile(r"(?<![A-Za-z0-9_+/\-])[A-Za-z0-9_+/\-]{14,}+(?:={1,2}(?![A-Za-z0-9_+/=\-]))?", re.ASCII)
#: header, claims and signature, in base64 of URLs
SIGNED = re.compile(r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+(?:\.[A-Za-z0-9_\-]++)?", re.ASCII)
CONTEXT = 40
#: words of the dictionary at most, and their length
DICTIONARY, WORD_LEAST, WORD_MOST = 100_000, 4, 16
PUNCTUATION = "@!#$%^&*?"
#: fixed words: what speaks for and against a secret nearby, and common words that identifiers are made of
FOR = ("token", "secret", "password", "passwd", "pwd", "key", "auth", "credential", "bearer", "private")
AGAINST = ("commit", "sha", "md5", "checksum", "hash", "digest", "uuid", "integrity", "revision", "version", "example", "build", "etag", "blob")
PLACEHOLDERS = ("your", "example", "changeme", "placeholder", "xxxx", "dummy", "sample", "redacted", "insert", "todo", "1234567890", "abcdef")
WORDS = tuple("the and for with that this from have not are was will can all one time user name value config default public function return string number list file path data table model test result error state event group index count sum view source target client server service request response header body page document window order price customer part supplier region nation line item date status type color size image button label input output format parse load store read write open close start stop run build make create update delete insert select where join filter map reduce key node tree graph text word char byte block chunk stream batch queue stack cache session cookie login logout admin account email phone address country city street first last next previous current total average maximum minimum length width height long short large small new old".split())
PATH_AGAINST = ("test", "fixture", "example", "mock", "lock", "vendor", "docs")
FEATURES = ("length", "entropy", "class_changes", "digit_share", "upper_share", "vowel_share", "repeat_share", "bigram_fit", "coverage", "placeholder", "hex_only", "near_for", "near_against", "assigned", "quoted", "path_against", "known_format")
_BIGRAMS = Counter(a + b for w in WORDS for a, b in zip(w, w[1:]))
_KNOWN = re.compile(r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]+\.[\w-]+|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[\w-]{35}|-----BEGIN)")


@functools.cache
def dictionary(vocabulary: str | None = None) -> frozenset[str]:
    """Words of WORD_LEAST to WORD_MOST letters that begin a word in a byte-level vocabulary file of the tokenizers library (None: the public one)."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    with open(vocabulary, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    begins = chr(256 + ord(" "))  # how such files write a blank
    words = sorted(t[1:].lower() for t in tokens if t.startswith(begins) and t[1:].isascii() and t[1:].isalpha() and WORD_LEAST <= len(t) - 1 <= WORD_MOST)
    return frozenset(words[:DICTIONARY]) | frozenset(w for w in WORDS if len(w) >= WORD_LEAST)


def coverage(value: str, words: frozenset[str]) -> float:
    """Share of a value's characters in dictionary words, the longest first from the left; a word ends where letters change to upper case."""
    covered = 0
    for m in re.finditer(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", value):
        part, at = m[0].lower(), 0
        while at <= len(part) - WORD_LEAST:
            k = next((k for k in range(min(WORD_MOST, len(part) - at), WORD_LEAST - 1, -1) if part[at : at + k] in words), 0)
            covered, at = covered + k, at + (k or 1)
    return covered / len(value)


def features(value: str, left: str, right: str, path: str, dictionary_: frozenset[str] | None = None) -> list[float]:
    low, n = value.lower(), len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    share = lambda k: kinds.count(k) / n
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    letters = [low[i : i + 2] for i in range(n - 1) if low[i : i + 2].isalpha()]
    before, words = left.lower(), re.findall(r"[a-z]+[0-9]*", left.lower())
    return [
        min(n, 500), entropy, sum(a != b for a, b in zip(kinds, kinds[1:])) / max(n - 1, 1), share("d"), share("u"),
        sum(c in "aeiou" for c in low) / n, sum(a == b for a, b in zip(value, value[1:])) / max(n - 1, 1),
        sum(math.log1p(_BIGRAMS[x]) for x in letters) / max(n - 1, 1), coverage(value, dictionary() if dictionary_ is None else dictionary_),
        float(any(p in low for p in PLACEHOLDERS)), float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None),
        float(any(p in w for w in words[-3:] for p in FOR)), float(any(p in w for w in words[-3:] for p in AGAINST)),
        float(re.search(r"[=:]\s*[\"']?$", before) is not None), float(bool(left) and left[-1] in "\"'" and right[:1] == left[-1]),
        float(any(p in path.lower() for p in PATH_AGAINST)), float(_KNOWN.match(value) is not None),
    ]


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of each candidate, in order and without overlap."""
    keys = [m.span() for m in PEM.finditer(text)]
    found, taken = [(a, b, "private key") for a, b in keys], list(keys)
    for pattern, kind in ((ASSIGNED, "assigned value"), (SIGNED, "signed token")):
        before, k = sorted(taken), 0
        for m in pattern.finditer(text):
            while k < len(before) and before[k][1] <= m.start():
                k += 1
            if k == len(before) or before[k][0] >= m.end():
                found.append((*m.span(m.lastgroup or 0), kind))
                taken.append(m.span())
    taken.sort()
    at = 0
    for m in RUN.finditer(text):  # what keys and assignments leave of it
        a, end = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        k = at
        while a < end:
            b = min(end, taken[k][0]) if k < len(taken) else end
            if b - a >= 16 and any(c.isdigit() for c in text[a:b]):
                found.append((a, b, "key-like run"))
            if k == len(taken):
                break
            a, k = max(a, taken[k][1]), k + 1
    yield from sorted(found)


def labelled_findings(n: int = 3000, seed: int = 11, vocabulary: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labelled candidates as (features, 0/1): keys of usual formats and names, and what scanners mistake for them."""
    rnd, words = random.Random(seed), dictionary(vocabulary)
    hexa, base, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, a, b: "".join(rnd.choices(chars, k=rnd.randint(a, b)))
    word = lambda: rnd.choice(WORDS) if rnd.random() < 0.5 else some("aeiouthnsrdl", 2, 9)
    talk = lambda: " ".join(word() for _ in range(rnd.randint(1, 6)))
    human = lambda: "".join({"a": "@", "e": "3", "o": "0", "s": "5"}.get(c, c) if rnd.random() < 0.6 else c for c in rnd.choice([word().capitalize(), word()]) + some(alnum, 2, 5)) + some(PUNCTUATION, 1, 2) + some(alnum + PUNCTUATION, 1, 5)
    x, y = [], []
    for _ in range(n):
        secret = rnd.random() < 0.5
        path = rnd.choice(["src/app.py", "config/prod.env", "web", "src3", "notes", "tests/unit.py" if not secret or rnd.random() < 0.2 else "deploy.yml", "package.lock" if not secret else "main.go"])
        if secret:
            value = rnd.choice([lambda: some(hexa, 32, 64), lambda: some(hexa, 40, 40), lambda: some(hexa, 40, 40).upper(), lambda: some(base, 24, 64), lambda: some(alnum, 20, 48), lambda: "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), lambda: "ghp_" + some(alnum, 36, 36), lambda: "eyJ" + ".".join(some(alnum + "_-", *k) for k in ((17, 34), (30, 90), (43, 43))), lambda: some(alnum + "_-.~", 10, 20) + "7", human, human])()
            typed = any(c in PUNCTUATION for c in value)
            name = rnd.choice(FOR)
            name = name.upper() if rnd.random() < 0.2 else name
            left = talk() + " " + rnd.choice([f'{name} = "', f"{name}: ", f"{name}='", f"api_{name}=", f'"{name}": "', f"{name} ", f"{name}=\""])
            if rnd.random() < 0.2:
                left = talk() + rnd.choice([" ", "\n"]) + f"{word().upper()}_{name.upper()}="
            elif typed:
                left = talk() + " " + rnd.choice([f'{name} = "', f"{name}: ", f"{name}='", f"{name}="])
            if _KNOWN.match(value) and rnd.random() < 0.4:
                left = talk() + " "
        else:
            kind = rnd.randrange(10)
            value = [lambda: some(hexa, 40, 64), lambda: "-".join(some(hexa, k, k) for k in (8, 4, 4, 4, 12)), lambda: "_".join(rnd.choice(WORDS) for _ in range(rnd.randint(3, 6))) + str(rnd.randint(0, 99)), lambda: "/".join(word() for _ in range(rnd.randint(3, 6))) + str(rnd.randint(0, 9)), lambda: rnd.choice(PLACEHOLDERS) + rnd.choice(["-", "_", ""]) + rnd.choice(["key", "token", "here", "secret", "value123"]), lambda: some("0123456789", 16, 24), lambda: some("aeiouthnsrdl", 14, 30) + str(rnd.randint(0, 9)), lambda: talk() + " " + talk() + rnd.choice([".", "!", ""]), lambda: f"https://{word()}.example.org/{word()}/{word()}", lambda: rnd.choice(["AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 9, 9) + "EXAMPLE", "ghp_" + "x" * 36, "sk_test_" + "1234567890" * 2 + "abcd", "ghp_" + rnd.choice(["example", "your", "dummy"]) + some(alnum, 30, 30)])][kind]()
            if kind in (4, 7, 8) or kind == 9 and rnd.random() < 0.6:
                left = talk() + " " + rnd.choice([f'{rnd.choice(FOR)} = "', f"{rnd.choice(FOR)}="])
            elif kind in (0, 1):
                left = talk() + " " + rnd.choice(AGAINST[:10]) + rnd.choice([" ", ": ", '="', "-", "="])
            else:
                left = talk() + rnd.choice([" ", ' "', " = ", ": "])
        right = (left[-1] if left[-1] in "\"'" else " ") + talk()
        x.append(features(value, left[-CONTEXT:], right, path, words))
        y.append(int(secret))
    return np.array(x), np.array(y)


class Forest:
    """Bootstrapped trees with a random subset of features at each split, as flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 8, least: int = 3, seed: int = 5):
        rnd = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            pick = rnd.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self._grow(x[pick], y[pick], depth, least, rnd, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int, rnd: np.random.Generator, nodes: list) -> int:
        at, p = len(nodes), float(y.mean())
        nodes.append([-1, 0.0, 0, 0, p])
        if depth and 0 < p < 1 and len(y) >= 2 * least:
            best = (p * (1 - p) * len(y) - 1e-9, -1, 0.0)
            for f in rnd.choice(x.shape[1], math.isqrt(x.shape[1]) + 1, replace=False):
                for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 13))):
                    left = x[:, f] <= cut
                    k = int(left.sum())
                    if least <= k <= len(y) - least:
                        a, b = y[left].mean(), y[~left].mean()
                        impure = a * (1 - a) * k + b * (1 - b) * (len(y) - k)
                        if impure < best[0]:
                            best = (impure, int(f), float(cut))
            if best[1] >= 0:
                left = x[:, best[1]] <= best[2]
                nodes[at][:2] = best[1], best[2]
                nodes[at][2] = self._grow(x[left], y[left], depth - 1, least, rnd, nodes)
                nodes[at][3] = self._grow(x[~left], y[~left], depth - 1, least, rnd, nodes)
        return at

    def probability(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), dtype=int)
            while (inner := t[at, 0] >= 0).any():
                f = np.maximum(t[at, 0], 0).astype(int)
                down = np.where(x[rows, f] <= t[at, 1], t[at, 2], t[at, 3]).astype(int)
                at = np.where(inner, down, at)
            total += t[at, 4]
        return total / len(self.trees)


def train(findings: tuple[np.ndarray, np.ndarray] | None = None, vocabulary: str | None = None) -> Forest:
    """The forest, with the dictionary that its coverage is of."""
    out = Forest(*(labelled_findings(vocabulary=vocabulary) if findings is None else findings))
    out.words = dictionary(vocabulary)
    return out


def _judged(texts: pa.Array, paths: list[str | None], forest: Forest) -> Iterator[tuple[int, str, list[tuple[int, int, str, float]]]]:
    """(row, text, findings) of the rows that have candidates."""
    likely = pc.match_substring_regex(texts, LIKELY)
    for i in np.flatnonzero(likely.fill_null(False).to_numpy(zero_copy_only=False)):
        text = texts[int(i)].as_py()
        found = list(candidates(text))
        if found:
            x = np.array([features(text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], paths[i] or "", forest.words) for a, b, _ in found])
            yield int(i), text, [(a, b, kind, float(p)) for (a, b, kind), p in zip(found, forest.probability(x))]


def scan(docs: DataFrame, forest: Forest | None = None, cut: float = CUT) -> DataFrame:
    """doc_id, start, end (code points), kind, value_sha256, score, is_secret: one row for each candidate of docs (doc_id, text, source)."""
    model = docs.sparkSession.sparkContext.broadcast(forest or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for i, text, found in _judged(batch.column("text"), batch.column("source").to_pylist(), model.value):
                doc = ids[i].as_py()
                rows += [(doc, a, b, kind, hashlib.sha256(text[a:b].encode()).hexdigest(), p, p >= cut) for a, b, kind, p in found]
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_()))], names=["doc_id", "start", "end", "kind", "value_sha256", "score", "is_secret"])

    return needed(docs, doc_id="long", text="string", source="string").mapInArrow(run, "doc_id long, start long, end long, kind string, value_sha256 string, score double, is_secret boolean")


def redact(docs: DataFrame, forest: Forest | None = None, cut: float = CUT) -> DataFrame:
    """docs with every secret of text replaced by MASK; all rows and columns stay."""
    model = bounded(docs.sparkSession).sparkContext.broadcast(forest or train())
    plain, at = numbered(docs), docs.columns.index("text")
    path = docs.columns.index("source") if "source" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            paths = batch.column(path).to_pylist() if path is not None else [None] * batch.num_rows
            changed = {}
            for i, text, found in _judged(texts, paths, model.value):
                if spans := [(a, b) for a, b, _, p in found if p >= cut]:
                    kept = [text[x:y] for x, y in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)])]
                    changed[i] = MASK.join(kept)
            if changed:
                mask = np.zeros(batch.num_rows, dtype=bool)
                mask[sorted(changed)] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], texts.type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], names=batch.schema.names)

    return with_texts(docs, plain.mapInArrow(run, plain.schema))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
