"""SentencePiece encoding and decoding by a score-ordered agenda of adjacent symbol pairs.

A merge-type vocabulary is applied as the library does: a text becomes its characters, and of all adjacent
pairs whose concatenation is a piece the best-scored one, leftmost among equals, is merged until none is
left; what is no piece then falls back to bytes.  The agenda is a plain array of ranks for short segments
and a heap for long ones.  A text is cut first where no piece of the vocabulary can reach across (verified
on the vocabulary: no piece has a word mark after another character, none contains a line feed), so
segments are independent and their ids are cached, boundedly, in each Python worker, in two ages of dictionaries.

Every segment that enters the cache is checked against the sentencepiece library once in each Arrow batch,
and so is the first document of each batch as a whole; a difference raises.  Vocabularies that normalise text or break
the cuts are refused when loaded.

Defined results: null and empty texts encode to the begin and end ids alone and decode to an empty string.
Repeated rows are encoded each on its own; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import needed, table

MARK = "▁"
FAR = 1 << 60
SHORT = 24
CACHE = 1_000_000
TAIL = ".,;:!?*$%&#|"


class MergeEncoder:
    def __init__(self, model: str, cache: int = CACHE):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bos, self.eos, self.size = sp.bos_id(), sp.eos_id(), cache
        normal, special = [], {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                special[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append((sp.id_to_piece(i), i))
        self.ids = dict(normal)
        order = {s: n for n, s in enumerate(sorted({sp.get_score(i) for _, i in normal}, reverse=True))}
        self.rank = {p: order[sp.get_score(i)] for p, i in normal}
        self.bytes_ = [special.get(b, sp.unk_id()) for b in range(256)]
        if len(special) < 256 or any("\n" in p or MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("this vocabulary has pieces across the cuts, or no byte fallback")
        if sp.encode("a  b ½　c ") != self.encode_plain("a  b ½　c "):
            raise ValueError("this model normalises text")
        self.pairs = {a + b for p in self.ids for a, b in zip(p, p[1:])}  # adjacent characters inside a piece
        self.line = np.array([self.bytes_[10]], "<u4").tobytes()
        self.unchecked: list[tuple[str, str]] = []
        self.marked: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {"": b""}
        self.aged: dict[str, dict[str, bytes]] = {MARK: {}, "": {}}  # by mark, what was cached before

    def merge(self, text: str) -> list[str]:
        return self._scan(list(text)) if len(text) <= SHORT else self._heap(list(text))

    def _scan(self, symbols: list[str]) -> list[str]:
        rank = self.rank
        agenda = [rank.get(a + b, FAR) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == FAR:
                break
            i = agenda.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i:
                agenda[i - 1] = rank.get(symbols[i - 1] + symbols[i], FAR)
            if i < len(agenda):
                agenda[i] = rank.get(symbols[i] + symbols[i + 1], FAR)
        return symbols

    def _heap(self, symbols: list[str]) -> list[str]:
        rank, n = self.rank, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(r, i, i + 1, 2) for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (r := rank.get(symbols[a] + symbols[b])) is not None:
                heapq.heappush(agenda, (r, a, b, len(symbols[a]) + len(symbols[b])))

        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or after[a] != b or len(symbols[a]) + len(symbols[b]) != size:
                continue  # one side was merged meanwhile
            symbols[a] += symbols[b]
            symbols[b] = ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s]

    def numbers(self, text: str) -> list[int]:
        """Ids of a segment that already carries its word marks."""
        out, ids = [], self.ids
        for s in self.merge(text):
            i = ids.get(s)
            if i is None:
                out += [self.bytes_[b] for b in s.encode()]
            else:
                out.append(i)
        return out

    def encode_plain(self, text: str) -> list[int]:
        """Without cuts or cache, as a check."""
        return self.numbers(MARK + text.replace(" ", MARK)) if text else []

    def _learn(self, words: list[str], cache: dict[str, bytes], mark: str) -> None:
        """Put words into the cache; when it is full it becomes the aged one, from which words in use come back unmerged."""
        aged = self.aged[mark]
        fresh = [w for w in dict.fromkeys(words) if w not in cache]
        if len(cache) + len(fresh) > self.size:
            aged.clear()
            aged.update(cache)
            cache.clear()
            cache[""] = b"" if not mark else np.array(self.numbers(mark), "<u4").tobytes()
            fresh = [w for w in dict.fromkeys(words) if w not in cache]
        for w in fresh:
            known = aged.get(w)
            if known is None:
                known = np.array(self._split(w, mark), "<u4").tobytes()
                self.unchecked.append((mark, w))
            cache[w] = known

    def check(self) -> None:
        """Hold the segments learnt since the last check against the library, as one text for each few hundred."""
        todo, self.unchecked = self.unchecked, []
        cached = lambda mark, w: (self.marked if mark else self.bare).get(w)
        for at in range(0, len(todo), 512):
            part = todo[at : at + 512]
            ours = [cached(*x) for x in part]
            if None in ours:  # the cache was emptied meanwhile
                ours = [np.array(self.numbers(m + w), "<u4").tobytes() for m, w in part]
            # a line feed before each; the library puts a word mark before the first
            text = "".join("\n" + m.replace(MARK, " ") + w for m, w in part)
            theirs = self.lib.encode(text, num_threads=1)
            mine = np.frombuffer(b"".join(self.line + x for x in ours), "<u4").tolist()
            if theirs[1:] != mine:
                raise ValueError(f"the agenda and the library differ on one of {part}")

    def _split(self, word: str, mark: str) -> list[int]:
        """Ids of a word; trailing punctuation that no piece ties to what stands before it is merged on its own, and shared."""
        head = word.rstrip(TAIL)
        if len(head) == len(word) or not head or head[-1] + word[len(head)] in self.pairs:
            return self.numbers(mark + word)
        cache = self.marked if mark else self.bare
        known = cache.get(head, self.aged[mark].get(head))
        first = self.numbers(mark + head) if known is None else np.frombuffer(known, "<u4").tolist()
        if known is None and len(cache) < self.size:
            cache[head] = np.array(first, "<u4").tobytes()
        return first + self.numbers(word[len(head) :])

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        if MARK in text or "  " in text or text[0] == " ":
            return b"".join(self._runs(text))
        words = text.split(" ")
        out = list(map(self.marked.get, words))
        if None in out:
            holes = [i for i, x in enumerate(out) if x is None]
            plain = [words[i] for i in holes if "\n" not in words[i]]
            if plain:
                self._learn(plain, self.marked, MARK)
            for i in holes:
                w = words[i]
                if "\n" in w:
                    head, *rest = w.split("\n")
                    out[i] = b"".join([self._one(head, self.marked, MARK), *(self.line + self._one(x, self.bare, "") for x in rest)])
                else:
                    out[i] = self._one(w, self.marked, MARK)
        return b"".join(out)

    def _one(self, word: str, cache: dict[str, bytes], mark: str) -> bytes:
        if word not in cache:
            self._learn([word], cache, mark)
        return cache[word]

    def _runs(self, text: str) -> Iterator[bytes]:
        """Texts with runs of word marks: a segment is a run of marks and what follows it."""
        import re

        for segment in re.findall(rf"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+", MARK + text.replace(" ", MARK)):
            yield np.array(self.numbers(segment), "<u4").tobytes()


_encoders: dict[str, MergeEncoder] = {}


def encoder(model: str) -> MergeEncoder:
    if model not in _encoders:
        _encoders[model] = MergeEncoder(model)
    return _encoders[model]


def encode_rows(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        first, last = (np.array([x], "<u4").tobytes() for x in (enc.bos, enc.eos))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x or "" for x in batch.column("text").to_pylist()]
                coded = [first + enc.encode_bytes(x) + last for x in texts]
                lists = [np.frombuffer(x, "<u4").tolist() for x in coded]
                if not at and texts and lists[0] != (want := [enc.bos, *enc.lib.encode(texts[0], num_threads=1), enc.eos]):
                    raise ValueError(f"the agenda and the library differ on a document of {len(want)} ids")
                enc.check()
                decoded = enc.lib.decode(lists, num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(x) for x in lists], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in coded]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return needed(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return encode_rows(table(spark, sf_dir, "documents"), model)
