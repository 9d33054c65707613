"""Best-fit packing planned on the length histogram.

Texts are tokenised once; only (document, piece, length, checksum) rows go on.  The plan is made on counts of
lengths, at most `size` of them: best-fit decreasing, where all bins with the same room move together as a
range of sequence numbers.  A plan row says "ranks a..b of length L go to sequences s.. at this offset".
Pieces get their rank within their length in two steps, local rank in the written partition plus the counts
of earlier partitions, so no length, however common, is gathered in one task; then they take their slots by
joining on length and rank.  The plan's size depends on the sequence size alone, so it is broadcast.

Defined results: null and empty texts are the end id alone (one piece of length 1); repeated rows are packed
each on its own; an empty table gives an empty table; extra columns are ignored; an over-long document is cut
into full pieces with the remainder first.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import needed, settled, table

SIZE, END, CHECKED = 1024, 2, 64


class ByteTokenizer:
    """Ids of a byte-level BPE file of the tokenizers library.

    The merges run in tiktoken, on ranks taken from the same file, which is several times faster.  The first text of
    each Arrow batch and one of CHECKED texts by hash are held against the tokenizers library, which also takes texts
    with the literal of a special token; a difference raises.  A vocabulary whose ids do not follow its merges is refused.
    """

    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        model = json.loads(self.lib.to_str())["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.added}
        if [vocab[a + b] for a, b in merges] != list(range(256, len(vocab))):
            raise ValueError("this vocabulary's ids are not in the order of its merges")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.fast = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocab.items()}, special_tokens={})

    def sampled(self, text: str) -> bool:
        return zlib.crc32(text.encode()) % CHECKED == 0

    def slow(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        return self.slow(text) if any(a in text for a in self.added) else self.fast.encode_ordinary(text)


_tokenizers: dict[str, ByteTokenizer] = {}


def pieces_of(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the place among its partition's pieces of that length (part, local)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = ByteTokenizer(tokenizer)
        tok, part, tail = _tokenizers[tokenizer], TaskContext.get().partitionId(), np.array([end], "<u4").tobytes()
        seen = [0] * (size + 1)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, rows = whole.slice(at, 512), []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    ids = tok.encode(text or "")
                    if (not at and not rows or tok.sampled(text or "")) and ids != tok.slow(text or ""):
                        raise ValueError(f"the two tokenizers differ on document {doc}")
                    ids = np.array(ids, "<u4").tobytes() + tail
                    n = len(ids) // 4
                    start, length, piece = 0, n % size or min(n, size), 0
                    while start < n:
                        rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                        seen[length] += 1
                        start, length, piece = start + length, size, piece + 1
                cols = list(zip(*rows)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])

    return needed(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long")


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) rows: best-fit decreasing over counts."""
    room: list[list[list[int]]] = [[] for _ in range(size + 1)]
    filled = np.zeros(size + 1, dtype=bool)
    out, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            fits = np.flatnonzero(filled[length:])
            if len(fits):
                r = length + int(fits[0])
            else:
                per = size // length
                room[size].append([opened, -(-left // per)])
                opened += -(-left // per)
                r, filled[size] = size, True
            first, count = room[r].pop()
            take = min(count, left)
            out.append((length, rank, take, first, size - r))
            if count > take:
                room[r].append([first + take, count - take])
            filled[r] = bool(room[r])
            if r > length:
                room[r - length].append([first, take])
                filled[r - length] = True
            rank, left = rank + take, left - take
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    spark = docs.sparkSession
    pieces = settled(spark, pieces_of(docs, tokenizer, size, end), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    rows = [(a, b, b + c, d - b, e) for a, b, c, d, e in plan(histogram, size)]
    slots = spark.createDataFrame(rows, "slot_length long, lo long, hi long, shift long, offset long")
    ranked = pieces.join(counts, ["part", "length"]).withColumn("rank", F.col("local") + F.col("before"))
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer or default_tokenizer())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
