"""I-Match fingerprints over randomised lexicons.

Terms are words, A-Z lower-cased.  Document frequencies are counted over all documents; the lexicon keeps the
terms whose inverse document frequency ln(N / df) lies in a band.  The band's upper edge bounds the lexicon: at
most (mean distinct terms of a document) / exp(-idf_high) terms, whatever the corpus size, which is why it may
be broadcast.  `subsets` lexicons keep each term by a seeded hash, with probability `keep`,
keep / 2, keep / 4 and keep / 8 in turn, for short and long texts; of a text, the
distinct terms in each subset are sorted and hashed, which gives one 16-bit part of the fingerprint.  The
likeness of two fingerprints is the share of equal parts among those that are not empty in both.

The lexicon takes two passes over the texts, and no term of the corpus travels as a string but the lexicon's own.
First, each task counts 64-bit hashes of terms by segments, as many rows as HELD distinct terms allow, and passes on
those that at least LOSS of a segment's documents have; what a term loses so is under LOSS of all documents, so every
term of the band is among the sums that reach the band's edge less that.  Those candidates, at most (mean distinct
terms of a document) / (exp(-idf_high) - LOSS) numbers, are then counted exactly.  A term is known by its 64-bit hash.

The next document is found by dealing documents out by ranges of doc_id, whose first ids are known from a pass over
the ids alone.  The first document of a range is also sent to the range before, as a guest, the very first to the last
range; so a document's neighbour is the next row of its range, texts travel once and nothing else is written.

Defined results: null text counts as empty; a text without lexicon terms gets one part, the hash of all its
distinct terms, so equal texts stay equal and others differ; the likeness of a text to itself is 1; with a single
document the next document is itself.  Rows with equal doc_id follow in the order of their texts; a null doc_id
comes first.  Very long texts are processed whole, a row at a time.  An empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, cleaned, needed, string_chunks, table

IDF_LOW, IDF_HIGH = 1.0, 5.3
SUBSETS, KEEP = 64, 0.016
#: share of a segment's documents below which a term is not passed on in the first pass, as a part of the band's lower frequency
LOSS = 1 / 8
#: distinct terms that a task holds at most, but for one step's
HELD = 2_000_000


def _merged(terms: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms, sorted, with their counts added up."""
    whole, n = np.concatenate(terms), np.concatenate(counts)
    by = np.argsort(whole, kind="stable")
    whole, n = whole[by], n[by]
    first = np.flatnonzero(np.append(True, whole[1:] != whole[:-1])) if len(whole) else np.empty(0, np.int64)
    return whole[first], np.add.reduceat(n, first) if len(first) else n


def _document_counts(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct term hashes, the documents that have each, and a word that is one."""
    doc = np.repeat(np.arange(len(words.first) - 1), words.counts())
    by = np.argsort(words.hash, kind="stable")  # documents ascend within a term
    h, d = words.hash[by], doc[by]
    term = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    pair = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])).astype(np.int64) if len(h) else np.empty(0, np.int64)
    return h[term], np.add.reduceat(pair, term) if len(term) else pair, by[term]


def _candidates(docs: DataFrame, n: int, least: int, loss: float, most: int) -> np.ndarray:
    """Hashes of all terms that at least `least` documents may have, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, held, rows = [], [], 0, 0

        def out() -> pa.RecordBatch:
            t, c = _merged(terms, counts) if terms else (np.empty(0, U64), np.empty(0, np.int64))
            often = c >= loss * rows
            return pa.RecordBatch.from_arrays([pa.array(t[often].view(np.int64)), pa.array(c[often].astype(np.int64))], names=["term", "n"])

        for batch in batches:
            for a, b, raw, offsets in string_chunks(batch.column("text")):
                t, c, _ = _document_counts(Words(raw, offsets, lower=True))
                terms.append(t)
                counts.append(c)
                held, rows = held + len(t), rows + b - a
                if held > 2 * most:
                    t, c = _merged(terms, counts)
                    terms, counts, held = [t], [c], len(t)
                    if held > most:
                        yield out()
                        terms, counts, held, rows = [], [], 0, 0
        yield out()

    counted = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    with cleaned(docs.sparkSession):
        found = counted.where(F.col("n") > least - loss * n).select("term").toPandas()
    return np.sort(found["term"].to_numpy(dtype=np.int64).view(U64))


def lexicon(docs: DataFrame, idf_low: float = IDF_LOW, idf_high: float = IDF_HIGH, held: int = HELD) -> list[str]:
    """The terms of the band, sorted.  Counts are exact and cover all documents."""
    spark, n = docs.sparkSession, docs.count()
    least = max(2, math.ceil(n * math.exp(-idf_high)))  # for few documents the band would end below one document
    wanted = spark.sparkContext.broadcast(_candidates(docs, n, least, LOSS * math.exp(-idf_high), held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = wanted.value
        total, names = np.zeros(len(order), dtype=np.int64), np.full(len(order), None, dtype=object)
        for batch in batches if len(order) else ():
            for _, _, raw, offsets in string_chunks(batch.column("text")):
                words = Words(raw, offsets, lower=True)
                t, c, at = _document_counts(words)
                place = np.minimum(np.searchsorted(order, t), len(order) - 1)
                hit = order[place] == t
                total[place[hit]] += c[hit]
                for p, w in zip(place[hit].tolist(), at[hit].tolist()):
                    if names[p] is None:
                        names[p] = raw[words.start[w] : words.end[w]].tobytes().lower().decode()
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(names[have].tolist(), pa.string()), pa.array(total[have])], names=["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
    with cleaned(spark):
        return sorted(r[0] for r in counted.where((F.col("df") >= least) & (F.col("df") <= n * math.exp(-idf_low))).select("term").collect())


class Fingerprinter:
    def __init__(self, terms: list[str], subsets: int, keep: float):
        """Each term with the subsets that keep it."""
        most, self.subsets, self.where = int(keep * 2**32), subsets, {}
        for t in terms:
            raw = t.encode()
            self.where[raw] = [k for k in range(subsets) if xxhash.xxh32_intdigest(raw, seed=k) < most >> k % 4]

    def parts(self, text: str) -> list[bytes | None]:
        """One hash for each subset (None: no term of it), or a single one where no term is in the lexicon."""
        words = sorted(set(text.encode().lower().split()))
        held: list[list[bytes]] = [[] for _ in range(self.subsets)]
        known = 0
        for w in words:
            ks = self.where.get(w)
            if ks is not None:
                known += 1
                for k in ks:
                    held[k].append(w)
        if not any(held):
            return [hashlib.blake2b(b" ".join(words), digest_size=16).digest()]
        return [xxhash.xxh32_digest(b" ".join(h))[:2] if h else None for h in held]


def written(parts: list[bytes | None]) -> str:
    return "".join(p.hex() if p is not None else "-" * 4 for p in parts) if len(parts) > 1 else "=" + (parts[0] or b"").hex()


def likeness(a: list[bytes | None], b: list[bytes | None]) -> float:
    if len(a) != len(b):
        return 0.0
    both = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    return sum(x == y for x, y in both) / len(both) if both else 1.0


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(fp: Fingerprinter, doc: int | None, text: str, mine: list, nxt: str, theirs: list) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + nxt[:half]
    parts = fp.parts(edited)
    return doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(mine), written(parts), likeness(mine, parts), likeness(mine, theirs)


_made: dict[str, Fingerprinter] = {}


def _tool(key: str, terms, subsets: int, keep: float) -> Fingerprinter:
    """The fingerprinter of a lexicon, made once in each worker."""
    if key not in _made:
        _made.clear()
        _made[key] = Fingerprinter(terms.value, subsets, keep)
    return _made[key]


def _ranges(docs: DataFrame) -> tuple[np.ndarray, bool]:
    """First doc_id of each range of documents, in order, and whether there are null ids (they are in the first range).  One number for each range."""
    number = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id").repartitionByRange(number, F.col("doc_id").asc_nulls_first())
    with cleaned(docs.sparkSession):
        found = ids.groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect()
    return np.array(sorted(r["first"] for r in found if r["first"] is not None), dtype=np.int64), any(r["nulls"] for r in found)


def _dealt(docs: DataFrame) -> DataFrame:
    """part, guest, doc_id, text by ranges, sorted: a range's own documents, then its guest (of guests with one doc_id the first counts)."""
    starts, nulls = _ranges(docs)
    parts = max(len(starts), 1)
    edges = docs.sparkSession.sparkContext.broadcast(starts)

    @F.pandas_udf("int")
    def placed(ids: pd.Series) -> pd.Series:
        """Twice the range of an id, and one more where it begins the range."""
        none, first = ids.isna().to_numpy(), edges.value
        own = ids.fillna(0).to_numpy(dtype=np.int64)
        at = np.where(none, 0, np.maximum(np.searchsorted(first, own, side="right") - 1, 0))
        begins = none if not len(first) else np.where(none | ((at == 0) & nulls), none, first[at] == own)
        return pd.Series(2 * at + begins, dtype="int32")

    own = (F.col("_at") / 2).cast("int")
    before = F.pmod(own - 1, F.lit(parts))
    place = lambda part, guest: F.struct(part.cast("int").alias("part"), F.lit(guest).alias("guest"))
    both = F.when(F.col("_at") % 2 == 1, F.array(place(own, 0), place(before, 1))).otherwise(F.array(place(own, 0)))
    dealt = docs.withColumn("_at", placed("doc_id")).select(F.explode(both).alias("_p"), "doc_id", "text").select("_p.part", "_p.guest", "doc_id", "text")
    return dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame, idf_low: float = IDF_LOW, idf_high: float = IDF_HIGH, subsets: int = SUBSETS, keep: float = KEEP) -> DataFrame:
    """ROW for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = needed(docs, doc_id="long", text="string").fillna("", ["text"])
    terms, key = spark.sparkContext.broadcast(lexicon(docs, idf_low, idf_high)), uuid.uuid4().hex
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [x.split()[0] for x in ROW.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, last, rows = _tool(key, terms, subsets, keep), None, []
        for batch in batches:
            for part, guest, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))):
                if guest and last is None:  # a guest with the doc_id of one that came before
                    continue
                mine = fp.parts(text)
                if last is not None:
                    rows.append(_row(fp, *last, text, mine))
                last = None if guest else (doc, text, mine)
                if len(rows) >= 1000:
                    yield batch_of(rows)
                    rows = []
        yield batch_of(rows)

    return _dealt(docs).mapInArrow(run, ROW)


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
