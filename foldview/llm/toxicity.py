"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of 4 to 6 characters (code points; A-Z lower-cased, white space as a blank) that occur in
a text, not how often.  On a bounded sample of labelled texts (MAX_POSITIVE and MAX_NEGATIVE rows, by hash of doc_id; both
are parameters) the classes' document counts give each feature's log-count ratio r; the KEPT features with the
strongest evidence stay, and a logistic regression is fitted on x * r.  Both classes are counted over all labels
outside the held-out fold, and the bias is corrected by what the sample's odds are off from theirs, so a score means
the same whether the sample is bounded or not.  The model is KEPT numbers, so it is
broadcast; scoring is one pass over whole texts with no shuffle.

Only text is an input of a score.  Defined results: a null or empty text has the score of the bias alone;
repeated rows score alike; very long texts are scored whole, in steps that keep a text together; labels given twice count as toxic if one says so; labels other than 0 and 1 are left
out; without labels of both classes every score is the base rate (0 without labels); an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, U64, discard, needed, settled, splitmix, string_chunks, table

GRAMS = (4, 5, 6)
BITS = 20
KEPT = 4_000
MAX_POSITIVE, MAX_NEGATIVE = 5_000, 8_000
CUT = 0.3


def characters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, A-Z lower-cased and white space as a blank, and where each document begins among them."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    first = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[offsets]
    small = points < 256
    low = points.astype(np.int64)
    low[small] = _FOLDED[points[small]]
    return low, first


_FOLDED = _LOWER.astype(np.int64)
_FOLDED[_SPACE] = 32


def gram_slots(points: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slot of each n-gram, character it starts at) for each n; n-grams that cross from one document to the next are left out."""
    n = len(points)
    border = np.zeros(n + 1, dtype=bool)
    border[first[1:-1]] = True
    with np.errstate(over="ignore"):
        codes = splitmix(points.astype(U64) * U64(0xA24BAED4963EE407) + U64(1))
        h, cross = codes, np.zeros(n, dtype=bool)
        for k in range(2, max(GRAMS) + 1):
            if n < k:
                return
            h = h[: n - k + 1] * U64(0x9E3779B97F4A7C15) + codes[k - 1 :]
            cross = cross[: n - k + 1] | border[k - 1 : n]
            if k in GRAMS:
                ok = np.flatnonzero(~cross)
                yield (((h ^ U64(k)) * U64(0xBF58476D1CE4E5B9)) >> U64(64 - BITS)).astype(np.int32)[ok], ok


def document_slots(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, slot) pairs, of the wanted slots only if given (a boolean for each slot)."""
    keys = [np.empty(0, np.int64)]
    points, first = characters(raw, offsets)
    for slots, at in gram_slots(points, first):
        if wanted is not None:
            hit = wanted[slots]
            slots, at = slots[hit], at[hit]
        doc = np.searchsorted(first, at, side="right") - 1
        keys.append(np.unique((doc.astype(np.int64) << BITS) | slots))
    key = np.unique(np.concatenate(keys))
    return key >> BITS, key & ((1 << BITS) - 1)


def log_count_ratios(positive: np.ndarray, negative: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    return np.log((positive + 1.0) / (n_pos + 2.0)) - np.log((negative + 1.0) / (n_neg + 2.0))


def choose(positive: np.ndarray, negative: np.ndarray, n_pos: int, n_neg: int, kept: int = KEPT) -> np.ndarray:
    """Slots with the strongest evidence, |r| times the root of the documents that have it; in ascending order."""
    r, seen = log_count_ratios(positive, negative, n_pos, n_neg), positive + negative
    strength = np.where(seen >= 5, np.abs(r) * np.sqrt(seen), 0)
    best = np.argsort(-strength, kind="stable")[:kept]
    return np.sort(best[strength[best] > 0])


def fit(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, r: np.ndarray, rounds: int = 300, l2: float = 4e-3) -> tuple[np.ndarray, float]:
    """Weights (already times r) and bias of a logistic regression on binary features scaled by r."""
    n, k = len(y), len(r)
    x = r[columns]
    w, b = np.zeros(k), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, x * w[columns], n) + b, -30, 30)))
        e = (p - y) / n
        g, gb = np.bincount(columns, x * e[rows], k) + l2 * w, e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.02 * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= 0.02 * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return w * r, b


def prior_shift(sampled: tuple[int, int], whole: tuple[int, int] | None) -> float:
    """What the log-odds of a sample (other, toxic) are above those of all documents; 0 where a class is missing."""
    if whole is None or not all((*sampled, *whole)):
        return 0.0
    return float(np.log(sampled[1] / sampled[0]) - np.log(whole[1] / whole[0]))


def train(sample: DataFrame, kept: int = KEPT, whole_counts: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, their weights and the bias, from a bounded sample (text, toxic); whole_counts are the classes' rows (other, toxic) that it stands for."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), dtype=np.int32)
        docs = np.zeros(2, dtype=np.int64)
        for batch in batches:
            y = batch.column("toxic").to_numpy(zero_copy_only=False).astype(int)
            docs += np.bincount(y, minlength=2)
            for a, b, raw, offsets in string_chunks(batch.column("text"), 1 << 19):
                doc, slot = document_slots(raw, offsets)
                for c in (0, 1):
                    seen[c] += np.bincount(slot[y[a:b][doc] == c], minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(seen[0][some], docs[0]), pa.int64()), pa.array(np.append(seen[1][some], docs[1]), pa.int64())], names=["slot", "neg", "pos"])

    totals = sample.select("text", "toxic").mapInArrow(count, "slot int, neg long, pos long").groupBy("slot").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).where("slot < 0 or neg + pos >= 5").toPandas()  # at most 2 ** BITS rows
    whole = totals[totals.slot < 0]
    n_neg, n_pos = (int(whole[c].sum()) if len(whole) else 0 for c in ("neg", "pos"))
    if not n_neg or not n_pos:
        rate = n_pos / max(n_pos + n_neg, 1)
        return np.empty(0, np.int64), np.empty(0), float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))
    positive, negative = np.zeros(1 << BITS), np.zeros(1 << BITS)
    own = totals[totals.slot >= 0]
    positive[own.slot], negative[own.slot] = own.pos, own.neg
    slots = choose(positive, negative, n_pos, n_neg, kept)
    r = log_count_ratios(positive, negative, n_pos, n_neg)[slots]
    wanted = np.zeros(1 << BITS, dtype=bool)
    wanted[slots] = True

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("toxic").to_numpy(zero_copy_only=False)
            for a, b, raw, offsets in string_chunks(batch.column("text")):
                doc, slot = document_slots(raw, offsets, wanted)
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                packed = np.searchsorted(slots, slot).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array(y[a:b], pa.int32()), pa.array([packed[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], names=["toxic", "slots"])

    marked = sample.select("text", "toxic").mapInArrow(mark, "toxic int, slots binary").toPandas()
    columns = np.frombuffer(b"".join(bytes(x) for x in marked.slots), "<u4").astype(np.int64)
    rows = np.repeat(np.arange(len(marked)), [len(x) // 4 for x in marked.slots])
    order = np.lexsort((rows, marked.toxic.to_numpy()[rows])) if len(rows) else rows
    w, b = fit(rows[order], columns[order], marked.toxic.to_numpy(dtype=float), r)
    return slots, w, b - prior_shift((n_neg, n_pos), whole_counts)


def score(docs: DataFrame, slots: np.ndarray, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, held_out, score for each row of docs (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast((slots, weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, bias = model.value
        wanted, value = np.zeros(1 << BITS, dtype=bool), np.zeros(1 << BITS)
        wanted[slots], value[slots] = True, weights
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            for a, b, raw, offsets in string_chunks(batch.column("text")):
                doc, slot = document_slots(raw, offsets, wanted)
                total[a:b] += np.bincount(doc, value[slot], b - a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], names=["doc_id", "score"])

    return needed(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """_id, toxic of the labelled documents outside the held-out fold."""
    labels = needed(labels, doc_id="long", toxic="int").withColumnRenamed("doc_id", "_id").where("toxic in (0, 1)").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    return labels.where(F.col("_id").isNotNull() & ~held_out(F.col("_id")))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """_id, toxic of each row of docs that has a learnable label."""
    return needed(docs, doc_id="long").withColumnRenamed("doc_id", "_doc").join(learnable(labels), F.col("_doc") == F.col("_id")).select("_id", "toxic")


def class_counts(marks: DataFrame) -> tuple[int, int]:
    """Rows (other, toxic) of marks."""
    found = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    return found.get(0, 0), found.get(1, 0)


def sample_of(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> DataFrame:
    """text, toxic of at most max_positive and max_negative labelled documents outside the held-out fold."""
    labels = learnable(labels)
    by_hash = lambda c, n: labels.where(F.col("toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(n)
    chosen = by_hash(1, max_positive).unionByName(by_hash(0, max_negative))
    return needed(docs, doc_id="long", text="string").withColumnRenamed("doc_id", "_doc").join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_doc", "text", "toxic")


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> DataFrame:
    sample = settled(docs.sparkSession, sample_of(docs, labels, max_positive, max_negative), "toxicity-sample")
    model = train(sample, whole_counts=class_counts(labelled(docs, labels)))
    discard(docs.sparkSession, sample)
    scored = score(docs, *model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
