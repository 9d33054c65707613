"""Substring dedup over windows of `window` consecutive words, by super-k-mer partitioning.

Every window has a minimiser, the smallest hash of its `gram`-word runs.  Consecutive windows that share one are a
super-k-mer and travel as one packed string (their words, joined by one space) to the minimiser's bucket; there all
windows are sorted, and a window is marked where its word sequence also starts in a document with a smaller doc_id.

What keeps the shuffles small, without leaving a case out:
  * documents with one and the same word sequence are one class; only the smallest doc_id goes on, and of the
    others every word is covered when there is a window at all;
  * minimisers met in one document only cannot mark anything and do not travel: minimisers are counted first, as
    numbers, and only documents with a shared one are read again;
  * a packed string that its task has sent before for a smaller doc_id is marked on the spot.
The windows of a minimiser with more than `most` strings have a second one, the smallest hash of longer runs (`finer`), and
travel as the shorter strings that share both.  Near copies that differ by a word mostly part there, so a window that only one
of them has meets few others.  Of both together, what still has more than `most` strings has several buckets, and a string goes
to one of them by its document and place.  Each bucket is sorted as any other; of the windows that it leaves unmarked, the hash, document and place go on,
and the smallest document of a window over all its buckets is found by that hash.  So strings travel once,
and no task gathers a minimiser, or a window, that a large part of all documents share.

Windows are compared by 128 bits of hash over 64-bit word hashes.  Defined results: null text counts as empty; texts
below one window lose nothing; windows that repeat inside one document, or in rows of equal doc_id, do not mark each
other; rows with a null doc_id neither mark nor lose anything; repeated rows are each marked alike; very long texts are
cut whole, their strings travelling apart; an empty table gives an empty table; extra columns are ignored by `removed` and kept by `without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _R, _R_INV, U64, Words, _power, discard, needed, numbered, settled, splitmix, string_chunks, table, with_texts

WINDOW, GRAM, MOST_STRINGS = 50, 8, 256
MOST = U64(0xFFFFFFFFFFFFFFFF)


def window_hashes(words: Words, k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the k words from each word on (of no meaning where a document ends before)."""
    with np.errstate(over="ignore"):
        h = splitmix(words.hash ^ U64(seed))
        n = len(h)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(h * _power(_R, n), out=total[1:])
        ends = np.minimum(np.arange(n) + k, n)
        return splitmix((total[ends] - total[:-1]) * _power(_R_INV, n))


def valid_starts(words: Words, k: int) -> np.ndarray:
    """Word indexes at which a window of k words begins that stays inside its document."""
    n = len(words.hash)
    ends = np.repeat(words.first[1:], words.counts())
    return np.flatnonzero(np.arange(n) + k <= ends)


def finer(window: int, gram: int) -> int:
    """Words in a run of the second minimiser: a word that differs is in two thirds of the runs of a window that has it."""
    return max(gram, window - window // 3)


def minimisers(words: Words, window: int, gram: int, seed: int = 0x51ED) -> tuple[np.ndarray, np.ndarray]:
    """(start, minimiser) of each valid window."""
    starts = valid_starts(words, window)
    if not len(starts):
        return starts, np.empty(0, U64)
    h, width = window_hashes(words, gram, seed), window - gram + 1
    # minimum over `width` neighbours by doubling; a valid window's grams all lie inside its document
    span, low = 1, h
    while span * 2 <= width:
        low = np.minimum(low, np.append(low[span:], np.full(min(span, len(low)), MOST)))
        span *= 2
    rest = width - span
    if rest:
        low = np.minimum(low, np.append(low[rest:], np.full(min(rest, len(low)), MOST))[: len(low)])
    return starts, low[starts]


def runs_of(starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of consecutive starts with one key."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(starts)))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h (tells rows of equal doc_id apart), text."""
    return needed(docs, doc_id="long", text="string").fillna("", ["text"]).select("doc_id", F.xxhash64("text").alias("h"), "text")


def _sequences(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, h, n, s1, s2 (hash of the word sequence), the distinct minimisers of each document and the runs of windows that each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in string_chunks(batch.column("text")):
                words = Words(raw, offsets)
                n = words.counts()
                sums = []
                with np.errstate(over="ignore"):
                    for seed in (0x1B, 0x2F):
                        h = splitmix(words.hash ^ U64(seed)) * _power(_R, len(words.hash))
                        total = np.append(U64(0), np.cumsum(h, dtype=U64))
                        sums.append(splitmix((total[words.first[1:]] - total[words.first[:-1]]) * _power(_R_INV, len(words.hash) + 1)[words.first[:-1]]).view(np.int64))
                starts, low = minimisers(words, window, gram)
                first, _ = runs_of(starts, low)
                doc = np.searchsorted(words.first, starts[first], side="right") - 1
                owner, value = doc, low[first].view(np.int64)
                by = np.lexsort((value, owner))
                owner, value = owner[by], value[by]
                own = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]))) if len(owner) else np.empty(0, np.int64)
                count = np.diff(np.append(own, len(owner))).astype(np.int32)
                cuts = pa.array(np.searchsorted(owner[own], np.arange(b - a + 1)).astype(np.int32))
                lists, counts = pa.ListArray.from_arrays(cuts, pa.array(value[own])), pa.ListArray.from_arrays(cuts, pa.array(count))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), lists, counts], names=["doc_id", "h", "n", "s1", "s2", "ms", "cs"])

    return docs.mapInArrow(run, "doc_id long, h long, n long, s1 long, s2 long, ms array<long>, cs array<int>")


SENT = "m long, salt int, doc_id long, h long, start long, n long, packed binary"


def _super_kmers(flagged: DataFrame, window: int, gram: int) -> DataFrame:
    """SENT rows of documents (doc_id, h, text, ms, salts): packed strings, or null where the whole run is marked already.

    Where a minimiser has several salts, m is of both minimisers, and salt 1 (otherwise 0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        for batch in batches:
            ids, hs = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()
            ms, salts = batch.column("ms").to_pylist(), batch.column("salts").to_pylist()
            for a, b, raw, offsets in string_chunks(batch.column("text")):
                words, rows = Words(raw, offsets), []
                starts, low = minimisers(words, window, gram)
                both = low
                if any(x > 1 for own in salts[a:b] for x in own):
                    with np.errstate(over="ignore"):
                        both = splitmix(low ^ splitmix(minimisers(words, window, finer(window, gram), 0x3C6F)[1])).view(np.int64)
                low = low.view(np.int64)
                doc = np.searchsorted(words.first, starts, side="right") - 1
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                for d in range(b - a):
                    lo, hi = cuts[d], cuts[d + 1]
                    if lo == hi:
                        continue
                    wanted = dict(zip(ms[a + d], salts[a + d]))
                    key = low[lo:hi]
                    order = np.array(sorted(wanted), dtype=np.int64)
                    at = np.minimum(np.searchsorted(order, key), len(order) - 1)
                    good = np.flatnonzero(order[at] == key)
                    split = np.array([wanted[m] > 1 for m in order.tolist()])[at][good]
                    key, where = np.where(split, both[lo:hi][good].view(np.int64), key[good]), starts[lo:hi][good]
                    first, count = runs_of(where, key)
                    tokens = raw[offsets[d] : offsets[d + 1]].tobytes().split()
                    base = int(words.first[d])
                    for f, c in zip(first.tolist(), count.tolist()):
                        s = int(where[f]) - base
                        packed = b" ".join(tokens[s : s + c + window - 1])
                        mark = hashlib.blake2b(packed, digest_size=16).digest()
                        before = sent.get(mark)
                        if before is not None and before < ids[a + d]:
                            packed = None
                        else:
                            if len(sent) > 300_000:
                                sent.clear()
                            sent[mark] = ids[a + d]
                        rows.append((int(key[f]), int(split[f]), ids[a + d], hs[a + d], s, c, packed))
                cols = list(zip(*rows)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=[x.split()[0] for x in SENT.split(", ")])

    return flagged.mapInArrow(run, SENT)


def _mark_block(doc: np.ndarray, packed: list[bytes], window: int, split: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(string, first window, windows) runs of marked windows of whole buckets: sort all windows, compare each with the first of its kind.

    And (string, window, hash, hash) of the windows that are left over of strings whose minimiser is split.
    """
    offsets = np.append(0, np.cumsum([len(p) for p in packed]))
    words = Words(np.frombuffer(b"".join(packed), np.uint8), offsets)
    starts = valid_starts(words, window)
    owner = np.searchsorted(words.first, starts, side="right") - 1
    h1, h2, ids = window_hashes(words, window, 0x77)[starts], window_hashes(words, window, 0x88)[starts], doc[owner]
    order = np.lexsort((ids, h2, h1))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    smallest = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    marked = np.zeros(len(order), dtype=bool)
    marked[order] = smallest < ids[order]
    at = np.flatnonzero(marked)
    first, count = runs_of(starts[at], owner[at])
    left = np.flatnonzero(~marked & split[owner])
    return (owner[at][first], starts[at][first] - words.first[owner[at][first]], count), (owner[left], starts[left] - words.first[owner[left]], h1[left], h2[left])


#: runs of marked windows (k1 and k2 are null), and single windows that may be marked by another bucket of their minimiser
FOUND = "doc_id long, h long, start long, n long, k1 long, k2 long"


def _buckets(sent: DataFrame, window: int, block: int = 4 << 20) -> DataFrame:
    """FOUND from packed strings that are sorted by bucket within their partition; a bucket of a split minimiser is worked off in blocks."""

    def out(doc: list, h: list, start: list, packed: list, salts: list) -> pa.RecordBatch:
        (owner, at, count), (other, place, h1, h2) = _mark_block(np.array(doc, dtype=np.int64), packed, window, np.array(salts) > 0)
        pick = lambda x: np.array(x, dtype=np.int64)[np.append(owner, other)]
        null = pa.nulls(len(owner), pa.int64())
        hashes = [pa.concat_arrays([null, pa.array(k.view(np.int64))]) for k in (h1, h2)]
        n = np.append(count, np.ones(len(other), np.int64)).astype(np.int64)
        return pa.RecordBatch.from_arrays([*map(pa.array, (pick(doc), pick(h), pick(start) + np.append(at, place), n)), *hashes], names=["doc_id", "h", "start", "n", "k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [])
        size, last = 0, None
        for batch in batches:
            keys = list(zip(batch.column("m").to_pylist(), batch.column("salt").to_pylist()))
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "h", "start", "packed", "salt")]
            for key, *row in zip(keys, *cols):
                if size > block and (key != last or key[1]):  # what blocks of one bucket leave meets as that of several buckets does
                    yield out(*held)
                    held, size = ([], [], [], [], []), 0
                last = key
                for x, v in zip(held, row):
                    x.append(v)
                size += len(row[3])
        if held[0]:
            yield out(*held)

    return sent.repartition("m", "salt").sortWithinPartitions("m", "salt").mapInArrow(run, FOUND)


def _salted(sent: DataFrame, most: int) -> DataFrame:
    """SENT rows that have strings, dealt to several buckets (salts from 1) where one would have more than `most` of them."""
    strings = sent.where("packed is not null")
    # at most one row for `most` strings
    many = strings.where("salt > 0").groupBy("m").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts")).where("parts > 1")
    # by document, version and place, so that strings of one document are dealt out too
    salt = F.when(F.col("parts").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("doc_id", "h", "start"), F.col("parts"))).cast("int")
    return strings.join(F.broadcast(many), "m", "left").withColumn("salt", salt).drop("parts")


def marks(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST_STRINGS) -> DataFrame:
    """doc_id, h and an array of (start, n) runs of marked windows, for documents that have any; n = -1: all windows."""
    spark = docs.sparkSession
    keyed = _keyed(docs).where("doc_id is not null")
    seen = settled(spark, _sequences(keyed, window, gram).where(F.col("n") >= window), "sequences")
    classes = seen.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "h"))["h"].alias("rep_h"), F.first(F.arrays_zip("ms", "cs")).alias("ms"))
    # the classes' minimisers are counted and joined back: read once, used twice
    entries = settled(spark, classes.select(F.col("rep").alias("doc_id"), F.col("rep_h").alias("h"), F.explode("ms").alias("x")).select("doc_id", "h", F.col("x.ms").alias("m"), F.col("x.cs").alias("c")), "minimisers")
    shared = entries.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("c").alias("c")).where("lo < hi")
    shared = shared.select("m", F.ceil(F.col("c") / most).cast("int").alias("salts"))
    flags = entries.join(shared, "m").groupBy("doc_id", "h").agg(F.collect_list(F.struct("m", "salts")).alias("x"))
    flags = flags.select("doc_id", "h", F.col("x.m").alias("ms"), F.col("x.salts").alias("salts"))
    sent = settled(spark, _super_kmers(keyed.join(flags, ["doc_id", "h"]), window, gram), "super-kmers")
    discard(spark, entries)
    at_once = sent.where("packed is null").select("doc_id", "h", "start", "n", F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"))
    found = settled(spark, at_once.unionByName(_buckets(_salted(sent, most), window)), "marked")
    discard(spark, sent)
    # of a split bucket's windows each bucket names those of its smallest document: at most one a bucket, and rows of one document
    least = F.min("doc_id").over(Window.partitionBy("k1", "k2"))
    across = found.where("k1 is not null").withColumn("least", least).where("least < doc_id").select("doc_id", "h", "start", "n")
    reps = seen.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").select("s1", "s2", "rep")
    copies = seen.join(reps, ["s1", "s2"]).where("doc_id > rep").select("doc_id", "h", F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("n"))
    whole = found.where("k1 is null").select("doc_id", "h", "start", "n").unionByName(across).unionByName(copies)
    return whole.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n")).alias("marks"))


def _gone(n_words: int, runs: list[dict] | None, window: int) -> np.ndarray:
    """Which words marked windows cover."""
    step = np.zeros(n_words + 1, dtype=np.int64)
    for r in runs or ():
        if r["n"] < 0:
            return np.ones(n_words, dtype=bool)
        step[r["start"]] += 1
        step[min(r["start"] + r["n"] + window - 1, n_words)] -= 1
    return np.cumsum(step[:-1]) > 0


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST_STRINGS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs (doc_id, text)."""
    found = marks(docs, window, gram, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts, runs = batch.column("text"), batch.column("marks")
            for i in range(batch.num_rows):
                words = texts[i].as_py().encode().split()
                gone = _gone(len(words), runs[i].as_py(), window) if runs[i].is_valid else None
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _keyed(docs).join(found, ["doc_id", "h"], "left").select("doc_id", "text", "marks").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST_STRINGS) -> DataFrame:
    """docs without the covered words; white space between words that stay is kept; n_chars, where there is one, follows."""
    import re

    found = marks(docs, window, gram, most).withColumnRenamed("doc_id", "d")
    plain, doc, text = numbered(docs), *(f"_{docs.columns.index(c)}" for c in ("doc_id", "text"))
    key = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    joined = plain.join(found, (F.col(doc).cast("long") == F.col("d")) & (key == F.col("h")), "left").select(*plain.columns, "marks")
    at, solid = docs.columns.index("text"), re.compile(r"[^\x20\x09-\x0D]+")

    def cut(text: str, runs: list[dict]) -> str:
        spans = [m.span() for m in solid.finditer(text)]
        gone = _gone(len(spans), runs, window)
        out, keep = [], np.flatnonzero(~gone).tolist()
        for k, i in enumerate(keep):
            follows = k + 1 < len(keep) and keep[k + 1] == i + 1
            out.append(text[spans[i][0] : spans[i + 1][0] if follows else spans[i][1]])
            if not follows and k + 1 < len(keep):
                out.append(" ")
        return "".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column(at), batch.column(batch.num_columns - 1)
            new = pa.array([cut(texts[i].as_py(), runs[i].as_py()) if runs[i].is_valid and texts[i].is_valid else texts[i].as_py() for i in range(batch.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], new, *batch.columns[at + 1 : -1]], names=batch.schema.names[:-1])

    return with_texts(docs, joined.mapInArrow(run, plain.schema))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))


def oracle_sql(window: int = WINDOW) -> str:
    """The same by comparing every window's words."""
    return f"""
with t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from documents),
w as (select doc_id, unnest(range(1, len(words) - {window - 2})) as i, words from t where len(words) >= {window}),
k as (select doc_id, i, sha256(array_to_string(words[i : i + {window - 1}], ' ')) as s from w),
m as (select doc_id, i, min(doc_id) over (partition by s) < doc_id as marked from k),
g as (select distinct doc_id, unnest(range(i, i + {window})) as p from m where marked),
a as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from t),
r as (select a.doc_id, count(g.p)::bigint as n_removed, coalesce(string_agg(case when g.p is null then word end, ' ' order by a.p), '') as kept from a left join g on a.doc_id = g.doc_id and a.p = g.p group by a.doc_id)
select t.doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from t left join r on t.doc_id = r.doc_id"""
