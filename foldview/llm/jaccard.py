"""N-gram Jaccard join by multiple-global-order filtering.

A document's set is its distinct `k`-word shingles (A-Z lower-cased).  Two sets with Jaccard likeness of at least
`percent` share a token in their prefixes under *every* global token order: the first n - ceil(percent n / 100) + 1
tokens.  The orders put rare tokens first, by class of document frequency, and differ in a seeded hash within a class.

Frequencies are counted over all documents: tokens travel once, packed by range, to be counted, and those that more
than one document has come back to their documents.  A token of one document only fills its prefix but meets nobody,
and it cannot be in an intersection, so prefixes, filters and the final comparison need the others alone; most
documents then have nothing left to compare.  Shingles of very many documents (see `heavy_shingles`) are known
beforehand and stay out of that shuffle, so none gathers its documents in one task.

Candidates meet by a prefix token of the first order; sizes and the prefixes under the other orders, 24 bits a token,
are intersected with that before whole sets are fetched and compared.

Copies: documents with one set are one class, and only its smallest doc_id goes on.  Groups of near copies: within a
token's bucket every member is compared with the smallest member first; components of those links are formed, and
then only members of *different* components that share a token are compared, so a group costs its size, not its
square, and no link between components is lost: pairs from small buckets, and from large ones the few that stand
outside the main component against blocks of all members.  Large buckets are split by a salt while they are filtered
and where they are joined.  The links themselves are counted, or listed, component by component in the same blocks:
every link is inside one, and no pairs are made but those that link.

Defined results: null and empty texts have an empty set and are linked with nothing; fewer than k words give the
whole sequence as the one shingle; rows of equal doc_id are one document with all their links, each row with its own
size; a row with a null doc_id is linked with nothing; very long texts are compared whole; an empty table gives an empty table; extra columns are
ignored by `linked` and kept by `one_of_each`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Words, discard, numbered, settled, splitmix, string_chunks, table
from .components import components
from .substring import _keyed

K, PERCENT = 5, 80
ORDERS = 3
HEAVY, SHARE, HEAVY_MOST, BUCKET = 32, 0.002, 1 << 17, 1_000
FEW = 20_000
SMALL, BLOCK, BLOCK_BYTES = 64, 2_000, 4 << 20
#: rows of one token that go to one task where tokens are joined
JOINED = 1_000
#: of a 64-bit shingle hash, 46 bits travel
CUT = U64(18)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    words = Words(raw, offsets, lower=True)
    grams, at = words.grams(k)
    cuts = np.searchsorted(at, words.first)
    out = []
    for d, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if a < b:
            out.append(np.unique(grams[a:b]))
        else:
            own = words.hash[words.first[d] : words.first[d + 1]]
            if len(own):
                with np.errstate(over="ignore"):
                    h = U64(len(own)) * U64(0xC2B2AE3D27D4EB4F)
                    for w in own:
                        h = splitmix(np.array([h ^ w]))[0]
                out.append(np.array([h], dtype=U64))
            else:
                out.append(np.empty(0, U64))
    return out


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def ranks(tokens: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Places in a global order: class of frequency first, then a seeded hash.  A rank is its token's name from then on."""
    return splitmix(tokens ^ U64(0x9D5C + 7919 * order)) >> U64(6) | classes.astype(U64) << U64(58)


def prefix(tokens: np.ndarray, classes: np.ndarray, n: int, percent: int, order: int) -> np.ndarray:
    """The ranks of a prefix that other documents can share: the n - len(tokens) tokens of this document alone come first."""
    size = prefix_size(n, percent) - (n - len(tokens))
    if size <= 0:
        return np.empty(0, U64)
    r = ranks(tokens, classes, order)
    return np.partition(r, size - 1)[:size] if size < len(r) else r


def class_of(counts: np.ndarray) -> np.ndarray:
    """0 for one document, else 1 and more by powers of two."""
    return np.where(counts > 1, np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 0).clip(0, 62).astype(np.uint8)


class Heavy:
    """The shingles of very many documents, with their classes."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(tokens)
        self.tokens, self.classes = tokens[by], class_of(counts[by])
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.tokens >> U64(42)).astype(np.int64)] = True

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of heavy tokens, and their index in the list."""
        hit = np.flatnonzero(self.maybe[(tokens >> U64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.tokens, tokens[hit]), max(len(self.tokens) - 1, 0))
        same = self.tokens[at] == tokens[hit] if len(self.tokens) else np.zeros(len(hit), dtype=bool)
        return hit[same], at[same]


def heavy_shingles(keyed: DataFrame, k: int, most: int = HEAVY_MOST) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many documents and their counts: at most `most`, the largest.

    Lossy counting over all documents: each Arrow batch passes on what at least SHARE of its documents have (and
    two of them), so whatever that share of all documents has is found, and what goes on is bounded by the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, _, raw, offsets in string_chunks(batch.column("text")) for s in shingle_sets(raw, offsets, k)]
            token, count = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, U64), np.empty(0, np.int64))
            kept = count >= max(2, int(SHARE * batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(token[kept].view(np.int64)), pa.array(count[kept].astype(np.int64))], names=["token", "c"])

    counted = keyed.select("text").mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= HEAVY)
    rows = counted.orderBy(F.desc("c"), "token").limit(most).toPandas()
    return rows["token"].to_numpy(dtype=np.int64).view(U64), rows["c"].to_numpy(dtype=np.int64)


PACKED = "bucket int, part int, batch int, tokens binary, docs binary, classes binary"


def _packed(keyed: DataFrame, k: int, heavy, bits: int) -> DataFrame:
    """PACKED rows of each Arrow batch: its tokens by range of hash, and with bucket -1 what its documents are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, number = heavy.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [s for _, _, raw, offsets in string_chunks(batch.column("text")) for s in shingle_sets(raw, offsets, k)]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            tokens, doc = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
            ends = np.cumsum(sizes)
            with np.errstate(over="ignore"):
                sums = [np.append(U64(0), np.cumsum(splitmix(tokens ^ U64(x)), dtype=U64)) for x in (0x3C, 0x5A)]
                s1, s2 = ((x[ends] - x[ends - sizes]).view(np.int64).tolist() for x in sums)
            hit, at = known.find(tokens)
            info = pickle.dumps((batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), sizes.tolist(), s1, s2))
            rows = [(-1, part, number, _low_bytes(tokens[hit] >> CUT, 6), doc[hit].tobytes(), known.classes[at].tobytes() + info)]
            rest = np.ones(len(tokens), dtype=bool)
            rest[hit] = False
            short, doc = tokens[rest] >> CUT, doc[rest]
            bucket = (short >> U64(46 - bits)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange((1 << bits) + 1)).tolist()
            low, doc = _low_bytes(short[by], 5), doc[by]
            rows += [(b, part, number, low[5 * x : 5 * y], doc[x:y].tobytes(), None) for b, (x, y) in enumerate(zip(edges, edges[1:])) if x < y]
            number += 1
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=[x.split()[0] for x in PACKED.split(", ")])

    return keyed.mapInArrow(run, PACKED)


def _counted(packed: DataFrame, bits: int) -> DataFrame:
    """PACKED rows with the tokens that more than one document has, and their classes.  A range of hashes is counted at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKED.split(", ")]

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            tokens = _from_bytes(b"".join(r[3] for r in rows), 5)
            _, which, count = np.unique(tokens, return_inverse=True, return_counts=True)
            classes, at, made = class_of(count)[which], 0, []
            for bucket, part, batch, raw, docs, _ in rows:
                n = len(raw) // 5
                own = classes[at : at + n]
                keep = own > 0
                if keep.any():
                    whole = _from_bytes(raw, 5)[keep] & U64((1 << 46 - bits) - 1) | U64(bucket << 46 - bits)
                    made.append((bucket, part, batch, _low_bytes(whole, 6), np.frombuffer(docs, np.uint32)[keep].tobytes(), own[keep].tobytes()))
                at += n
            for x in range(0, len(made), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made[x : x + 1000]), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=names)

        held: list[tuple] = []
        for batch in batches:
            info = batch.filter(pc.less(batch.column("bucket"), 0))
            if info.num_rows:
                yield info
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] < 0:
                    continue
                if held and held[-1][0] != row[0]:
                    yield from out(held)
                    held = []
                held.append(row)
        if held:
            yield from out(held)

    dealt = F.when(F.col("bucket") < 0, F.xxhash64("part", "batch")).otherwise(F.xxhash64("bucket"))
    return packed.repartition(dealt).sortWithinPartitions("bucket").mapInArrow(run, PACKED)


PROFILE = "doc_id long, h long, n long, s1 long, s2 long, prefix array<long>, whole binary, classes binary"


def _gathered(counted: DataFrame, percent: int) -> DataFrame:
    """PROFILE rows: a batch's tokens from all ranges put back to its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            info = next(r for r in rows if r[0] < 0)
            own = len(info[4]) // 4
            ids, hs, sizes, s1, s2 = pickle.loads(info[5][own:])
            tokens = np.concatenate([_from_bytes(r[3], 6) for r in rows])
            doc = np.concatenate([np.frombuffer(r[4], np.uint32) for r in rows])
            classes = np.concatenate([np.frombuffer(r[5][: len(r[4]) // 4], np.uint8) for r in rows])
            by = np.lexsort((tokens, doc))
            tokens, doc, classes = tokens[by], doc[by], classes[by]
            new = np.append(True, (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1]))[: len(tokens)]  # two shingles may be one in 46 bits
            tokens, doc, classes = tokens[new], doc[new], classes[new]
            edges = np.searchsorted(doc, np.arange(len(ids) + 1)).tolist()
            cut = [(tokens[a:b], classes[a:b]) for a, b in zip(edges, edges[1:])]
            firsts = [np.sort(prefix(t, c, n, percent, 0)).view(np.int64) for (t, c), n in zip(cut, sizes)]
            ends = np.append(0, np.cumsum([len(x) for x in firsts])).astype(np.int32)
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts))), pa.array([_low_bytes(t, 6) for t, _ in cut], pa.binary()), pa.array([c.tobytes() for _, c in cut], pa.binary()),
            ], names=[x.split()[0] for x in PROFILE.split(", ")])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][1:3] != row[1:3]:
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    return counted.repartition("part", "batch").sortWithinPartitions("part", "batch").mapInArrow(run, PROFILE)


def _shared_only(entries: DataFrame) -> DataFrame:
    """Of (token, salt, rep, …), the rows whose token has another row, or whose bucket is split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which may have its partner in the next batch
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            n = batch.num_rows
            if n < 2:
                held = batch
                continue
            token, salt = batch.column("token").to_numpy(), batch.column("salt").to_numpy()
            same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            keep = (salt > 0) | np.append(False, same) | np.append(same, False)
            held = batch.slice(n - 1, 1)
            if keep[n - 1]:  # it goes on now, and stays without a rep as a witness
                yield batch.filter(pa.array(keep))
                at = held.schema.get_field_index("rep")
                held = held.set_column(at, held.schema.field(at), pa.array([None], pa.int64()))
            else:
                yield batch.slice(0, n - 1).filter(pa.array(keep[: n - 1]))

    kept = entries.repartition("token", "salt").sortWithinPartitions("token", "salt").mapInArrow(run, entries.schema)
    return kept.where("rep is not null").drop("salt")


def _low_bytes(x: np.ndarray, width: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_bytes(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _sets(profiles: DataFrame, percent: int, orders: int) -> DataFrame:
    """rep, n, whole (the tokens it may share) and others (prefixes under the other orders, 24 bits a token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = []
            for n, whole, classes in zip(*(batch.column(c).to_pylist() for c in ("n", "whole", "classes"))):
                t, c = _from_bytes(whole, 6), np.frombuffer(classes, np.uint8)
                others.append([_low_bytes(np.unique(prefix(t, c, n, percent, o) & U64(0xFFFFFF)), 3) for o in range(1, orders)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), batch.column("whole"), pa.array(others, pa.list_(pa.binary())), batch.column("s1"), batch.column("s2")], names=["rep", "n", "whole", "others", "s1", "s2"])

    return profiles.select("doc_id", "n", "whole", "classes", "s1", "s2").mapInArrow(run, "rep long, n long, whole binary, others array<binary>, s1 long, s2 long")


def _share(x: bytes, y: bytes, width: int) -> int:
    return len(np.intersect1d(_from_bytes(x, width), _from_bytes(y, width), assume_unique=True))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: sizes and the other orders' prefixes are intersected first, whole sets compared then."""

    spark = pairs.sparkSession

    def fetched(pairs: DataFrame, column: str) -> DataFrame:
        """a, b and both sides' column; both joins share one exchange of the sets."""
        own = sets.select("rep", "n", column)
        left = pairs.join(own, pairs["b"] == own["rep"]).select("a", "b", F.col("n").alias("b_n"), F.col(column).alias(f"b_{column}"))
        own = sets.select("rep", "n", column)
        return left.join(own, left["a"] == own["rep"]).select("a", "b", F.col("n").alias("a_n"), F.col(column).alias(f"a_{column}"), "b_n", f"b_{column}")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("a_others").to_pylist(), batch.column("b_others").to_pylist()
            keep = [all(_share(p, q, 3) for p, q in zip(u, v)) for u, v in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q, m, n in zip(*(batch.column(c).to_pylist() for c in ("a_whole", "b_whole", "a_n", "b_n"))):
                both = _share(p, q, 6)
                keep.append(100 * both >= percent * (m + n - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = settled(spark, pairs, "pairs")
    few = pairs.limit(FEW + 1).count()
    if few <= FEW:  # so few sets are wanted that their ids, FEW pairs at most, are sent to the sets
        named = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        sets = settled(spark, sets.join(F.broadcast(named), "rep", "left_semi"), "some-sets")
    near = fetched(pairs, "others").where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
    near = settled(spark, near.select("a", "b", "a_others", "b_others").mapInArrow(filtered, "a long, b long"), "candidates")
    out = settled(spark, fetched(near, "whole").select("a", "b", "a_whole", "b_whole", "a_n", "b_n").mapInArrow(compared, "a long, b long"), "links")
    discard(spark, pairs, near, *([sets] if few <= FEW else []))
    return out


def _compared(held: DataFrame, percent: int, block: int, inside: bool, pairs: bool) -> DataFrame:
    """What the members of each group link with, without making their pairs.

    held: group, rep, c, n, whole, s1, s2 and asks.  A group's members are dealt to blocks by size class, by which sets
    that link differ by one at most, and by hash; those that ask are dealt to parts in the same way.  Each block meets
    each part of the three size classes in a task, where a set is compared with the block's sets at once.  Blocks hold
    at most `block` rows and BLOCK_BYTES, and a group of some size has several.  Of inside, all other sets count, else
    only those of other components (c).  Gives the links (a, b), or with pairs=False s1, s2 and the number of links.
    """
    spark = held.sparkSession
    ratio = max(100.0 / percent, 1.01)
    sized = settled(spark, held.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(ratio)) + 1e-9).cast("int")), "held")
    some = lambda n, b: F.ceil(F.greatest(n / block, b / BLOCK_BYTES, F.least(F.lit(8), n / (block / 8)))).cast("int")
    asks = F.col("asks").cast("int")
    blocks = sized.groupBy("group", "size").agg(some(F.count(F.lit(1)), F.sum(F.length("whole"))).alias("blocks"), some(F.sum(asks), F.sum(asks * F.length("whole"))).alias("parts"))
    blocks = settled(spark, blocks, "blocks")
    body = ("rep", "c", "n", "whole", "s1", "s2")
    other = blocks.select("group", F.col("size").alias("osize"), F.col("blocks").alias("oblocks"), F.col("parts").alias("oparts"))
    mine = lambda n: F.pmod(F.xxhash64("s1", "s2"), F.greatest(F.col(n), F.lit(1))).cast("int")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    met = sized.join(blocks, ["group", "size"]).select("group", "size", "asks", mine("blocks").alias("block"), mine("parts").alias("part"), F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("osize"), *body)
    met = met.join(other, ["group", "osize"])
    cell = lambda size, number, osize, part, role: F.struct(size.alias("size"), number.alias("block"), osize.alias("osize"), part.alias("part"), F.lit(role).alias("role"))
    as_member = F.transform(upto("oparts"), lambda x: cell(F.col("size"), F.col("block"), F.col("osize"), x, 0))
    as_asking = F.transform(upto("oblocks"), lambda x: cell(F.col("osize"), x, F.col("size"), F.col("part"), 1))
    cells = F.when(F.col("asks"), F.concat(as_member, as_asking)).otherwise(as_member)
    dealt = met.select("group", F.explode(cells).alias("x"), *body).select("group", "x.*", *body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, index, out = None, [], None, []
        for batch in batches:
            for g, size, number, osize, part, role, rep, c, n, whole, s1, s2 in zip(*(x.to_pylist() for x in batch.columns)):
                if (g, size, number, osize, part) != group:
                    group, rows, index = (g, size, number, osize, part), [], None
                if not role:
                    rows.append((rep, c, n, _from_bytes(whole, 6), s1, s2))
                    continue
                if not rows:
                    continue
                if index is None:  # all members of a block come before those that ask
                    owner = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
                    tokens = np.concatenate([r[3] for r in rows])
                    by = np.argsort(tokens, kind="stable")
                    index = tokens[by], owner[by], *(np.array([r[k] for r in rows]) for k in (0, 1, 2, 4, 5))
                tokens, owner, reps, cs, ns, x1, x2 = index
                mine = _from_bytes(whole, 6)
                lo, hi = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
                hits = np.concatenate([owner[i:j] for i, j in zip(lo.tolist(), hi.tolist())]) if len(mine) else owner[:0]
                both = np.bincount(hits, minlength=len(reps))
                near_ = 100 * both >= percent * (ns + n - both)
                near_ &= (x1 != s1) | (x2 != s2) if inside else cs != c
                if pairs:
                    out += [(min(rep, r), max(rep, r)) for r in reps[near_].tolist()]
                elif near_.any():
                    out.append((s1, s2, int(near_.sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)
                out = []

    names = ["a", "b"] if pairs else ["s1", "s2", "k"]
    key = ("group", "size", "block", "osize", "part")
    found = dealt.repartition(*key).sortWithinPartitions(*key, "role").mapInArrow(run, ", ".join(f"{x} long" for x in names))
    out = settled(spark, found.distinct() if pairs else found.groupBy("s1", "s2").agg(F.sum("k").alias("n_links")), "compared")
    discard(spark, sized, blocks)
    return out


def _in_blocks(named: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) across components among the members of large buckets.

    Buckets with one and the same major component are a cluster; its members outside that component ask.
    """
    spark = named.sparkSession
    per = named.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("group"))
    per = settled(spark, per, "cluster-tokens")  # as with open tokens
    cluster = settled(spark, _by_token(named, per, "rep").select("group", "rep", "c").distinct(), "clusters")
    held = cluster.join(sets.select("rep", "n", "whole", "s1", "s2"), "rep").withColumn("asks", F.col("c") != F.col("group"))
    out = _compared(held, percent, block, False, True)
    discard(spark, per, cluster)
    return out


def _within(label: DataFrame, sets: DataFrame, percent: int, block: int, pairs: bool) -> DataFrame:
    """All links inside components: every link is in one.  Of a component of two, the link is known."""
    spark = label.sparkSession
    sizes = settled(spark, label.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component-sizes")
    members = label.join(sizes, "component").where(F.lit(True) if pairs else F.col("size") > 2).select(F.col("node").alias("rep"), F.col("component").alias("group"))
    own = sets.dropDuplicates(["s1", "s2"])
    held = own.join(members, "rep").select("group", "rep", F.col("group").alias("c"), "n", "whole", "s1", "s2", F.lit(True).alias("asks"))
    found = _compared(held, percent, block, True, pairs)
    if not pairs:
        two = label.join(sizes.where("size = 2"), "component").select(F.col("node").alias("rep")).join(own, "rep").select("s1", "s2", F.lit(1).cast("long").alias("n_links"))
        found = settled(spark, found.unionByName(two), "degrees")
    discard(spark, sizes)
    return found


def _by_token(many: DataFrame, one: DataFrame, by: str) -> DataFrame:
    """many joined with one, which has one row for each token.  A token's class is in its name: one that many documents have is split by a salt."""
    parts = F.ceil(F.pow(F.lit(2.0), F.shiftrightunsigned("token", 58).cast("double")) / JOINED)
    parts = F.least(parts, F.lit(1 << 16)).cast("int")
    left = many.withColumn("_salt", F.pmod(F.xxhash64(by), parts).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, ["token", "_salt"]).drop("_salt")


def _may_link(an: str, am: str, bn: str, bm: str, percent: int) -> Column:
    """Whether sizes allow a link, where am of an tokens are in other documents: no more than those can be shared."""
    both = F.least(am, bm).cast("long")
    return 100 * both >= percent * (F.col(an) + F.col(bn) - both)


class _Solved(NamedTuple):
    """What the join has found: sizes (doc_id, h, n, s1, s2) of all rows, components (node, component) of linked classes and their sets."""

    seen: DataFrame
    label: DataFrame
    sets: DataFrame


def _solved(docs: DataFrame, k: int, percent: int, orders: int, bucket: int, small: int, block: int) -> _Solved:
    spark = docs.sparkSession
    sc = spark.sparkContext
    keyed = _keyed(docs)
    heavy = sc.broadcast(Heavy(*heavy_shingles(keyed, k)))
    # ranges of hashes, some for each reducer, whatever the number of input partitions
    bits = min(max(6, (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length()), 24)
    full = settled(spark, _gathered(_counted(_packed(keyed, k, heavy, bits), bits), percent), "profiles")
    seen = settled(spark, full.select("doc_id", "h", "n", "s1", "s2"), "sizes")
    whole = full.where("size(prefix) > 0 and doc_id is not null").withColumn("m", (F.length("whole") / 6).cast("int"))
    classes = whole.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "h")).alias("x"), F.first("prefix").alias("prefix"), F.first("n").cast("int").alias("n"), F.first("m").alias("m"))
    # a token's class is in its name: buckets that may be large are split by a salt until they are filtered
    top = F.shiftrightunsigned("token", 58)
    parts = F.ceil(F.pow(F.lit(2.0), top.cast("double")) / bucket).cast("int")
    entries = classes.select(F.explode("prefix").alias("token"), F.col("x.doc_id").alias("rep"), F.col("x.h").alias("h"), "n", "m")
    entries = entries.select("token", F.when(parts > 1, F.pmod(F.xxhash64("rep"), parts) + 1).otherwise(0).cast("int").alias("salt"), "rep", "h", "n", "m")
    buckets = settled(spark, _shared_only(entries), "buckets")
    wanted = buckets.select(F.col("rep").alias("doc_id"), "h").distinct()
    sets = settled(spark, _sets(full.join(wanted, ["doc_id", "h"], "left_semi"), percent, orders), "sets")
    discard(spark, full)
    # the pivot of a token is the member with the smallest share of tokens of its own: of a group of edited copies, the original
    pivots = buckets.groupBy("token").agg(F.min(F.struct((1 - F.col("m") / F.col("n")).alias("own"), "rep", "n", "m")).alias("p"))
    pivots = settled(spark, pivots.select("token", F.col("p.rep").alias("a"), F.col("p.n").alias("an"), F.col("p.m").alias("am")), "pivots")
    stars = _by_token(buckets, pivots, "rep").where((F.col("rep") != F.col("a")) & _may_link("n", "m", "an", "am", percent))
    stars = settled(spark, stars.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct(), "stars")
    discard(spark, pivots)
    links = verified(stars, sets, percent)
    label = components(links)
    # what the stars leave open: members of different components that share a token
    named = buckets.join(label, F.col("rep") == F.col("node"), "left").select("token", "rep", "n", "m", F.coalesce("component", "rep").alias("c"))
    named = settled(spark, named, "named")
    opened = named.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("token", "size")
    opened = settled(spark, opened, "open-tokens")  # its size is known now, and where it is small nothing is dealt out by token
    open_ = settled(spark, _by_token(named, opened, "rep"), "open")
    discard(spark, buckets, named, opened, label)
    few = open_.where(F.col("size") <= small)
    x, y = (few.select("token", F.col("rep").alias(s), F.col("c").alias(f"{s}c"), F.col("n").alias(f"{s}n"), F.col("m").alias(f"{s}m")) for s in "ab")
    rest = x.join(y, "token").where((F.col("a") < F.col("b")) & (F.col("ac") != F.col("bc")) & _may_link("an", "am", "bn", "bm", percent))
    rest = rest.select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    more = verified(rest, sets, percent)
    blocked = _in_blocks(open_.where(F.col("size") > small), sets, percent, block)
    label = components(links.unionByName(more).unionByName(blocked))
    discard(spark, open_, stars, links, more, blocked)
    return _Solved(seen, label, sets)


def linked(docs: DataFrame, k: int = K, percent: int = PERCENT, orders: int = ORDERS, bucket: int = BUCKET, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each row of docs (doc_id, text); n_links is the number of other, different sets that link with the row's."""
    return _rows(docs, k, percent, orders, bucket, small, block, True)


def _rows(docs: DataFrame, k: int, percent: int, orders: int, bucket: int, small: int, block: int, count: bool) -> DataFrame:
    """What linked returns; without count, n_links is null."""
    spark = docs.sparkSession
    seen, label, sets = _solved(docs, k, percent, orders, bucket, small, block)
    real = seen.where("n > 0 and doc_id is not null")
    owner = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")).join(label, F.col("rep") == F.col("node"), "left")
    # a document whose set nobody shares and which has no links is its own component; the others' classes are few, and their size is known
    owner = owner.where("size > 1 or component is not null").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    if count:
        owner = owner.join(_within(label, sets, percent, block, False), ["s1", "s2"], "left")
    else:
        owner = owner.withColumn("n_links", F.lit(None).cast("long"))
    owner = settled(spark, owner, "owners")
    discard(spark, sets, label)
    none = F.lit(0 if count else None).cast("long")
    sized = real.select("doc_id", "n", "s1", "s2").join(owner, ["s1", "s2"], "left")
    sized = sized.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", none).alias("n_links"))
    return sized.unionByName(seen.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), none.alias("n_links")))


def links(docs: DataFrame, k: int = K, percent: int = PERCENT, orders: int = ORDERS, bucket: int = BUCKET, small: int = SMALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The join itself: all links (a < b) between class representatives, and members (doc_id, rep): the classes of documents with one set."""
    seen, label, sets = _solved(docs, k, percent, orders, bucket, small, block)
    found = _within(label, sets, percent, block, True).where("a < b")
    discard(docs.sparkSession, sets, label)
    real = seen.where("n > 0 and doc_id is not null")
    reps = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    return found, real.select("doc_id", "s1", "s2").join(reps, ["s1", "s2"]).select("doc_id", "rep").distinct()


def one_of_each(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """docs without the documents that have a smaller doc_id in their component; of rows of equal doc_id the one with the smallest text stays."""
    found = settled(docs.sparkSession, _rows(docs, k, percent, ORDERS, BUCKET, SMALL, BLOCK, False), "linked")
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    plain, doc, text = numbered(docs), *(f"_{docs.columns.index(c)}" for c in ("doc_id", "text"))
    out = plain.join(gone, F.col(doc).cast("long") == F.col("gone"), "left_anti")
    if not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy(F.col(text).asc_nulls_last())))
        out = ranked.where((F.col("rank") == 1) | F.col(doc).isNull()).drop("rank")
    return out.toDF(*docs.columns)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


def oracle_sql(k: int = K, percent: int = PERCENT) -> str:
    """The same by counting shared shingles of all pairs; components by the transitive closure of small classes."""
    return f"""
with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from documents),
s as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < {k} then [array_to_string(words, ' ')] else list_transform(range(1, len(words) - {k - 2}), lambda i: array_to_string(words[i : i + {k - 1}], ' ')) end) as g from t),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as common from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all),
e as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * common >= {percent} * (x.n + y.n - common)),
r as (select a as node, a as reach from e union select r.node, e.b from r join e on r.reach = e.a),
c as (select n.doc_id, least(n.doc_id, min(b)) as rep from n left join (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where common = x.n and common = y.n) on n.doc_id = a group by n.doc_id),
l as (select a, count(distinct y.rep)::bigint as n_links from e join c x on a = x.doc_id join c y on b = y.doc_id where x.rep <> y.rep group by a)
select t.doc_id, coalesce(n, 0)::bigint as n_shingles, least(t.doc_id, coalesce(m, t.doc_id)) as component_id, coalesce(n_links, 0)::bigint as n_links
from t left join n on t.doc_id = n.doc_id left join (select node, min(reach) as m from r group by node) q on t.doc_id = q.node left join l on t.doc_id = l.a"""
