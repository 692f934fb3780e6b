"""MinHash near-dedup by an inverted join over signature coordinates.

A set of word shingles has a signature of ``coordinates`` least hashes. It is posted under its pairs of coordinate and value; two sets collide in as many
coordinates as their postings share, on average their Jaccard similarity times ``coordinates``. Pairs are retained that collide in ``match`` coordinates: so many that
a pair right at the wanted similarity collides less often with a chance of ``MISS`` at most.

* Prefix. All pairs of coordinate and value have one order, rare ones first (a count sketch over all sets). Two sets with ``match`` collisions share one of
  the first ``coordinates - match + 1`` of each, so only those are posted, and of those only what more than one set has (a Bloom filter).
* Skip merging. A task has whole lists, each posting with its signature, 16 bits a coordinate. In a list's members, collisions with one of them are counted by merging the
  shorter inverted lists of its coordinates; the longest, ``match - 1`` at most, are skipped, and only looked up for the few members that can still come to ``match``.
  What collides enough joins the member's component and is asked next; so a list's near copies give one edge each, and not all pairs.
* A list of over ``SPLIT`` members is cut by set size, as linked sets are of like size, and what is still larger into blocks, each two of which meet in a task.
* The components of retained pairs hold all links that the signatures show; each is then confirmed on full sets, as in the n-gram Jaccard join.

Equal sets are one posting, whatever their number. Words, nulls, empty and long texts, repeated rows, ids without a value, empty tables and other columns are as in ``jaccard_join``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, only_cache, parallelism, read
from .jaccard_join import SKETCH, _cut_up, bloom, classes, components, confirm, fixed_array, in_bloom, ngrams, signature

#: Coordinates of a signature; the chance to miss a pair right at the similarity; members up to which all of a list are compared outright; members of a list in one task.
COORDINATES, MISS, DENSE, SPLIT = 64, 1e-7, 256, 10_000
#: Lists that are longer may be skipped.
LONG = 32

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def match_threshold(coordinates: int, percent: int, miss: float = MISS) -> int:
    """Most collisions that pairs of this similarity reach with a chance of ``1 - miss`` at least."""
    p, below, t = percent / 100, 0.0, 0
    while t < coordinates:
        below += math.comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            break
        t += 1
    return max(1, t)


def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors, one of each a coordinate."""
    x = (np.arange(1, 2 * coordinates + 1, dtype=np.uint64)) * _M[0]
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    x ^= x >> np.uint64(31)
    return x[:coordinates, None], x[coordinates:, None] | np.uint64(1)


def minhashes(s: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least hash of the set in each coordinate, its upper 32 bits."""
    out = np.full(len(masks), np.iinfo(np.uint64).max)
    for first in range(0, len(s), 4096):
        out = np.minimum(out, ((s[None, first : first + 4096] ^ masks) * factors).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def posting_keys(mins: np.ndarray) -> np.ndarray:
    """64-bit keys of coordinate and value: [set, coordinate]."""
    key = (mins.astype(np.uint64) | np.arange(mins.shape[1], dtype=np.uint64)[None, :] << np.uint64(32)) + np.uint64(1)
    key = (key ^ (key >> np.uint64(30))) * _M[1]
    key = (key ^ (key >> np.uint64(27))) * _M[2]
    return key ^ (key >> np.uint64(31))


class Postings:
    """Inverted lists of a list's members: under each coordinate and value, who has it."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        at = np.arange(codes.shape[1], dtype=np.uint32) << np.uint32(16)
        tokens = (codes | at[None, :]).ravel()
        order = np.argsort(tokens, kind="stable")
        self.at, self.tokens, self.holders = at, tokens[order], (order // codes.shape[1]).astype(np.int32)

    def collide(self, code: np.ndarray, match: int) -> np.ndarray:
        """Members that agree with ``code`` in ``match`` coordinates or more."""
        if len(self.codes) <= DENSE:
            return np.flatnonzero((self.codes == code).sum(axis=1) >= match)
        low, high = np.searchsorted(self.tokens, code | self.at), np.searchsorted(self.tokens, code | self.at, side="right")
        order = np.argsort(low - high, kind="stable")
        skipped = order[: match - 1][(high - low)[order[: match - 1]] > LONG]
        merged = order[len(skipped) :]
        counts = np.bincount(np.concatenate([self.holders[low[c] : high[c]] for c in merged]), minlength=len(self.codes))
        able = np.flatnonzero(counts >= match - len(skipped))
        return able[counts[able] + (self.codes[able][:, skipped] == code[skipped]).sum(axis=1) >= match]


def cluster(codes: np.ndarray, n: np.ndarray, percent: int, match: int) -> list[tuple[int, int]]:
    """Edges (member, member) that connect whatever members of a list collide in ``match`` coordinates and are of like size."""
    edges: list[tuple[int, int]] = []
    free, start = np.arange(len(codes)), 0  # free members, as places of ``postings``
    postings, alive = Postings(codes), np.ones(len(codes), bool)
    while start < len(free):
        if not alive[start]:
            start += 1
            continue
        alive[start] = False
        queue = [int(free[start])]
        while queue:
            x = queue.pop()
            found = postings.collide(codes[x], match)
            found = found[alive[found]]
            size = n[free[found]]
            found = found[np.minimum(size, n[x]) * 100 >= percent * np.maximum(size, n[x])]
            edges += [(int(y), x) for y in free[found]]
            queue += free[found].tolist()
            alive[found] = False
            left = int(np.count_nonzero(alive))
            if not left:
                return edges
            if left < len(free) // 2:  # lists of those left only
                free = free[alive]
                postings, alive, start = Postings(codes[free]), np.ones(len(free), bool), 0
    return edges


def _lists(table: pa.Table, coordinates: int, percent: int, match: int) -> pa.RecordBatch:
    """Edges between the members of each of several whole lists (key, sig, n, codes), sorted by key."""
    key, sig, n = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "sig", "n"))
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint16).astype(np.uint32).reshape(-1, coordinates)
    first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    size = np.diff(np.concatenate([first, [len(key)]]))
    a, b = [], []
    for s in np.unique(size[(size > 1) & (size < 8)]).tolist():  # short lists: all of one length at once
        own = first[size == s]
        for i in range(s):
            for j in range(i):
                x, y = own + i, own + j
                ok = (sig[x] != sig[y]) & (np.minimum(n[x], n[y]) * 100 >= percent * np.maximum(n[x], n[y]))
                x, y = x[ok], y[ok]
                ok = (codes[x] == codes[y]).sum(axis=1) >= match
                a.append(sig[x[ok]])
                b.append(sig[y[ok]])
    for f, s in zip(first[size >= 8].tolist(), size[size >= 8].tolist()):
        edges = np.array(cluster(codes[f : f + s], n[f : f + s], percent, match), np.int64).reshape(-1, 2) + f
        a.append(sig[edges[:, 0]])
        b.append(sig[edges[:, 1]])
    both = np.concatenate([np.stack([x, y], axis=1) for x, y in zip(a, b)]) if a else np.zeros((0, 2), np.int64)
    both = np.unique(np.sort(both, axis=1), axis=0)
    return pa.RecordBatch.from_pydict({"a": both[:, 0], "b": both[:, 1]})


def link(docs: DataFrame, k: int, percent: int, scratch: Scratch, coordinates: int = COORDINATES, miss: float = MISS) -> DataFrame:
    """uid, doc_id, n_shingles, sig and root of every row of ``docs`` (uid, doc_id, text): equal roots, same component."""
    spark, match = docs.sparkSession, match_threshold(coordinates, percent, miss)
    posted = coordinates - match + 1
    docs = docs.select(F.col("uid").cast("long"), F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("hash"))

    def signed(batches):
        only_cache("minhash")
        masks, factors = permutations(coordinates)
        for b in batches:
            n, sig, mins = [], [], []
            for t in b.column(2).to_pylist():
                s = ngrams(t, k)
                n.append(len(s))
                sig.append(signature(s))
                mins.append(minhashes(s, masks, factors).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_pydict({"uid": b.column(0), "doc_id": b.column(1), "hash": b.column(3), "n_shingles": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.int64()), "mins": pa.array(mins, pa.binary())})

    rows = scratch.save(docs.mapInArrow(signed, "uid long, doc_id long, hash long, n_shingles long, sig long, mins binary"), "rows")
    sets = rows.where("n_shingles > 0").groupBy("sig").agg(F.first("n_shingles").cast("int").alias("n"), F.first("mins").alias("mins"))
    sets = scratch.save(sets, "sets")

    def keys_of(column) -> np.ndarray:
        return posting_keys(np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, coordinates))

    def sketch(b, counts):
        counts += np.bincount((keys_of(b.column(0)) >> np.uint64(44)).astype(np.int64).ravel(), minlength=SKETCH).astype(np.int32)

    counts = fixed_array(sets.select("mins"), SKETCH, sketch)
    mean = float(counts.mean())
    usual = mean + 6 * mean**0.5 + 16
    # frequent places come last, by powers of two; the order is one for all sets, which is all that prefixes need
    levels = spark.sparkContext.broadcast(np.where(counts <= usual, 0, np.ceil(np.log2(np.maximum(counts, 1) / usual)) + 1).astype(np.uint8))

    def prefixes(keys: np.ndarray) -> np.ndarray:
        level = levels.value[(keys >> np.uint64(44)).astype(np.int64)]
        return np.take_along_axis(keys, np.lexsort((keys, level), axis=1)[:, :posted], axis=1)

    def explode(batches):
        for b in batches:
            first = prefixes(keys_of(b.column(1)))
            yield pa.RecordBatch.from_pydict({"key": first.ravel().view(np.int64), "sig": np.repeat(b.column(0).to_numpy(), posted)})

    # keys that more than one set has
    counted = sets.select("sig", "mins").mapInArrow(explode, "key long, sig long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = scratch.save(counted, "shared")
    shared = spark.sparkContext.broadcast(bloom(counted, "key"))

    def post(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                b = batch.slice(i, 1000)
                keys = keys_of(b.column(2))
                codes = (keys >> np.uint64(48)).astype(np.uint16)
                first = prefixes(keys).view(np.int64)
                at, place = np.nonzero(in_bloom(shared.value, first))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(first[at, place]), b.column(0).take(take), b.column(1).take(take), pa.array([x.tobytes() for x in codes], pa.binary()).take(take)], names=["key", "sig", "n", "codes"])

    def collisions(batches):
        held: list[pa.RecordBatch] = []
        done = lambda: _lists(pa.Table.from_batches(held), coordinates, percent, match)
        for b in batches:
            if b.num_rows:
                if held and held[-1].column(0)[-1] != b.column(0)[0]:
                    yield done()
                    held = []
                key = b.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:  # all but the last key are complete
                    held.append(b.slice(0, cut))
                    yield done()
                    held = []
                held.append(b.slice(cut))
        if held:
            yield done()

    postings = sets.select("sig", "n", "mins").mapInArrow(post, "key long, sig long, n int, codes binary")
    crowded = scratch.save(counted.where(F.col("n") > SPLIT).select("key"), "crowded")
    if crowded.take(1):
        postings = postings.join(crowded, "key", "left_anti").unionByName(_cut_up(scratch.save(postings.join(crowded, "key"), "crowd"), percent, scratch))
    postings = postings.repartition(parallelism(spark), "key").sortWithinPartitions("key")
    pairs = scratch.save(postings.mapInArrow(collisions, "a long, b long").distinct(), "pairs")
    bundles = scratch.save(components(pairs, scratch, "outer").withColumnRenamed("node", "sig").withColumnRenamed("root", "bundle"), "bundles")
    out = confirm(docs, rows, bundles, k, percent, scratch)
    for name in ("sets", "shared", "crowded", "crowd", "crowds", "pairs", "bundles"):
        scratch.drop(name)
    return out


def filter_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, the one with the least doc_id (null last), and of equal ones the first; rows with empty sets stay."""
    scratch, uid = Scratch(docs.sparkSession, "minhash-filter"), fresh(docs.columns, "__uid")
    kept = scratch.save(docs.withColumn(uid, F.monotonically_increasing_id()), "docs")
    linked = link(kept.select(F.col(uid).alias("uid"), "doc_id", "text"), k, percent, scratch)
    first = linked.groupBy(F.when(F.col("n_shingles") > 0, F.col("root")), F.when(F.col("n_shingles") == 0, F.col("uid"))).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("x"))
    stay = first.select(F.col("x.uid").alias(uid))
    return kept.join(stay, uid, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.lit(0).alias("uid"), "doc_id", "text")
    scratch = Scratch(spark, "minhash-dedup")
    out = classes(scratch.save(link(docs, 4, 80, scratch), "linked"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
