"""N-gram Jaccard join: a similarity join in the metric space of word n-gram sets, exact, by pivots.

The distance of two sets is 1 - Jaccard, a metric. The join is in two layers.

* Outer pivots are the n-grams themselves, as sets of one. A set's nearest pivots are its own n-grams, all at the same
  distance; ties go by how frequent an n-gram is (a count sketch over all texts), then by hash. Two sets within
  the radius share a pivot among the first ``n - ceil(s * n) + 1`` of each: that window is how far a set must be replicated. In a
  region, pairs are dropped whose sizes, places of the pivot, or parity sketches rule a link out. (A parity sketch has a bit for each
  hash class, set if the class has an odd number of n-grams; each n-gram in which two sets differ flips one
  bit, so the sketches' Hamming distance is at most the sets' difference. What goes with a key is folded to ``SENT`` words.) A region of over ``SPLIT`` members is cut by size, as linked
  sets are of like size, and what is still larger into blocks, each two of which meet in a task. What is left joins members to bundles
  (connected components), so that no link is between bundles.
* In a bundle, pivots are members: distances to a few pivots make Voronoi regions. By the triangle inequality a linked pair is whole in
  the region of either's home if each region also takes, as copies, the members whose pivot is at most twice the radius farther than their own. Regions
  with their copies are joined recursively as long as that makes them smaller. A region that it doesn't is covered by balls: a member's
  ball is all that is linked with it, and thus one component; from there only the shell, up to twice the radius, can be linked to the ball, and
  only pairs are compared whose distances to the pivot differ by at most the radius and which no link connects yet. The ball leaves, and
  the next member left is a pivot. So near copies collapse to one ball and aren't expanded into pairs.

A task joins bundles of up to ``LARGE`` bytes. Larger ones are dealt out to tasks in the same way, in rounds of written tables: members are measured
against pivots of their region, those in a ball of a pivot are linked to it, and go on to a region only if members that they aren't linked with yet
are there at a distance from its pivot that the radius allows. Regions in which all are linked end. A region that doesn't get smaller is
split into blocks of bounded size, and each two blocks meet in a task. The tasks' links are joined by connected components. Equal sets are one member from
the start. What goes to the driver or is broadcast has a bounded size (count sketch, Bloom filters of at most ``2 ** MOST_BITS`` bits, at most ``HOT`` keys).
A Bloom filter has 16 bits for each key as long as it may grow; beyond that it lets more pass, which costs time and no link.

Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer words than ``k``: the sequence is the only n-gram. Null text, or
text without words: an empty set, linked with nothing. Texts of any length count whole. Rows with null doc_id take part; a component of such rows alone has a
null component_id. Repeated rows are links like other equal texts. An empty table gives an empty result. Other columns are ignored
(``filter_documents`` keeps them, whatever their names).
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, fresh, only_cache, parallelism, read

#: Places of the count sketch; exponents of a Bloom filter's least and most bits; parts in which they are summed.
SKETCH, LEAST_BITS, MOST_BITS, PARTS = 1 << 20, 26, 30, 64
#: Rows from which a region is compared by sketches in its task; smaller regions give pairs. Rows that a task compares at most.
DENSE, SPLIT = 8, 10_000
#: Words of a parity sketch that go with a key: a longer one is folded, so that what a text sends grows with its length, and not with its square.
SENT = 128
#: Members of a leaf; pivots of a region in a task, and of one that is dealt out; bytes of a bundle that one task joins.
LEAF, PIVOTS, DEALT, LARGE = 48, 6, 16, 48_000_000
#: Keys that a skewed join may treat apart.
HOT = 256

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def ngrams(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(w) if len(w) < k else k, np.uint64)
    for j in range(min(k, len(w))):
        out = out * _M[0] + h[j : j + n]
        out ^= out >> np.uint64(29)
    out *= _M[1]
    out ^= out >> np.uint64(32)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def signature(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def fixed_array(df: DataFrame, size: int, add) -> np.ndarray:
    """Sum of one array of ``size`` counts from each task; ``add(batch, array)`` counts a batch. Parts of the array are
    summed in separate tasks, and the driver gets ``size`` counts."""
    step = size // PARTS

    def run(batches):
        only_cache("jaccard")
        counts = np.zeros(size, np.int32)
        for b in batches:
            add(b, counts)
        parts = [zlib.compress(counts[i * step : (i + 1) * step].tobytes(), 1) for i in range(PARTS)]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "counts": pa.array(parts, pa.binary())})

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(step, np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(x), np.int32)
        return pd.DataFrame({"part": [key[0]], "counts": [zlib.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), 1)]})

    out = np.zeros(size, np.int32)
    for r in df.mapInArrow(run, "part int, counts binary").groupBy("part").applyInPandas(merge, "part int, counts binary").collect():
        out[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(zlib.decompress(r["counts"]), np.int32)
    return out


def bloom(df: DataFrame, column: str) -> np.ndarray:
    """Bits of a Bloom filter over a long column of a written table."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * df.count()).bit_length()))

    def add(b, counts):
        at = (b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) * _M[2]) >> np.uint64(64 - bits)
        np.bitwise_or.at(counts, (at >> np.uint64(5)).astype(np.int64), (np.uint32(1) << (at & np.uint64(31)).astype(np.uint32)).view(np.int32))

    # words of 32 bits; the sum over tasks must be an or, so bits are merged as such
    return _or_array(df.select(column), (1 << bits) // 32, add)


def _or_array(df: DataFrame, size: int, add) -> np.ndarray:
    step = size // PARTS

    def run(batches):
        bits = np.zeros(size, np.int32)
        for b in batches:
            add(b, bits)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "bits": pa.array([zlib.compress(bits[i * step : (i + 1) * step].tobytes(), 1) for i in range(PARTS)], pa.binary())})

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(step, np.int32)
        for x in pdf["bits"]:
            total |= np.frombuffer(zlib.decompress(x), np.int32)
        return pd.DataFrame({"part": [key[0]], "bits": [zlib.compress(total.tobytes(), 1)]})

    out = np.zeros(size, np.int32)
    for r in df.mapInArrow(run, "part int, bits binary").groupBy("part").applyInPandas(merge, "part int, bits binary").collect():
        out[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(zlib.decompress(r["bits"]), np.int32)
    return out.view(np.uint32)


def in_bloom(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (values.view(np.uint64) * _M[2]) >> np.uint64(64 - (32 * len(bits)).bit_length() + 1)
    return (bits[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b), the root being the component's smallest; large-star and small-star."""
    edges = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    last, k = None, 0
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(edges.where("a = b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        k += 1
        edges = scratch.save(small, f"{name}{k}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if k > 1:
            scratch.drop(f"{name}{k - 2}") if k > 2 else None
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


class Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                self.up = nxt
                return nxt
            up = nxt

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


class Bundle:
    """The sets of a bundle, with n-grams numbered; those in one set only count for its size alone."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.radius = percent, 1 - percent / 100 + 1e-9
        self.size = np.array([len(s) for s in sets], np.int64)
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = counts[inverse] > 1
        number = np.cumsum(counts > 1) - 1
        owner = np.repeat(np.arange(len(sets)), self.size)[keep]
        self.flat = number[inverse[keep]]
        self.start = np.searchsorted(owner, np.arange(len(sets) + 1))
        n_values = int((counts > 1).sum())
        self.mark = np.zeros(n_values + 1, bool)
        # members by n-gram
        order = np.argsort(self.flat, kind="stable")
        self.holders, self.held = owner[order], np.searchsorted(self.flat[order], np.arange(n_values + 1))
        self.union = Union(len(sets))

    def common(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Intersection sizes of set x with sets ys: by the holders of its n-grams, or by the n-grams of ys, whichever are fewer."""
        own = self.flat[self.start[x] : self.start[x + 1]]
        n, m = self.start[ys + 1] - self.start[ys], self.held[own + 1] - self.held[own]
        if m.sum() + len(self.size) < n.sum():
            first = np.cumsum(m) - m
            at = np.repeat(self.held[own] - first, m) + np.arange(int(m.sum()))
            return np.bincount(self.holders[at], minlength=len(self.size))[ys]
        self.mark[own] = True
        first = np.cumsum(n) - n
        at = np.repeat(self.start[ys] - first, n) + np.arange(int(n.sum()))
        hit = np.concatenate([[0], np.cumsum(self.mark[self.flat[at]])])
        self.mark[own] = False
        return hit[first + n] - hit[first]

    def linked(self, x: int, ys: np.ndarray, both: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (self.size[x] + self.size[ys] - both)

    def distance(self, x: int, ys: np.ndarray, both: np.ndarray) -> np.ndarray:
        return 1 - both / np.maximum(1, self.size[x] + self.size[ys] - both)

    def cover(self, members: np.ndarray) -> None:
        """Joins members by balls around one after the other."""
        left = members
        while len(left) > 1:
            x, others = int(left[0]), left[1:]
            both = self.common(x, others)
            d, inside = self.distance(x, others, both), self.linked(x, others, both)
            ball, shell = others[inside], others[~inside & (d <= 2 * self.radius)]
            for y in ball.tolist():
                self.union.join(x, y)
            if len(ball) and len(shell):
                beside = d[~inside & (d <= 2 * self.radius)]
                for y, own in zip(ball.tolist(), d[inside].tolist()):
                    ok = (beside - own <= self.radius) & (self.union.roots()[shell] != self.union.find(x))
                    some = shell[ok]
                    if len(some):
                        for z in some[self.linked(y, some, self.common(y, some))].tolist():
                            self.union.join(y, z)
            left = others[~inside]

    def join(self, members: np.ndarray) -> None:
        if len(members) <= LEAF:
            return self.cover(members)
        table, nearest = [], None
        x = int(members[np.argmax(self.size[members])])
        for _ in range(PIVOTS):  # each farthest from those before
            d = self.distance(x, members, self.common(x, members))
            table.append(d)
            nearest = d if nearest is None else np.minimum(nearest, d)
            if nearest.max() <= 1e-12:
                break
            x = int(members[np.argmax(nearest)])
        table = np.array(table)
        window = table - nearest[None, :] <= 2 * self.radius  # a member's home is in it
        if window.sum() > 1.5 * len(members) or window.sum(axis=1).max() > 0.7 * len(members):
            return self.cover(members)
        for own in window:
            self.join(members[own])


def join_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the number of the first set of its component."""
    b = Bundle(sets, percent)
    b.join(np.arange(len(sets)))
    return b.union.roots()


def _window(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parity(s: np.ndarray) -> bytes:
    """Parity sketch of a set, of about half a bit for each n-gram; a larger one folds to a smaller."""
    bits = 64
    while 2 * bits < len(s):
        bits *= 2
    odd = np.bincount(((s * _M[2]) >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, words: int) -> bytes:
    """The sketch with at most so many words of 64 bits: its halves laid over each other."""
    w = np.frombuffer(sketch, np.uint64)
    while len(w) > words:
        w = w[: len(w) // 2] ^ w[len(w) // 2 :]
    return w.tobytes()


def _sums_part(n_x, n_y, percent: int):
    """Least intersection of linked sets of these sizes: ``percent / (100 + percent)`` of their sum."""
    return -(-percent * (n_x + n_y) // (100 + percent))


def region_pairs(sig: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of a region of a few members that sizes and the pivot's places don't rule out."""
    i, j = np.triu_indices(len(n), 1)
    ok = (np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j])) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= _sums_part(n[i], n[j], percent))
    return [(int(sig[x]), int(sig[y])) for x, y in zip(i[ok], j[ok])]


def apart(x: bytes, y: bytes) -> int:
    """Hamming distance of two parity sketches, the larger one folded."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def region_edges(sig: np.ndarray, n: np.ndarray, pos: np.ndarray, sketches: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Edges (member, a member of its group) between members of a region, so that all pairs that may be linked are in one group."""
    order = np.argsort(n, kind="stable")
    sig, n, pos, sketches = sig[order], n[order], pos[order], [sketches[i] for i in order]
    out = []
    width = max(map(len, sketches)) // 8
    words = {}
    while width >= 1:  # sketches of each width, larger ones folded
        words[width] = np.zeros((len(n), width), np.uint64)
        width //= 2
    own = np.array([len(x) // 8 for x in sketches])
    for i, x in enumerate(sketches):
        w = np.frombuffer(x, np.uint64)
        while True:
            words[len(w)][i] = w
            if len(w) == 1:
                break
            w = w[: len(w) // 2] ^ w[len(w) // 2 :]
    free = np.ones(len(n), bool)
    for first in range(len(n)):
        if not free[first]:
            continue
        free[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            lo, hi = np.searchsorted(n, [-(-percent * n[x] // 100), 100 * n[x] // percent + 1])
            at = lo + np.flatnonzero(free[lo:hi])
            if not len(at):
                continue
            at = at[np.minimum(n[x] - pos[x], n[at] - pos[at]) >= _sums_part(n[x], n[at], percent)]
            for width in np.unique(np.minimum(own[at], own[x])).tolist():
                some = at[np.minimum(own[at], own[x]) == width]
                differ = np.bitwise_count(words[width][some] ^ words[width][x]).sum(axis=1, dtype=np.int64)
                near = some[differ <= n[x] + n[some] - 2 * _sums_part(n[x], n[some], percent)]
                out += [(int(sig[y]), int(sig[x])) for y in near]
                free[near] = False
                queue += near.tolist()
    return out


def link(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """uid, doc_id, n_shingles, sig and root of every row of ``docs`` (uid, doc_id, text): equal roots, same component.

    ``docs`` is read three times. A text that is read again is known by a hash of it, and its set by its signature, so nothing hangs on the order or the
    split of the rows; uid is only passed on."""
    spark = docs.sparkSession
    docs = docs.select(F.col("uid").cast("long"), F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("hash"))

    def sketch(b, counts):
        for t in b.column(0).to_pylist():
            s = ngrams(t, k)
            counts += np.bincount((s >> np.uint64(44)).astype(np.int64), minlength=SKETCH).astype(np.int32) if len(s) > 200_000 else 0
            if len(s) <= 200_000:
                np.add.at(counts, (s >> np.uint64(44)).astype(np.int64), 1)

    counts = fixed_array(docs.select("text"), SKETCH, sketch)
    mean = float(counts.mean())
    usual = mean + 6 * mean**0.5 + 16
    # frequent places come last, by powers of two; the order is one for all sets, which is all that exactness needs
    level = np.where(counts <= usual, 0, np.ceil(np.log2(np.maximum(counts, 1) / usual)) + 1).astype(np.uint64)
    levels = spark.sparkContext.broadcast(level)

    def windowed(batches):
        only_cache("jaccard")
        lv = levels.value
        for b in batches:
            n, sig, keys, sketches = [], [], [], []
            for t in b.column(2).to_pylist():
                s = ngrams(t, k)
                n.append(len(s))
                sig.append(signature(s))
                order = np.lexsort((s, lv[(s >> np.uint64(44)).astype(np.int64)])) if len(s) else np.zeros(0, int)
                keys.append(s[order[: _window(len(s), percent)]].tobytes() if len(s) else b"")
                sketches.append(parity(s))
            yield pa.RecordBatch.from_pydict({"uid": b.column(0), "doc_id": b.column(1), "hash": b.column(3), "n_shingles": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.int64()), "keys": pa.array(keys, pa.binary()), "sketch": pa.array(sketches, pa.binary())})

    rows = scratch.save(docs.mapInArrow(windowed, "uid long, doc_id long, hash long, n_shingles long, sig long, keys binary, sketch binary"), "rows")

    def explode(batches):
        for b in batches:
            lengths = np.array([len(x) // 8 for x in b.column(1).to_pylist()], np.int64)
            flat = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.int64()), pa.array(np.repeat(b.column(0).to_numpy(), lengths), pa.int64())], names=["key", "sig"])

    # pivots of at least two members, and those of many
    all_keys = rows.select("sig", "keys").mapInArrow(explode, "key long, sig long")
    counted = all_keys.groupBy("key").agg(F.min("sig").alias("low"), F.max("sig").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("key", "n")
    counted = scratch.save(counted, "shared")
    bits, dense = spark.sparkContext.broadcast(bloom(counted, "key")), spark.sparkContext.broadcast(bloom(counted.where(F.col("n") >= DENSE), "key"))

    def replicate(batches):
        sent: set[int] = set()  # equal sets of a task go once
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                b = batch.slice(i, 1000)
                new = [k for k, x in enumerate(b.column(0).to_pylist()) if x not in sent and not sent.add(x)]
                if len(sent) > 1_000_000:
                    sent.clear()
                b = b.take(pa.array(new, pa.int64()))
                raw = b.column(1).to_pylist()
                lengths = np.array([len(x) // 8 for x in raw], np.int64)
                flat = np.frombuffer(b"".join(raw), np.int64)
                at = np.repeat(np.arange(len(raw)), lengths)
                pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                ok = np.flatnonzero(in_bloom(bits.value, flat))
                take = pa.array(at[ok])
                many = in_bloom(dense.value, flat[ok])
                sent_sketch = pa.array([folded(x, SENT) for x in b.column(3).to_pylist()], pa.binary())
                sketch = sent_sketch.take(pa.array(at[ok], pa.int64(), mask=~many))
                yield pa.RecordBatch.from_arrays([pa.array(flat[ok], pa.int64()), b.column(0).take(take), b.column(2).take(take).cast(pa.int32()), pa.array(pos[ok], pa.int32()), sketch], names=["key", "sig", "n", "pos", "sketch"])

    def regions(batches):
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            key, sig = t.column("key").to_numpy(), t.column("sig").to_numpy()
            n, pos = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "pos"))
            sketches = t.column("sketch").to_pylist()
            ends = [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            sure, pairs, a = [], [], 0
            for e in ends:
                if e - a > 1:
                    own = a + np.unique(sig[a:e], return_index=True)[1]
                    if sketches[a] is None:
                        pairs += region_pairs(sig[own], n[own], pos[own], percent)
                    elif len(own) > 1:
                        sure += region_edges(sig[own], n[own], pos[own], [sketches[i] for i in own], percent)
                a = e
            edges = [*sure, *pairs]
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64()), "sure": pa.array([True] * len(sure) + [False] * len(pairs), pa.bool_())})

        for b in batches:
            if b.num_rows:
                if held and held[-1].column(0)[-1] != b.column(0)[0]:
                    yield done(pa.Table.from_batches(held))
                    held = []
                key = b.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:  # all but the last key are complete
                    yield done(pa.Table.from_batches([*held, b.slice(0, cut)]))
                    held = []
                held.append(b.slice(cut))
        if held:
            yield done(pa.Table.from_batches(held))

    few = rows.where("n_shingles > 0").select("sig", "keys", F.col("n_shingles").alias("n"), "sketch").mapInArrow(replicate, "key long, sig long, n int, pos int, sketch binary")
    crowded = scratch.save(counted.where(F.col("n") > SPLIT).select("key"), "crowded")
    if crowded.take(1):
        few = few.join(crowded, "key", "left_anti").unionByName(_cut_up(scratch.save(few.join(crowded, "key"), "crowd"), percent, scratch))
    few = few.repartition(parallelism(spark), "key").sortWithinPartitions("key")
    found = scratch.save(few.mapInArrow(regions, "a long, b long, sure boolean").distinct(), "pairs")

    def near(batches):
        for b in batches:
            n_a, n_b = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            d = np.array([apart(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())], np.int64)
            yield b.select(["a", "b"]).filter(pa.array(d <= n_a + n_b - 2 * _sums_part(n_a, n_b, percent)))

    pairs = found.where("not sure").select("a", "b")
    asked = spark.sparkContext.broadcast(bloom(pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))), "sig"))

    def known(batches):
        for b in batches:
            yield b.filter(pa.array(in_bloom(asked.value, b.column(0).to_numpy().astype(np.int64))))

    sketched = rows.select("sig", F.col("n_shingles").alias("n"), "sketch").mapInArrow(known, "sig long, n long, sketch binary").groupBy("sig", "n").agg(F.first("sketch").alias("sketch"))
    left, right = (sketched.select(F.col("sig").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
    checked = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(near, "a long, b long")
    edges = found.where("sure").select("a", "b").unionByName(checked)
    bundles = scratch.save(components(edges, scratch, "outer").withColumnRenamed("node", "sig").withColumnRenamed("root", "bundle"), "bundles")
    out = confirm(docs, rows, bundles, k, percent, scratch)
    for name in ("shared", "crowded", "crowd", "crowds", "pairs", "bundles"):
        scratch.drop(name)
    return out


def confirm(docs: DataFrame, rows: DataFrame, bundles: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """uid, doc_id, n_shingles, sig and root of every row of ``rows``: the exact links inside bundles (sig, bundle), between which there are none.

    ``docs`` (hash, text) has the texts, ``rows`` (uid, doc_id, hash, n_shingles, sig) their sets' signatures."""
    spark = docs.sparkSession
    # one text of each member of a bundle is read again for its set
    members = rows.select("hash", "sig", "n_shingles").join(bundles, "sig").groupBy("sig", "bundle").agg(F.min("hash").alias("hash"), F.first("n_shingles").alias("n"))
    members = scratch.save(members, "members")
    wanted = spark.sparkContext.broadcast(bloom(members, "hash"))

    def sets(batches):
        sent: set[int] = set()  # equal texts of a task go once
        for b in batches:
            ok = np.flatnonzero(in_bloom(wanted.value, b.column(0).to_numpy().astype(np.int64)))
            new = [i for i, x in zip(ok.tolist(), b.column(0).take(pa.array(ok)).to_pylist()) if x not in sent and not sent.add(x)]
            if len(sent) > 1_000_000:
                sent.clear()
            found = [ngrams(t, k) for t in b.column(1).take(pa.array(new, pa.int64())).to_pylist()]
            yield pa.RecordBatch.from_pydict({"hash": b.column(0).take(pa.array(new, pa.int64())), "sig": pa.array(map(signature, found), pa.int64()), "grams": pa.array([x.tobytes() for x in found], pa.binary())})

    again = docs.where("text is not null").select("hash", "text").mapInArrow(sets, "hash long, sig long, grams binary")
    again = again.join(members.select("hash", "sig", "bundle"), ["hash", "sig"])
    large = members.groupBy("bundle").agg(F.sum(8 * F.col("n")).alias("bytes")).where(F.col("bytes") > LARGE)
    large = scratch.save(large.select("bundle"), "large")
    if large.take(1):
        again = scratch.save(again.dropDuplicates(["sig"]), "grams")
        small = _whole(again.join(large, "bundle", "left_anti"), ["bundle"], percent)
        links = _deal(again.join(large, "bundle"), percent, scratch).unionByName(small.where("a <> b"))
        links = components(links, scratch, "inner").withColumnRenamed("node", "sig").withColumnRenamed("root", "linked")
    else:
        links = _whole(again, ["bundle"], percent).select(F.col("a").alias("sig"), F.col("b").alias("linked"))
    links = scratch.save(links.where("sig <> linked"), "links")
    for name in ("members", "large", "grams"):
        scratch.drop(name)
    return _join_skewed(rows.select("uid", "doc_id", "n_shingles", "sig"), links, "sig").withColumn("root", F.coalesce("linked", "sig")).drop("linked")


def _cut_up(few: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Members of crowded regions in regions of ``SPLIT`` members or so, with a new key, so that all pairs that sizes allow are in one of them.

    Sizes of linked sets are in the same band or in neighbouring ones: a region takes two bands. One that is still larger is dealt into blocks."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) + 1e-9)) if percent < 100 else F.col("n").cast("long")
    banded = few.withColumn("band", F.explode(F.array(band, band + 1)))
    crowds = scratch.save(banded.groupBy("key", "band").agg(F.ceil(2 * F.count(F.lit(1)) / SPLIT).cast("int").alias("blocks")), "crowds")
    own = F.pmod(F.xxhash64("sig", F.lit(7)), F.col("blocks")).cast("int")
    met = banded.join(crowds, ["key", "band"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 or own <> other")
    return met.select(F.xxhash64("key", "band", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *(c for c in few.columns if c != "key"))


def _join_skewed(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Left join of rows with one value of each key. Keys of over ``1/HOT`` of the rows, less than ``HOT`` of them, are joined by broadcast."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("n") > 1)
    total = rows.count()
    hot = [r[0] for r in counts.where(F.col("n") > max(16, total / HOT)).select(key).collect()]
    if not hot:
        return rows.join(values, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(is_hot).join(F.broadcast(values.where(is_hot)), key, "left").unionByName(rows.where(~is_hot).join(values.where(~is_hot), key, "left"))


def _whole(grams: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(a, b): each member of a group (sig, grams) and its component's first."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("sig").sort_values("sig")
        sig = pdf["sig"].to_numpy()
        return pd.DataFrame({"a": sig, "b": sig[join_sets([np.frombuffer(x, np.uint64) for x in pdf["grams"]], percent)]})

    return grams.groupBy(*keys).applyInPandas(run, "a long, b long")


def measure(sig: np.ndarray, raw: list[bytes], pivot_sig: list[int], pivot_raw: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Members against pivots: distances [pivot, member], the window as a mask of the same shape, for each member the component of pivots
    that it is linked with (-1: none), and the links (member, pivot)."""
    radius = 1 - percent / 100 + 1e-9
    sets, pivots = [np.frombuffer(x, np.uint64) for x in raw], [np.frombuffer(x, np.uint64) for x in pivot_raw]
    size = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)

    def both(p: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(p, flat), len(p) - 1)
        return np.bincount(owner[p[at] == flat], minlength=len(sets))

    common = np.array([both(p) for p in pivots])
    union = np.array([[len(p)] for p in pivots]) + size[None, :] - common
    distance, linked = 1 - common / union, 100 * common >= percent * union
    among = Union(len(pivots))
    for i, p in enumerate(pivots):
        for j in range(i):
            n = len(np.intersect1d(p, pivots[j], assume_unique=True))
            if 100 * n >= percent * (len(p) + len(pivots[j]) - n):
                among.join(i, j)
    home = distance.argmin(axis=0)
    settled = np.where(linked.any(axis=0), among.roots()[linked.argmax(axis=0)], -1)
    links = [(int(sig[m]), pivot_sig[j]) for j, m in zip(*(x.tolist() for x in np.nonzero(linked)))]
    return distance, distance - distance[home, np.arange(len(sets))] <= 2 * radius, settled, links


def _deal(grams: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect each component of the members (bundle, sig, grams) of large bundles."""
    radius, spark = 1 - percent / 100 + 1e-9, grams.sparkSession
    work, links, k = grams.select(F.col("bundle").alias("region"), "sig", "grams", F.lit(None).cast("long").alias("before")), spark.createDataFrame([], "a long, b long"), 0

    def measured(members: pa.Table, pivots: pa.Table) -> pa.Table:
        out = {"region": [], "place": [], "sig": [], "grams": [], "settled": [], "distance": [], "link": []}
        if members.num_rows and pivots.num_rows:
            region, sig, raw = members["region"][0].as_py(), members["sig"].to_numpy(), members["grams"].to_pylist()
            distance, window, settled, found = measure(sig, raw, pivots["pivot_sig"].to_pylist(), pivots["pivot_grams"].to_pylist(), percent)
            place, at = np.nonzero(window)
            out = {
                "region": [region] * len(at) + [None] * len(found), "place": place.tolist() + [None] * len(found), "sig": sig[at].tolist() + [a for a, _ in found],
                "grams": [raw[i] for i in at.tolist()] + [None] * len(found), "settled": settled[at].tolist() + [None] * len(found),
                "distance": distance[place, at].tolist() + [None] * len(found), "link": [None] * len(at) + [b for _, b in found],
            }
        return pa.table(out, schema=pa.schema([("region", pa.int64()), ("place", pa.int32()), ("sig", pa.int64()), ("grams", pa.binary()), ("settled", pa.int32()), ("distance", pa.float64()), ("link", pa.int64())]))

    while True:
        loads = scratch.save(work.groupBy("region").agg(F.sum(F.octet_length("grams")).alias("bytes"), F.max("before").alias("before")), f"loads{k}")
        small = work.join(loads.where(F.col("bytes") <= LARGE).select("region"), "region", "left_semi")
        links = links.unionByName(scratch.save(_whole(small, ["region"], percent).where("a <> b"), f"small{k}"))
        large = loads.where(F.col("bytes") > LARGE)
        if not large.take(1):
            return links
        # regions that the last round left nearly as large: blocks of half the bound, each two in one task
        stuck = large.where(F.col("bytes") > 0.8 * F.col("before")).select("region", F.ceil(2 * F.col("bytes") / LARGE).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("sig", F.lit(3)), F.col("blocks")).cast("int")
        paired = work.join(stuck, "region").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        paired = paired.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other"))
        links = links.unionByName(scratch.save(_whole(paired.select("region", "one", "two", "sig", "grams"), ["region", "one", "two"], percent).where("a <> b"), f"stuck{k}"))
        # the others: a region's members in groups of bounded size, each with the region's pivots
        wide = large.where(F.col("before").isNull() | (F.col("bytes") <= 0.8 * F.col("before"))).select("region", "bytes", F.ceil(DEALT * F.col("bytes") / LARGE).cast("int").alias("groups"))  # a member may come out once for each pivot
        big = work.drop("before").join(wide, "region")
        first = Window.partitionBy("region").orderBy(F.xxhash64("sig", F.lit(k)), "sig")
        pivots = big.withColumn("at", F.row_number().over(first)).where(F.col("at") <= DEALT).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        members = big.withColumn("group", F.pmod(F.xxhash64("sig", F.lit(5)), F.col("groups")).cast("int")).select("region", "group", "sig", "grams")
        pivots = pivots.select(*(F.col(c).alias(f"pivot_{c}") for c in ("region", "group", "sig", "grams")))
        dealt = members.groupBy("region", "group").cogroup(pivots.groupBy("pivot_region", "pivot_group"))
        dealt = scratch.save(dealt.applyInArrow(measured, "region long, place int, sig long, grams binary, settled int, distance double, link long"), f"dealt{k}")
        links = links.unionByName(dealt.where("link is not null and sig <> link").select(F.col("sig").alias("a"), F.col("link").alias("b")))
        rows = dealt.where("link is null")
        # what is in a region: components of pivots, and the distances of members that are linked with no pivot
        open_at = F.when(F.col("settled") < 0, F.col("distance"))
        kinds = rows.groupBy("region", "place").agg(F.count_distinct(F.when(F.col("settled") >= 0, F.col("settled"))).alias("kinds"), F.min(open_at).alias("low"), F.max(open_at).alias("high"))
        kinds = kinds.where("kinds > 1 or low is not null")
        needed = (F.col("kinds") > 1) | (F.col("settled") < 0) | F.col("distance").between(F.col("low") - radius, F.col("high") + radius)
        left = rows.join(kinds, ["region", "place"]).where(needed).join(wide.select("region", "bytes"), "region")
        work = scratch.save(left.select(F.xxhash64("region", "place", F.lit(k)).alias("region"), "sig", "grams", F.col("bytes").alias("before")), f"work{k}")
        k += 1


def classes(linked: DataFrame) -> DataFrame:
    """uid, doc_id, n_shingles and component_id from ``link``."""
    least = linked.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    return _join_skewed(linked, least, "root").select("uid", "doc_id", "n_shingles", component)


def filter_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, the one with the least doc_id (null last), and of equal ones the first; rows with empty sets stay."""
    scratch, uid = Scratch(docs.sparkSession, "jaccard-filter"), fresh(docs.columns, "__uid")
    kept = scratch.save(docs.withColumn(uid, F.monotonically_increasing_id()), "docs")
    linked = link(kept.select(F.col(uid).alias("uid"), "doc_id", "text"), k, percent, scratch)
    first = linked.groupBy(F.when(F.col("n_shingles") > 0, F.col("root")), F.when(F.col("n_shingles") == 0, F.col("uid"))).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("x"))
    stay = first.select(F.col("x.uid").alias(uid))
    return kept.join(stay, uid, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.lit(0).alias("uid"), "doc_id", "text")
    scratch = Scratch(spark, "jaccard-join")
    return classes(scratch.save(link(docs, 4, 85, scratch), "linked")).select("doc_id", "n_shingles", "component_id")
