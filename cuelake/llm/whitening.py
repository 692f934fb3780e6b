"""Embedding whitening from an exact scatter matrix in residue numbers.

Entries become whole numbers, ``floor(1024 * c) + 100000``. A first pass gives their exact sums, smallest and largest values by dimension. Centred by the
whole part of their mean, the vectors of each task are multiplied with themselves modulo several primes: residues are below ``2 ** 20``, so a
double holds the products of a block of rows without rounding, and a GEMM gives them. Sums of residues over all tasks are reduced by Spark, and the Chinese
remainder theorem turns them into the exact scatter; there are as many primes as its largest possible entry needs. Covariance follows
in whole numbers and is rounded once, to doubles, for ``eigh``.

The driver gets one number for each prime and pair of dimensions, whatever the number of rows. Nothing is written between: a lost task reads its rows again,
and sums of residues don't hang on the order of tasks.

Null vectors, and vectors with null or non-finite entries, are left out. So are vectors that aren't as long as most of the table's (ties: the longer),
and vectors without entries. Products ``1024 * c`` are held within ``2 ** 52``. Null or repeated ids count as rows of their own. Components whose variance is below
``1e-10`` of the largest one's are rounding and are left out: vectors that are all equal have none, and give no rows. An empty table gives an empty result. Other
columns are kept by ``Whitening.transform``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import fresh, read

#: Residues are below this power of two; a block has as many rows as keep sums of products below 2 ** 53.
PRIME_BITS, BLOCK = 20, 8192
SCALE, SHIFT, MOST = 1024, 100_000, float(1 << 52)
#: Least share of the largest variance that counts as one.
LEAST = 1e-10


def primes(product: int) -> list[int]:
    """The largest primes below ``2 ** PRIME_BITS``, two or more, so many that their product is larger than ``product``."""
    out, p, total = [], 1 << PRIME_BITS, 1
    while total <= product or len(out) < 2:
        p -= 1
        if p < 2:
            raise ValueError("entries too large")
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            out.append(p)
            total *= p
    return out


def reconstruct(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Whole numbers (object array) from rows of residues, one row a modulus, each number the one nearest zero."""
    total = math.prod(moduli)
    out = np.zeros(residues.shape[1:], object)
    for r, p in zip(residues, moduli):
        rest = total // p
        out = out + r.astype(object) * (rest * pow(rest, -1, p))
    out = out % total
    return np.where(out > total // 2, out - total, out)


def vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a batch that count, as whole numbers, and their places."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    c = flat.to_numpy(zero_copy_only=False).reshape(len(at), dims)  # nulls become nan
    finite = np.isfinite(c).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(SCALE * c[finite]), -MOST, MOST)
    return x.astype(np.int64) + SHIFT, at[finite]


def residue_scatter(z: np.ndarray, moduli: list[int]) -> np.ndarray:
    """``z.T @ z`` modulo each prime, exact: [prime, dim, dim]."""
    out = np.zeros((len(moduli), z.shape[1], z.shape[1]), np.int64)
    for first in range(0, len(z), BLOCK):
        block = z[first : first + BLOCK]
        for k, p in enumerate(moduli):
            r = np.mod(block, p).astype(np.float64)
            out[k] = (out[k] + (r.T @ r).astype(np.int64) % p) % p
    return out


@dataclass
class Whitening:
    """Fitted to ``n`` vectors: the sums by dimension, variances of the components, largest first, the components as columns, and the trace."""

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.variances]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Whitened vectors, and for each the exact sum of ``(n * x - S) ** 2``."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        z = x - whole
        white = (z - rest / self.n) @ (self.components / np.sqrt(self.variances))
        span = int(np.abs(z).max()) if z.size else 0
        if len(whole) * (self.n * (span + 1)) ** 2 < 1 << 63:
            far = ((self.n * z - rest) ** 2).sum(axis=1).tolist()
        else:
            far = ((self.n * z.astype(object) - rest.astype(object)) ** 2).sum(axis=1).tolist()
        return white, far

    def transform(self, table: DataFrame, vector: str = "embedding", prefix: str = "white_") -> DataFrame:
        """The rows whose vector counts, with ``{prefix}whitened`` array<double> and ``{prefix}deviation`` long (null if it doesn't fit); ``prefix`` is made longer until no column begins with it."""
        model, at, dims, prefix = self, table.columns.index(vector), len(self.sums), fresh(table.columns, prefix)
        names = [f"{prefix}whitened", f"{prefix}deviation"]

        def run(batches) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, places = vectors(b.column(at), dims)
                white, far = model(x)
                offsets = pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32())
                own = b.take(pa.array(places))
                columns = [pa.ListArray.from_arrays(offsets, pa.array(white.ravel())), pa.array([v if v < 1 << 63 else None for v in far], pa.int64())]
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=[*b.schema.names, *names])

        return table.mapInArrow(run, StructType([*table.schema.fields, StructField(names[0], ArrayType(DoubleType())), StructField(names[1], LongType())]))

    def identity_error(self, table: DataFrame, vector: str = "embedding") -> float:
        """Largest absolute entry of the covariance of the whitened vectors of ``table`` minus the identity."""
        model, dims, k = self, len(self.sums), len(self.variances)
        if not k:
            return 0.0
        i, j = np.triu_indices(k)

        def run(batches) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + k + len(i))
            for b in batches:
                white = model(vectors(b.column(0), dims)[0])[0]
                total += np.concatenate([[len(white)], white.sum(axis=0), (white.T @ white)[i, j]])
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total)), pa.int32()), "v": pa.array(total)})

        sums = dict(table.select(F.col(f"`{vector}`")).mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v")).collect())
        n, mean = sums[0], np.array([sums[1 + c] for c in range(k)]) / sums[0]
        covariance = np.array([sums[1 + k + c] for c in range(len(i))]) / n - mean[i] * mean[j]
        return float(np.abs(covariance - (i == j)).max())


def fit(table: DataFrame, vector: str = "embedding", components: int | None = None) -> Whitening | None:
    """Whitening of all vectors of ``table`` that count, by at most ``components`` of the largest components; None if no vector counts."""
    found = table.select(F.col(f"`{vector}`").alias("v"))
    size = found.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).where("dims > 0").orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not size:
        return None
    dims = size[0]["dims"]

    def sums(batches) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        least, most = np.full(dims, 2**62), np.full(dims, -(2**62))
        for b in batches:
            x, _ = vectors(b.column(0), dims)
            if len(x):
                n, high, low = n + len(x), high + (x >> 26).sum(axis=0), low + (x & (2**26 - 1)).sum(axis=0)
                least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(dims), pa.int32()), "n": pa.array([n] * dims, pa.int64()), "high": high, "low": low, "least": least, "most": most})

    rows = found.mapInArrow(sums, "dim int, n long, high long, low long, least long, most long").groupBy("dim").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("dim").collect()
    if not rows:
        return None
    n, total = rows[0]["n"], [(r["high"] << 26) + r["low"] for r in rows]
    whole = [s // n for s in total]
    span = max(max(r["most"] - w, w - r["least"]) for r, w in zip(rows, whole))
    moduli, centre = primes(2 * n * span * span + 1), np.array(whole, np.int64)
    i, j = np.triu_indices(dims)

    def scatter(batches) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(moduli), dims, dims), np.int64)
        for b in batches:
            out += residue_scatter(vectors(b.column(0), dims)[0] - centre, moduli)
            out %= np.array(moduli)[:, None, None]
        for k in range(len(moduli)):
            yield pa.RecordBatch.from_pydict({"prime": pa.array(np.full(len(i), k), pa.int32()), "at": pa.array(np.arange(len(i)), pa.int32()), "v": out[k][i, j]})

    residues = np.zeros((len(moduli), len(i)), object)
    for r in found.mapInArrow(scatter, "prime int, at int, v long").groupBy("prime", "at").agg(F.sum("v").alias("v")).collect():
        residues[r["prime"], r["at"]] = r["v"]
    exact, rest = reconstruct(residues, moduli), [s - n * w for s, w in zip(total, whole)]
    scaled = [n * z - rest[a] * rest[b] for z, a, b in zip(exact.tolist(), i.tolist(), j.tolist())]  # n * n times the covariance
    covariance = np.zeros((dims, dims))
    covariance[i, j] = covariance[j, i] = [s / (n * n) for s in scaled]
    trace = sum(s for s, a, b in zip(scaled, i.tolist(), j.tolist()) if a == b) / (n * n)
    e, u = np.linalg.eigh(covariance)
    keep = [k for k in reversed(range(dims)) if e[k] > LEAST * e[-1]][:components]
    u = u[:, keep]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(len(keep))] < 0, -1.0, 1.0)  # either sign would do
    return Whitening(n, total, e[keep], u, trace)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(table, components=8)
    if model is None or not len(model.variances):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = model.transform(table).select("vec_id", F.col("white_deviation").alias("deviation"), F.posexplode("white_whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*(F.lit(x) for x in model.explained)), F.col("at") + 1)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error(table)).alias("identity_error"))
