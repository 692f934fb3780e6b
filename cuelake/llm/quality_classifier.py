"""Quality classifier: naive Bayes support vectors over n-gram indicators.

The features of a text are the n-grams it has at least once: its words, and runs of one to four word shapes (letters, capitals,
digits and other signs in their order, each run of one kind cut short; marked if the word equals the one before it).
They are hashed to ``2 ** BITS`` places. A place's log-count ratio between the classes scales its indicator, and
a linear model with hinge loss is fitted to the scaled indicators by dual coordinate descent, then calibrated by a
logistic curve to the share of the classes among all labels.

Fitting takes at most ``SAMPLE`` labelled texts of each class, those with the smallest hash of doc_id; the labels chosen are
broadcast (their number is bounded), so the texts of other documents are not shuffled. Of documents with the same doc_id one teaches, the
one whose text has the least hash, so the driver gets at most ``2 * SAMPLE`` sets of places. Scoring takes every text whole, however long.

Null or empty text has the feature "empty" alone. Rows with null doc_id or null label aren't learned from, but are
scored. A label that is given twice counts once; a doc_id with both labels teaches both. Without labels of both classes the score is the
smoothed share of label 1. Repeated rows are scored alike. An empty table gives an empty result. A column named like the score is replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, only_cache, read

BITS, SAMPLE, SHAPES = 18, 2500, 4096
#: Words that a worker keeps the features of.
KEEP = 400_000
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def shape(word: str) -> str:
    """Lower-case runs to ``a``, capitals to ``A`` (one) or ``AA`` (more), digits to ``0``; other signs at most twice."""
    out, last = [], ""
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if k == last and (k in "a0" or len(out) > 1 and out[-2] == k):
            continue
        out.append(k)
        last = k
    return "".join(out)


class _Words(dict):
    """Word to (hash << 12 | shape), filled as words come."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEEP:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        out = self[word] = (zlib.crc32(raw) << 12) | (zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % SHAPES)
        return out


_words = _Words()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct places of the text's n-grams."""
    ids = np.array(list(map(_words.__getitem__, SPLIT.findall(text or ""))), np.uint64)
    if not len(ids):
        return np.zeros(1, np.int64)
    tokens = (ids & np.uint64(SHAPES - 1)) << np.uint64(1)
    tokens[1:] |= (ids[1:] == ids[:-1]).astype(np.uint64)
    codes = [(ids >> np.uint64(12)) | np.uint64(1 << 62)]
    run = tokens.copy()
    for n in range(4):
        codes.append(run | np.uint64(n << 60))
        if len(run) < 2:
            break
        run = (run[:-1] << np.uint64(13)) | tokens[n + 1 :]
    mixed = np.concatenate(codes) * np.uint64(0x9E3779B97F4A7C15)
    places = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
    return np.unique(np.maximum(places, np.uint64(1))).astype(np.int64)  # place 0: empty


class Model:
    """weights of places, and the calibration's slope and offset; a constant score where there was nothing to learn."""

    def __init__(self, weights: np.ndarray | None, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def score(self, places: np.ndarray) -> float:
        m = 0.0 if self.weights is None else float(self.weights[places].sum(dtype=np.float64)) / np.sqrt(len(places)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30))))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 12) -> np.ndarray:
    """Dual coordinate descent for the linear hinge-loss model; each row's cost bounds its dual variable."""
    w, alpha, rng = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(5)
    norms = np.array([float(v @ v) for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if norms[i] == 0:
                continue
            g = y[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def fit(rows: list[np.ndarray], labels: list[int], share: float) -> Model:
    """``rows``: places of each text; ``share``: of label 1 among all labels."""
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    if len(set(labels)) < 2:
        return Model(None, 0.0, 0.0, float(np.log(share / (1 - share))))
    size = 1 << BITS
    counts = {}
    for sign in (1.0, -1.0):
        counts[sign] = np.bincount(np.concatenate([r for r, s in zip(rows, y) if s == sign]), minlength=size) + 1.0
    n_pos, n_neg = (y > 0).sum() + 2.0, (y < 0).sum() + 2.0
    ratio = np.log((counts[1.0] / n_pos) / (counts[-1.0] / n_neg))
    ratio[(counts[1.0] + counts[-1.0]) < 4] = 0.0  # met once: no evidence
    bias_place = size
    idx = [np.append(r, bias_place) for r in rows]
    values = [np.append(ratio[r] / np.sqrt(len(r)), 1.0) for r in rows]
    weight = {1.0: share / (n_pos / len(y)), -1.0: (1 - share) / (n_neg / len(y))}
    w = descend(idx, values, y, np.array([min(4.0, max(0.25, weight[s])) for s in y]), size + 1)
    weights, bias = (w[:-1] * ratio).astype(np.float32), float(w[-1])
    margins = np.array([weights[r].sum(dtype=np.float64) / np.sqrt(len(r)) + bias for r in rows])
    a, b, target, c = 2.0, 0.0, (y > 0).astype(float), np.array([weight[s] for s in y])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = c * (p - target), c * np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(h * margins**2).sum() + 1.0, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([(d * margins).sum() + (a - 2.0), d.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return Model(weights, bias, float(max(a, 0.1)), float(b))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits to ``labels`` (doc_id, ``label`` 0/1), texts from ``docs`` (doc_id, text)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # the map side keeps one text of each label; a doc_id of many rows stays one row
    joined = joined.groupBy("y", "doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches):
        only_cache("words", _words.clear)
        for b in batches:
            yield pa.RecordBatch.from_pydict({
                "y": pa.array(b.column(0).to_pylist(), pa.int32()),
                "doc_id": pa.array(b.column(1).to_pylist(), pa.int64()),
                "places": pa.array([features(t).astype("<i4").tobytes() for t in b.column(2).to_pylist()], pa.binary()),
            })

    got = joined.select("y", "doc_id", "text").mapInArrow(run, "y int, doc_id long, places binary").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    rows = [np.frombuffer(x, "<i4").astype(np.int64) for x in got["places"].to_pylist()]
    return fit(rows, got["y"].to_pylist(), share)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``column``, as the last column; one of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS floats
    docs = docs.drop(column)
    at, names = docs.columns.index("text"), [*docs.columns, column]

    def run(batches):
        only_cache("words", _words.clear)
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.score(features(t)) for t in b.column(at).to_pylist()], pa.float64())], names=names)

    return docs.mapInArrow(run, docs.withColumn(column, F.lit(0.0)).schema)


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def filter_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier scores 0.5 or more, with the columns of ``docs``."""
    labels = read(spark, sf_dir, "labels").where(~held_out())
    name = fresh(docs.columns, "__quality_score")
    scored = score(docs, train(read(spark, sf_dir, "documents"), labels), name)
    return scored.where(F.col(name) >= 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels").where(~held_out())))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
