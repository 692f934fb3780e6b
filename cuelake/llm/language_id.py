"""Language identification by a byte convolutional network, trained and run in numpy.

A text is lower-cased, its ASCII digits and signs become spaces, and its UTF-8 bytes are cut into windows of ``WINDOW``
bytes (the last padded with zeros). Filters of ``WIDTHS`` bytes run over a window; each filter's largest value goes through a
rectifier and a linear layer to a softmax over the languages. A text's probabilities are the mean over all its windows, by their
letters.

Training takes about ``SAMPLE`` texts of each language (those whose hash of doc_id is below that language's share, at most twice
as many) and all windows of each; the bound on texts is a parameter. The driver gets one row for each language and the texts
chosen. Prediction takes every text whole, however long, in batches of windows of a fixed size.

Null text or text without a letter gives ``und`` with score 0; so does every text if there is nothing to learn from.
Rows with null doc_id or language aren't learned from. Repeated rows are predicted alike; of ties the first language wins. An empty table
gives an empty result. Columns named lang_pred or score are replaced, all others but text are kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read

WINDOW, WIDTHS, FILTERS, SAMPLE, BATCH = 128, (2, 3, 4), 16, 250, 1024
LETTER = re.compile(r"[^\W\d_]")
_PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def windows(text: str) -> np.ndarray:
    """(n, WINDOW) bytes of the whole text."""
    raw = text.lower().encode("utf-8", "replace").translate(_PLAIN)
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class Network:
    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        for f in self.filters:
            f[:, 0] = 0

    def pooled(self, x: np.ndarray, where: bool = False):
        """(n, filters) largest values; with ``where`` their places too."""
        values, places = [], []
        for f in self.filters:
            w = len(f)
            n = x.shape[1] - w + 1
            s = f[0][x[:, :n]]
            for k in range(1, w):
                s += f[k][x[:, k : k + n]]
            if where:
                at = s.argmax(axis=1)
                places.append(at)
                values.append(np.take_along_axis(s, at[:, None], 1)[:, 0])
            else:
                values.append(s.max(axis=1))
        return values, places

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        values, _ = self.pooled(x)
        h = np.maximum(np.concatenate([v + b for v, b in zip(values, self.bias)], 1), 0)
        z = h @ self.out + self.out_bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, rate: float = 0.01, batch: int = 64) -> None:
        """Adam on the cross-entropy; only the places that won the pooling get gradients."""
        rng = np.random.default_rng(3)
        params = [*self.filters, *self.bias, self.out, self.out_bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
                values, places = self.pooled(xb, True)
                h0 = np.concatenate([a + b for a, b in zip(values, self.bias)], 1)
                h = np.maximum(h0, 0)
                z = h @ self.out + self.out_bias
                e = np.exp(z - z.max(axis=1, keepdims=True))
                d = e / e.sum(axis=1, keepdims=True)
                d[np.arange(len(yb)), yb] -= 1
                d /= len(yb)
                back = (d @ self.out.T) * (h0 > 0)
                grads, rows = [], np.arange(len(xb))[:, None]
                for k, f in enumerate(self.filters):
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    g = np.zeros_like(f)
                    for j in range(len(f)):
                        np.add.at(g[j], (xb[rows, places[k] + j], np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
                grads += [h.T @ d, d.sum(axis=0)]
                t += 1
                for p, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.languages:
            return out
        todo = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        sums = np.zeros((len(texts), len(self.languages)))
        pending, owners, n = [], [], 0

        def flush() -> None:
            x, of = np.concatenate(pending), np.repeat(owners, [len(p) for p in pending])
            for i in range(0, len(x), BATCH):
                part = x[i : i + BATCH]
                letters = ((part != 32) & (part != 0)).sum(axis=1)[:, None] + 1e-3
                np.add.at(sums, of[i : i + BATCH], self.probabilities(part) * letters)

        for i in todo:
            pending.append(windows(texts[i]))
            owners.append(i)
            n += len(pending[-1])
            if n >= 8 * BATCH:
                flush()
                pending, owners, n = [], [], 0
        if pending:
            flush()
        for i in todo:
            p = sums[i] / sums[i].sum()
            k = int(p.argmax())
            out[i] = (self.languages[k], float(min(1.0, p[k])))
        return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """Trains on ``docs`` (doc_id, text, lang)."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Network([])
    place = (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("place")
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, sample / counts[lang]))))
    # of rows with the same doc_id all or none are chosen, so a language may have more than its share: then those with the least hashes are taken
    least = Window.partitionBy("lang").orderBy("place", "doc_id", "hash")
    chosen = known.select("*", place, F.xxhash64("text").alias("hash")).where(F.col("place") < share[F.col("lang")])
    chosen = chosen.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= 2 * sample)

    def run(batches):
        for b in batches:
            langs, ranks, raws = [], [], []
            for lang, rank, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if LETTER.search(text):
                    langs.append(lang), ranks.append(rank), raws.append(windows(text).tobytes())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "rank": pa.array(ranks, pa.int32()), "raw": pa.array(raws, pa.binary())})

    got = chosen.select("lang", "rank", "text").mapInArrow(run, "lang string, rank int, raw binary").toArrow().sort_by([("rank", "ascending"), ("lang", "ascending")])
    net = Network(languages)
    raws = [np.frombuffer(r, np.uint8).reshape(-1, WINDOW) for r in got["raw"].to_pylist()]
    if raws:
        y = np.repeat([languages.index(x) for x in got["lang"].to_pylist()], [len(r) for r in raws])
        net.train(np.concatenate(raws), y)
    return net


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with lang_pred and score (columns of those names are replaced); ``text`` is read and dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    schema = docs.select(*(F.col(f"`{c}`") for c in rest), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches):
        for b in batches:
            found = shared.value.predict(b.column(len(rest)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=[*rest, "lang_pred", "score"])

    return docs.select(*(F.col(f"`{c}`") for c in rest), F.col("text").cast("string")).mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    net = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), net)
