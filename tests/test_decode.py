"""Sampling, small floats, settings and files against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.operators import decode


def plain_chain(logits, history, u, temperature, k, p, least, bias, last, repeat, frequency, presence):
    x = [v + bias.get(i, 0.0) for i, v in enumerate(logits)]
    for t in set(history[-last:]):
        n = history[-last:].count(t)
        x[t] = (x[t] / repeat if x[t] > 0 else x[t] * repeat) - n * frequency - presence
    best = sorted(range(len(x)), key=lambda i: (-x[i], i))[:k]
    mass, total, kept = 0.0, sum(math.exp(x[i] - x[best[0]]) for i in best), []
    for i in best:
        if mass < p * total:
            kept.append(i)
        mass += math.exp(x[i] - x[best[0]])
    kept = [i for i in kept if x[i] >= x[best[0]] + math.log(least)]
    weights = [math.exp((x[i] - x[best[0]]) / temperature) for i in kept]
    at, upto = u * sum(weights), 0.0
    for i, w in zip(kept, weights):
        upto += w
        if upto > at:
            return i
    return kept[-1]


def test_chain_as_plain(spark):
    r = random.Random(1)
    rows = [(s, [r.gauss(0, 3) for _ in range(30)], [r.randrange(30) for _ in range(r.randrange(12))]) for s in range(60)]
    how = dict(temperature=0.7, k=12, p=0.85, last=6, repeat=1.2, frequency=0.3, presence=0.2)
    df = spark.createDataFrame(rows, "step int, logits array<double>, history array<int>")
    got = df.select("step", decode.place_in_unit(F.col("step"), 5).alias("u"), decode.sample(F.col("logits"), F.col("step"), history=F.col("history"), bias={3: 2.0}, least=0.1, seed=5, **how).alias("token")).collect()
    by = {r["step"]: r for r in got}
    for step, logits, history in rows:
        assert 0 <= by[step]["u"] < 1
        assert by[step]["token"] == plain_chain(logits, history, by[step]["u"], least=0.1, bias={3: 2.0}, **how)


def test_greedy_ties_and_odd_logits(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0],), ([None, float("nan"), -5.0],), ([],), (None,)], "x array<double>")
    assert [r[0] for r in df.select(decode.sample(F.col("x"), F.lit(0), temperature=0)).collect()] == [1, 2, None, None]
    assert [r[0] for r in df.select(decode.sample(F.col("x"), F.lit(0), p=0.5, least=0.5)).collect()][2:] == [None, None]
    assert [r[0] for r in df.select(decode.sample(F.col("x"), F.lit(0), temperature=0, low=2, allow=(0,))).collect()] == [2, 2, None, None]


@pytest.mark.parametrize("exponent,mantissa", [(5, 10), (8, 7)])
def test_small_floats(spark, exponent, mantissa):
    got = spark.range(65536).select("id", decode.small_float(F.col("id").cast("int"), exponent, mantissa).alias("x")).toPandas().sort_values("id")["x"].to_numpy()
    bits = np.arange(65536, dtype=np.uint16)
    want = bits.view(np.float16) if mantissa == 10 else (bits.astype(np.uint32) << 16).view(np.float32)
    np.testing.assert_array_equal(got, want.astype(np.float64))


def test_positions(spark):
    df = spark.createDataFrame([(5, []), (5, [(1, 2)]), (3, [(1, 4)]), (0, [])], "n long, spans array<struct<offset:int,length:int>>")
    got = [r[0] for r in df.select(decode.positions(F.col("n"), F.col("spans"))).collect()]
    assert [(list(g["positions"]), g["delta"]) for g in got] == [([0, 1, 2, 3, 4], 0), ([0, 1, 2, 3, 4], 0), ([0, 1, 2, 3, 4], 2), ([], 0)]


def test_files_settings_groups(spark):
    paths = [("a/model/x.txt", True), ("a/model/x.TXT", True), ("a/model/x.gguf", False), ("a/model/.txt", False), ("model/a.b/x", False), ("a/.git/x.txt", False), ("src/x.py", True), ("models/x.bin", True), (None, True)]
    df = spark.createDataFrame(paths, "path string, want boolean")
    assert [r[0] for r in df.select(decode.released(F.col("path"))).collect()] == [w for _, w in paths]
    saved = [('{"a": "2", "z": 1}', {"a": "2", "b": "x", "z": "1"}), ("[1]", {"a": "1", "b": "x"}), ("{broken", {"a": "1", "b": "x"}), (None, {"a": "1", "b": "x"})]
    df = spark.createDataFrame([(s,) for s, _ in saved], "s string")
    assert [dict(r[0]) for r in df.select(decode.settings(F.col("s"), {"a": "1", "b": "x"})).collect()] == [w for _, w in saved]
    names = [("blk.3.attn.weight", "blk.3"), ("enc.blk.0.w", "enc.blk.0"), ("dec.norm", "dec"), ("encoder.x", "base"), ("output.weight", "base"), (None, "base")]
    df = spark.createDataFrame(names, "name string, want string")
    assert [r[0] for r in df.select(decode.tensor_group(F.col("name"))).collect()] == [w for _, w in names]
