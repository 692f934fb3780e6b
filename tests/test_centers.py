from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.operators import diarize


@pytest.mark.parametrize("most", [50_000, 7, 1])
def test_nearest_in_blocks(spark, most):
    r = np.random.default_rng(1)
    x, c = r.normal(size=(60, 4)), r.normal(size=(12, 4))
    c[5] = 2 * c[3]  # a tie: the smaller label wins
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    centers = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(c)], "label int, center array<double>")
    got = {q["id"]: q["nearest"] for q in diarize.nearest(vectors, "id", "v", centers, most).collect()}
    cosine = x @ c.T / np.linalg.norm(c, axis=1)
    cosine[:, 5] = cosine[:, 3]
    assert got == {i: int(np.argmax(np.round(row, 9))) for i, row in enumerate(cosine)}


def test_usable_speakers_have_numbers(spark):
    frames = spark.createDataFrame([(0, s, f, 1 if f % 2 == s else 0) for s in (0, 1) for f in range(4)], "chunk int, spk int, frame int, active int")
    vectors = spark.createDataFrame([(0, 0, [1.0, float("nan")]), (0, 1, [1.0, 2.0])], "chunk int, spk int, embedding array<double>")
    assert sorted(r["spk"] for r in diarize.usable(frames, ["chunk"], "frame", "spk").collect()) == [0, 1]
    assert [r["spk"] for r in diarize.usable(frames, ["chunk"], "frame", "spk", vectors=vectors).collect()] == [1]
    odd = spark.createDataFrame([([1.0, None],), (None,), ([],), ([float("inf")],)], "v array<double>")
    assert [r[0] for r in odd.select(diarize.whole(F.col("v"))).collect()] == [False, False, True, True]
