"""Clustering, frames, models with stand-ins, traces, stream joins, and names for SQL."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.functions import audio, decoding, register
from cuelake.operators import align, chunks, cluster, frames, models, numeric
from cuelake.sources import trace
from cuelake.streaming import joins

SF = "/root/testdata/sf0.001"


def slow_linkage(x: np.ndarray) -> list[float]:
    """Distances of merges, with all distances worked out anew for each."""
    groups, out = [[i] for i in range(len(x))], []
    while len(groups) > 1:
        centers = [x[g].mean(axis=0) for g in groups]
        d, i, j = min((float(np.linalg.norm(centers[i] - centers[j])), i, j) for j in range(len(groups)) for i in range(j))
        out.append(d)
        groups[i] += groups.pop(j)
    return out


def test_linkage_is_brute_force():
    for seed in range(6):
        x = np.random.default_rng(seed).normal(size=(25, 4))
        merges, d = cluster.linkage(x)
        assert np.allclose(d, slow_linkage(x)) and merges[-1, 2] == 25


def test_clusters_and_their_number():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(30, 8)) * 0.05 + c for c in np.eye(8)[:4]])
    assert cluster.agglomerate(x).tolist() == [i // 30 for i in range(120)]
    assert len(set(cluster.agglomerate(x, wanted=2).tolist())) == 2 and len(set(cluster.agglomerate(x, most=3).tolist())) == 3
    assert len(set(cluster.agglomerate(np.concatenate([x, -np.eye(8)[7:]])).tolist())) == 4  # a small one joins a large one
    assert cluster.agglomerate(np.zeros((0, 3))).tolist() == [] and cluster.agglomerate(np.ones((1, 3))).tolist() == [0]
    assert cluster.agglomerate(np.ones((40, 3))).tolist() == [0] * 40


def test_frames(spark):
    d = spark.createDataFrame([(0, 0, f, a, b) for f, (a, b) in enumerate([(1, 0), (1, 1), (1, 0), (0, 1), (1, 0)])], "chunk int, x int, frame int, a int, b int")
    f = d.select("chunk", F.lit(0).alias("spk"), "frame", F.col("a").alias("active")).unionByName(d.select("chunk", F.lit(1).alias("spk"), "frame", F.col("b").alias("active")))
    used = {(r["spk"], r["frame"]): r["used"] for r in frames.embedding_mask(f, ["chunk"], "frame", "spk", 1).collect()}
    assert [used[0, k] for k in range(5)] == [1, 0, 1, 0, 1] and [used[1, k] for k in range(5)] == [0, 1, 0, 1, 0]  # the second has one clean frame: all of its are used
    spans = frames.active_spans(f.where("spk = 0"), ["spk"], "frame", "active", 10, 6)
    assert sorted((r["start"], r["end"]) for r in spans.collect()) == [(3, 33)]  # the last frame alone has no length
    scores = spark.createDataFrame([(0, 0, 1.0), (0, 1, float("nan")), (1, 0, 3.0), (1, 1, None)], "chunk int, frame int, s double")
    got = {r["at"]: r["value"] for r in frames.overlap_add(scores.withColumn("k", F.lit(0)), ["k"], "chunk", "frame", "s", 1.0, 1.0, missing=-2.0).collect()}
    assert got == {0: 1.0, 1: 3.0, 2: -2.0}
    up = spark.range(1).select(frames.upsample(F.array(F.lit(1), F.lit(2), F.lit(3)), 7).alias("u"), frames.upsample(F.array(F.lit(5)), 1).alias("same")).first()
    assert up["u"] == [1, 1, 1, 2, 2, 3, 3] and up["same"] == [5]
    with pytest.raises(Exception, match="least number"):
        spark.range(1).select(frames.cluster_bounds(F.lit(9), F.lit(None).cast("int"), F.lit(5), F.lit(2))[2]).collect()


def test_spread_and_timestamps(spark):
    given = spark.createDataFrame([(1, 0, "a"), (2, 0, "a"), (2, 1, "b")], "k int, i int, v string")
    batches = spark.createDataFrame([(1, 3), (2, 2)], "k int, n int")
    assert sorted(tuple(r) for r in chunks.spread(given, batches, "k", "i", "v").collect()) == [(1, 0, "a"), (1, 1, "a"), (1, 2, "a"), (2, 0, "a"), (2, 1, "b")]
    with pytest.raises(Exception, match="batch size mismatch"):
        chunks.spread(given, spark.createDataFrame([(2, 3)], "k int, n int"), "k", "i", "v").collect()
    from cuelake.plans import registry

    got: dict = {}
    for r in registry.queries()["parse_timestamps"](spark, SF).collect():
        got.setdefault((r["rec_id"], r["pos"]), []).append((r["start_ms"], r["end_ms"]))
    assert all(a <= b for spans in got.values() for a, b in spans) and all(x[1] <= y[0] for spans in got.values() for x, y in zip(spans, spans[1:]))


def test_fix_timestamps_keeps_the_longest_run():
    r = random.Random(4)
    for _ in range(200):
        v = [r.randrange(25) for _ in range(r.randint(1, 40))]
        best = [1] * len(v)
        before = [-1] * len(v)
        for i in range(len(v)):
            for j in range(i):
                if v[j] <= v[i] and best[j] + 1 > best[i]:
                    best[i], before[i] = best[j] + 1, j
        k, fixed = best.index(max(best)), align.fix_timestamps(v)
        while k >= 0:
            assert fixed[k] == v[k]
            k = before[k]
        assert fixed == sorted(fixed)


def test_percentile(spark):
    r = random.Random(5)
    rows = [(k, None if r.random() < 0.05 else float(r.choice([r.randrange(5), r.gauss(0, 9)]))) for k in (1, 2, None) for _ in range({1: 7, 2: 30_000, None: 1500}[k])]
    d = spark.createDataFrame([*rows, (9, None), (8, 4.0)], "k int, v double")
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {x["k"]: (x["percentile"], x["n"]) for x in numeric.exact_percentile(d, "k", "v", share).collect()}
        for k in (1, 2, None):
            want = np.percentile([v for key, v in rows if key == k and v is not None], 100 * share)
            assert got[k][0] == pytest.approx(want) and got[k][1] == sum(key == k for key, _ in rows)
        assert got[9] == (None, 1) and got[8] == (4.0, 1)


def test_models(spark):
    d = spark.createDataFrame([("x",), (None,)], "t string")
    assert [r["u"] for r in models.apply_model(d, "t", "u", models.identity, name="same").collect()] == ["x", None]
    one, two = ({r["u"] for r in models.apply_model(d, "t", "u", lambda k=k: lambda xs: [k] * len(xs), name=k).collect()} for k in ("one", "two"))
    assert one == {"one"} and two == {"two"}
    with pytest.raises(Exception, match="no model"):
        models.apply_model(d, "t", "u").collect()


def test_rollback():
    text = lambda t: bytes(t).decode("utf-8", "replace")
    assert decoding.rollback([65, 66, 67], 2, text) == [65] and decoding.rollback([65, 66], 5, text) == []
    assert decoding.rollback([65, 66], 5, text, finish=True) == [65] and decoding.rollback([], 2, text, finish=True) == []


def test_signals():
    x = 0.3 * np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    mel = audio.log_mel(x)
    assert mel.shape == (128, 100) and mel.dtype == np.float32 and mel.max() - mel.min() <= 2.0 + 1e-6
    centers = audio.slaney_filters(128, 400, 16_000) @ np.arange(201)
    loudest = int(mel[:, 50].argmax())
    assert abs(centers[loudest] / audio.slaney_filters(128, 400, 16_000)[loudest].sum() * 40 - 440) < 45


def test_samples_of_all_kinds(spark):
    d = spark.createDataFrame([([-32768, 0, 32767], [0, 128, 255], [2.0, -4.0, 0.0, 1.0, 9.0], [0.5, -0.25]), ([], [], [], [])], "i array<int>, u array<int>, f array<double>, g array<float>")
    d = d.toDF("a", "b", "c", "e")
    got = d.select(audio.from_integers(F.col("a")).alias("i"), audio.from_integers(F.col("b"), 8, signed=False).alias("u"), audio.from_floats(F.col("c"), 2).alias("f"), audio.from_floats(F.col("e")).alias("g"), audio.from_integers(F.col("a"), 16, channels=2).alias("two")).collect()
    assert got[0]["i"] == pytest.approx([-1, 0, 32767 / 32768]) and got[0]["u"] == pytest.approx([-1, 0, 127 / 128])
    assert got[0]["f"] == pytest.approx([-1 / 9, 0.5 / 9]) and got[0]["g"] == [0.5, -0.25] and got[0]["two"] == [-0.5] and tuple(got[1]) == ([], [], [], [], [])


def test_trace(spark, tmp_path):
    events = [{"cat": "Node", "name": "n", "ts": i, "dur": d, "args": {"op_name": op}} for i, (op, d) in enumerate([("Conv", 900), ("Add", 50), ("Conv", 100), ("Add", 10), ("Conv", 300), ("Add", 30)])]
    events += [{"cat": "Session", "name": "s", "ts": 99, "dur": 10**9}, {"cat": "Node", "name": "Odd", "ts": 100, "dur": 70}]
    (tmp_path / "t.json").write_text(json.dumps(events))
    got = [(r["op"], r["mean_ms"], r["calls"]) for r in trace.rollup(trace.read(spark, str(tmp_path)), 3).collect()]
    assert got == [("Conv", 0.2, 1), ("Odd", 0.07, 1), ("Add", 0.02, 1)]


def test_stream_joins(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(i % 3, start + timedelta(minutes=i), float(i)) for i in range(12)]
    d = spark.createDataFrame([*rows, rows[0]], "k int, ts timestamp, value double")
    want = sorted((a[0], a[2], b[2]) for a in [*rows, rows[0]] for b in [*rows, rows[0]] if a[0] == b[0] and timedelta(0) <= b[1] - a[1] <= timedelta(minutes=5))
    assert sorted((r["k"], r["left_value"], r["right_value"]) for r in joins.near_pairs(d, d, "k").collect()) == want
    assert joins.distinct_within(d, ["k", "value"]).count() == 12
    d.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    for name, df in (("pairs", joins.near_pairs(stream, stream, "k")), ("first", joins.distinct_within(stream, ["k", "value"]))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("pairs").count() == len(want) and spark.table("first").count() == 12


def test_registered_names(spark):
    names = register.register(spark)
    assert {"itn", "clauses", "translated_rows"} <= set(names)
    assert spark.sql("SELECT itn('三百个') AS a, ends_sentence('Yes.”') AS b, fix_timestamps(array(1, 2, 9, 3, 4)) AS c").first() == ("300个", True, [1, 2, 2, 3, 4])
    assert [r["text"] for r in spark.sql("SELECT * FROM translated_rows('你好，我是第一个。第二句在这里。', 0, 1000)").collect()] == ["你好，我是第一个。", "第二句在这里。"]
    assert [r["text"] for r in spark.sql("SELECT c.* FROM VALUES ('a b c, d.') AS t(x), LATERAL clauses(x, 4000) c").collect()] == ["a b c,", "d."]
    assert spark.sql("SELECT * FROM reconciled('Hi, you', array('Hi', 'you'))").count() == 3


def test_reconciled_holds_one_text_at_a_time(spark, monkeypatch):
    from cuelake.operators import align, rows

    monkeypatch.setattr(rows, "BATCH", 3)
    texts = [(1, "Ab, c-d e!", ["Ab", "cd", "e"]), (2, "...", []), (3, " x", ["x", "gone"])]
    d = spark.createDataFrame(texts, "id int, text string, tokens array<string>").coalesce(1)
    got = {(r["id"], r["k"]): (r["text"], r["start_ms"], r["end_ms"]) for r in align.reconciled(d, ["id"], lambda found: [(w, 80 * i, 80 * i + 80) for i, w in enumerate(found)]).collect()}
    want = {(i, k): x for i, t, found in texts for k, x in enumerate(align.reconcile(t, [(w, 80 * n, 80 * n + 80) for n, w in enumerate(found)]), 1)}
    assert got == want and len({i for i, _ in got}) == 3


def test_votes_over_buckets_and_their_shuffles(spark):
    import random

    from cuelake.operators import intervals

    r = random.Random(8)
    turns = [(rec, n, s, s + r.randrange(60), r.choice("abc")) for rec in (1, 2) for n, s in enumerate(sorted(r.randrange(300) for _ in range(25)))]
    items = [(rec, k, s, s + r.choice([0, 0, 3, 40, 150]), f"t{k}") for rec in (1, 2, 3) for k, s in enumerate(r.randrange(330) for _ in range(40))]
    want = {}
    for rec, k, s, e, _ in items:
        there = [t for t in turns if t[0] == rec and t[3] > t[2] and s < t[3] and t[2] < max(e, s + 1)]
        if e > s:
            share = {}
            for t in there:
                n, first = share.get(t[4], (0, t[1]))
                share[t[4]] = (n + min(e, t[3]) - max(s, t[2]), min(first, t[1]))
            want[rec, k] = min(((-n, q, who) for who, (n, q) in share.items()), default=(0, 0, None))[2]
        else:
            want[rec, k] = min(((t[2], t[1], t[4]) for t in there), default=(0, 0, None))[2]
    t = spark.createDataFrame(turns, "rec_id int, seq int, start_ms long, end_ms long, label string").repartition(3)
    c = spark.createDataFrame(items, "rec_id int, k int, start_ms long, end_ms long, text string").repartition(3)
    for deal in (None, ["rec_id"]):
        d = intervals.dominant_speaker(c, t, ["rec_id", "k"], width=50, deal=deal)
        got = {(x["rec_id"], x["k"]): x for x in d.collect()}
        assert {k: x["label"] for k, x in got.items()} == want and len(got) == len(items)
        assert all(got[rec, k][2:5] == (s, e, text) for rec, k, s, e, text in items)
    # shuffles of both sides of the join and of the votes, and none for what is grouped by deal
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    d = intervals.dominant_speaker(c, t, ["rec_id", "k"], width=50, deal=["rec_id"])
    n = plan(d)
    assert n <= 3 and plan(d.groupBy("rec_id").count()) == n


def test_spans_of_lists_are_those_of_their_tokens(spark):
    import random

    from cuelake.operators import chunks

    r = random.Random(9)
    lists, tokens = [], []
    for rec in (1, 2, 3):
        v = i = 0
        for pos in range(12):
            mine = []
            for _ in range(r.randrange(9)):
                v += r.choice([0, 1, 3, 40])
                i += 1
                mine.append(v)
                tokens.append((rec, i, v))
            lists.append((rec, pos, mine))
    one = chunks.chunk_of_token(spark.createDataFrame(tokens, "rec_id int, i long, v long"), ["rec_id"], "i", "v", 7)
    want = one.groupBy("rec_id", "chunk").agg(F.min("i").alias("first"), F.max("i").alias("last")).collect()
    got = chunks.chunk_spans(spark.createDataFrame(lists, "rec_id int, pos int, v array<long>").repartition(4), ["rec_id"], "pos", "v", 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and "Explode" not in got._jdf.queryExecution().optimizedPlan().toString()
