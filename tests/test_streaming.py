from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from cuelake.streaming import sessions

SF = "/root/testdata/sf0.001"


def wait(done) -> None:
    for _ in range(80):
        if done():
            return
        time.sleep(0.5)


def test_session_is_the_same_in_any_portions():
    pcm = np.arange(100, dtype="<f4").tobytes()
    texts = set()
    for size in (4, 28, 400):
        s = sessions.Session(sessions.count_decoder, 30, 50)
        for i in range(0, len(pcm), size):
            s.feed(pcm[i : i + size])
        s.finish()
        texts.add((s.text, s.chunk_id))
    assert texts == {("30 50 50 50", 4)}
    assert sessions.to_float(np.array([-32768, 16384], "<i2").tobytes(), "<i2").tolist() == [-1.0, 0.5]


def test_transcribe_stream(spark, tmp_path):
    rows = [(f"s{i % 2}", i // 2, np.zeros(25, "<f4").tobytes(), i >= 6) for i in range(8)] + [("bad", 0, b"abc", True)]
    spark.createDataFrame(rows, "session_id string, seq long, pcm binary, last boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, seq long, pcm binary, last boolean").parquet(str(tmp_path / "in"))
    q = sessions.transcribe(stream, chunk=40, keep=60).writeStream.format("memory").queryName("heard").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    wait(lambda: spark.table("heard").where("finished").count() == 3)  # a query with timeouts never ends by itself
    q.stop()
    got = {r["session_id"]: (r["chunk_id"], r["text"], r["finished"]) for r in spark.table("heard").collect()}
    assert got == {"s0": (3, "40 60 60", True), "s1": (3, "40 60 60", True), "bad": (0, "", True)}
    assert sessions.rejected(spark.read.parquet(str(tmp_path / "in"))).count() == 1


def test_silent_sessions_time_out(spark, tmp_path):
    rows = [("open", 0, np.zeros(25, "<f4").tobytes(), False)]
    spark.createDataFrame(rows, "session_id string, seq long, pcm binary, last boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, seq long, pcm binary, last boolean").parquet(str(tmp_path / "in"))
    q = sessions.transcribe(stream, chunk=10, keep=60, ttl_ms=500).writeStream.format("memory").queryName("silent").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    wait(lambda: spark.table("silent").count() > 1)
    q.stop()
    assert [tuple(r) for r in spark.table("silent").collect()] == [("open", 2, "10 20", False), ("open", 3, "10 20 25", True)]


def test_windows_are_the_same_for_stream_and_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = sessions.windowed_counts(stream, late="3650 days").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, sessions.windowed_counts(events).collect()))
    assert sessions.user_sessions(events).agg(F.sum("n")).first()[0] == events.count()
