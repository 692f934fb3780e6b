"""Sessions by the stateful processor: any portions, a restart in between, silence and bad rows come to what a replay of the table gives."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

pytest.importorskip("google.protobuf")

from cuelake.streaming import listening  # noqa: E402

SCHEMA = "session_id string, seq long, pcm binary, last boolean"


def rows(seed: int) -> list[tuple]:
    r, out = random.Random(seed), []
    for s in range(5):
        n = r.randrange(3, 12)
        for seq in range(n):
            pcm = np.arange(seq, seq + r.randrange(40), dtype="<f4").tobytes() if r.random() < 0.8 else r.choice([b"abc", None, b""])
            out.append((f"s{s}", seq, pcm, seq == n - 1))
    return out


def summing():
    """A text that hangs on all samples so far, the text before, and the number of the chunk."""
    return lambda samples, prefix, chunk_id: f"{prefix[-6:]}|{chunk_id}:{int(samples.sum())}"


def wait(done) -> None:
    for _ in range(120):
        if done():
            return
        time.sleep(0.5)


def result(table) -> list[tuple]:
    return sorted((str(tuple(r)) for r in table.where("kind <> 'text'").collect()))


@pytest.mark.parametrize("portions,restart", [(1, False), (4, False), (4, True)])
def test_streams_come_to_the_replay(spark, tmp_path, portions, restart):
    own = rows(portions)
    given = spark.createDataFrame(own, SCHEMA)
    want = result(listening.replay(given, summing(), 25))
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    by_time = sorted(own, key=lambda x: x[1])
    cuts = [by_time[len(by_time) * k // portions : len(by_time) * (k + 1) // portions] for k in range(portions)]
    out = tmp_path / "out"

    def start():
        return listening.transcribe(stream, summing(), 25).writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n:03d}")).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()

    def written() -> list[str]:
        return [str(f) for f in out.glob("*") if (f / "_SUCCESS").exists()]

    def seen() -> int:
        files = written()
        return spark.read.parquet(*files).where("kind = 'final'").count() if files else 0

    query = None
    for k, part in enumerate(cuts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        if query is None or restart:
            query = start()
        if restart and k < len(cuts) - 1:  # a query with timers never has all available
            wait(lambda: sum(p.numInputRows for p in query.recentProgress) >= len(part))  # noqa: B023
            query.stop()
    wait(lambda: seen() >= 5)
    query.stop()
    assert result(spark.read.parquet(*written())) == want


def test_silent_sessions_end(spark, tmp_path):
    spark.createDataFrame([("open", 0, np.zeros(30, "<f4").tobytes(), False)], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = listening.transcribe(stream, chunk=20, ttl_ms=500).writeStream.format("memory").queryName("listened").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    wait(lambda: spark.table("listened").where("kind = 'final'").count() == 1)
    query.stop()
    assert sorted(tuple(r) for r in spark.table("listened").collect()) == [("open", "final", None, 2, "20 30"), ("open", "text", None, 1, "20")]
