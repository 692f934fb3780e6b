"""The audio source reads what is asked for, and the file sink shows all files or none."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.sources import audio, subtitles, text_files, wav_blocks


def wav(x: np.ndarray, rate: int, width: int = 2) -> bytes:
    """A file of samples [frame, channel] from -1 to 1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1]), w.setsampwidth(width), w.setframerate(rate)
        n = np.round(x * (2 ** (8 * width - 1) - 1)).astype(np.int64)
        raw = (n + 128).astype("u1").tobytes() if width == 1 else n.astype("<i8").ravel().view("u1").reshape(-1, 8)[:, :width].tobytes()
        w.writeframes(raw)
    return out.getvalue()


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def float_wav(x: np.ndarray, rate: int) -> bytes:
    """Floats in the extended format, behind a part of odd length."""
    form = struct.pack("<HHIIHHHHIH", 0xFFFE, x.shape[1], rate, rate * 4 * x.shape[1], 4 * x.shape[1], 32, 22, 32, 3, 3) + b"\0" * 14
    body = b"WAVE" + chunk(b"LIST", b"abc") + chunk(b"fmt ", form) + chunk(b"data", x.astype("<f4").tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r, path = np.random.default_rng(5), tmp_path_factory.mktemp("audio files")
    (path / "deep").mkdir()
    signals = {"one": r.uniform(-1, 1, (1000, 1)), "two": r.uniform(-1, 1, (777, 2)), "three.v2": r.uniform(-1, 1, (64, 3)), "wide": r.uniform(-1, 1, (500, 1)), "float": r.uniform(-1, 1, (300, 2)), "none": np.zeros((0, 1))}
    (path / "one.wav").write_bytes(wav(signals["one"], 100))
    (path / "deep" / "two.WAV").write_bytes(wav(signals["two"], 100, 3))
    (path / "three.v2.wav").write_bytes(wav(signals["three.v2"], 100, 1))
    (path / "wide.wav").write_bytes(wav(signals["wide"], 100, 4))
    (path / "float.wav").write_bytes(float_wav(signals["float"], 100))
    (path / "none.wav").write_bytes(wav(signals["none"], 100))
    (path / "notes.txt").write_text("no sound")
    return path, {k: v.mean(axis=1) for k, v in signals.items()}


def joined(rows, size: int) -> dict:
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["rec_id"], r["block"])):
        assert r["start"] == r["block"] * size and r["rate"] == 100
        out.setdefault(r["rec_id"], []).extend(r["samples"])
    return out


@pytest.mark.parametrize("size,split", [(64, 10**6), (50, 300), (10_000, 1)])
def test_blocks_are_the_file(spark, folder, size, split):
    path, signals = folder
    got = joined(wav_blocks.blocks(spark, str(path), size, split=split).collect(), size)
    assert set(got) == {k for k, v in signals.items() if len(v)}
    for k, x in got.items():
        np.testing.assert_allclose(x, signals[k], atol=0.02 if k == "three.v2" else 1e-4)


@pytest.mark.parametrize("seek_s,limit_s", [(0.0, 2.5), (3.21, 1.0), (3.21, None), (9.99, 5.0), (50.0, 1.0), (1.0, 0.0)])
def test_a_part_of_the_time(spark, folder, seek_s, limit_s):
    path, signals = folder
    got = joined(wav_blocks.blocks(spark, f"file://{path}/one.wav".replace(" ", "%20"), 30, seek_s, limit_s, split=200).collect(), 30)
    first = int(seek_s * 100)
    want = signals["one"][first:] if limit_s is None else signals["one"][first : first + int(limit_s * 100)]
    np.testing.assert_allclose(got.get("one", []), want, atol=1e-4)


def test_filters_are_met_by_reading_less(spark, folder):
    path, signals = folder
    b = wav_blocks.blocks(spark, str(path), 50, split=300)
    asked = b.where((F.col("rec_id") == "one") & (F.col("block") >= 3) & (F.col("block") < 6) & (F.size("samples") > 0))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "block" not in plan.split("Filter")[1].split("BatchScan")[0] if "Filter" in plan else True
    rows = asked.collect()
    assert sorted(r["block"] for r in rows) == [3, 4, 5]
    np.testing.assert_allclose(joined(rows, 50)["one"], signals["one"][150:300], atol=1e-4)
    assert b.where(F.col("rec_id").isin("one", "wide") & (F.col("block") == 1)).count() == 2 and b.where("rec_id = 'nobody'").count() == 0
    reader = wav_blocks.WavReader({"path": str(path), "split": "300"})
    left = list(reader.pushFilters([wav_blocks.EqualTo(("rec_id",), "one"), wav_blocks.In(("block",), (1, 2)), wav_blocks.LessThan(("start",), 5)]))
    assert [type(f).__name__ for f in left] == ["In", "LessThan"] and {wav_blocks.rec_id(p.path) for p in reader.partitions()} == {"one"}


def test_ten_seconds_of_a_long_file_are_ten_seconds_of_bytes():
    """A file of 1 GB that is there only where it is read."""
    head, rate, read = wav(np.zeros((0, 1)), 16_000)[:44], 16_000, []
    n_bytes = 1_000_000_000
    head = head[:40] + struct.pack("<I", n_bytes - 44)

    def read_at(n: int, at: int) -> bytes:
        read.append(n)
        return (head[at : at + n] + b"\0" * n)[:n] if at < 44 else b"\1\0" * (n // 2)

    form = wav_blocks.header(read_at, n_bytes)
    got = [x for k in range(3) for x in wav_blocks.read_blocks(read_at, form, 48_000, 1234.5, 10.0, 0, float("inf"), (k, 3))]
    assert sum(len(x) for _, _, x in got) == 160_000 and [b for b, _, _ in got] == [0, 1, 2, 3]
    assert sum(read) <= 10 * rate * 2 + 100
    read.clear()
    assert [b for b, _, _ in wav_blocks.read_blocks(read_at, form, 48_000, 0.0, None, 70, 71, (0, 1))] == [70, 71] and sum(read) == 2 * 96_000


def test_broken_files(spark, tmp_path):
    (tmp_path / "bad.wav").write_bytes(b"RIFF1234WAVEdata")
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "cut.wav").write_bytes(wav(np.zeros((100, 1)), 100)[:-51])
    (tmp_path / "stream.wav").write_bytes(wav(np.zeros((10, 1)), 100)[:40] + b"\xff\xff\xff\xff" + b"\0" * 20)
    got = wav_blocks.blocks(spark, str(tmp_path), 1000, broken="skip").collect()
    assert {r["rec_id"]: len(r["samples"]) for r in got} == {"cut": 74, "stream": 10}
    with pytest.raises(Exception, match="not a WAV file|no samples"):
        wav_blocks.blocks(spark, str(tmp_path), 1000).collect()
    with pytest.raises(Exception, match="size and split"):
        wav_blocks.blocks(spark, str(tmp_path), 0).collect()
    assert audio.read_wav(float_wav(np.ones((3, 2)), 100))[0].shape == (3, 2)


# ---- files out


def names(folder) -> dict:
    return {str(f.relative_to(folder)): f.read_text() for f in folder.rglob("*") if f.is_file() and f.name != "_SUCCESS" and not f.name.endswith(".crc")}


def files(spark, rows, parts: int = 3):
    return spark.createDataFrame(rows, "name string, content string, source string").repartition(parts)


def test_one_file_a_row(spark, tmp_path):
    out = tmp_path / "out put"
    rows = [(f"d{i % 3}/r {i}.srt", f"inhalt {i} é你\n" * i, None) for i in range(20)] + [("a.srt", None, None)]
    text_files.write(files(spark, rows), str(out))
    assert names(out) == {n: c or "" for n, c, _ in rows} and (out / "_SUCCESS").exists()
    assert not [f for f in out.iterdir() if f.name.startswith("_temporary")]
    with pytest.raises(Exception, match="places are taken"):
        text_files.write(files(spark, [("b.srt", "new", None), ("a.srt", "other", None)]), str(out))
    assert names(out) == {n: c or "" for n, c, _ in rows}
    text_files.write(files(spark, [("b.srt", "new", None), ("a.srt", "other", None)]), str(out), "overwrite")
    assert names(out) == {n: c or "" for n, c, _ in rows} | {"a.srt": "other", "b.srt": "new"}
    text_files.write(files(spark, []), str(tmp_path / "nothing"))
    assert names(tmp_path / "nothing") == {}


@pytest.mark.parametrize("bad", [("../x.srt", "x", None), (None, "x", None), ("", "x", None), ("/etc/x", "x", None), ("r1.srt", "again", None)])
def test_all_files_or_none(spark, tmp_path, bad):
    with pytest.raises(Exception):
        text_files.write(files(spark, [*((f"r{i}.srt", "x", None) for i in range(10)), bad]), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or all(f.name.startswith("_temporary-") for f in (tmp_path / "out").iterdir())


def test_an_input_is_not_written_over(spark, tmp_path):
    (tmp_path / "a.srt").write_text("input")
    row = ("a.srt", "output", str(tmp_path / "a.srt"))
    with pytest.raises(Exception, match="written over"):
        text_files.write(files(spark, [row]), str(tmp_path), "overwrite")
    assert names(tmp_path) == {"a.srt": "input"}


def test_a_task_that_fails_leaves_nothing(tmp_path):
    """Three attempts of one task: one fails half-way, two end well, of which the driver commits one."""
    writer = text_files.TextFilesWriter(str(tmp_path), False, ["name", "content"])

    def failing():
        yield {"name": "a", "content": "half"}
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(failing())
    writer.write(iter([{"name": "a", "content": "twin"}, {"name": "b", "content": "twin"}]))
    good = writer.write(iter([{"name": "a", "content": "whole"}, {"name": "b", "content": "whole"}]))
    assert names(tmp_path).keys() and not (tmp_path / "a").exists()
    writer.commit([good, None])
    assert names(tmp_path) == {"a": "whole", "b": "whole"} and not [f for f in tmp_path.iterdir() if f.is_dir()]


def test_subtitles_are_exported_one_file_a_recording(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1, 0, 900, "Hello.", "spk0"), ("x", 2, 1000, 2000, "Bye.", ""), ("y", 1, 0, 10, "One", "")], "rec_id string, idx int, start_ms long, end_ms long, text string, speaker string")
    everyone = spark.createDataFrame([("x", "/in/x.wav"), ("y", "/in/y.srt"), ("z", "/in/z.wav")], "rec_id string, source string")
    subtitles.export(rows, everyone, str(tmp_path / "out"), suffix="_new")
    got = names(tmp_path / "out")
    assert set(got) == {"x_new.srt", "y_new.srt", "z_new.srt"} and got["z_new.srt"] == ""
    assert got["x_new.srt"] == "1\n00:00:00,000 --> 00:00:00,900\n[spk0] Hello.\n\n2\n00:00:01,000 --> 00:00:02,000\nBye.\n"
    (tmp_path / "y.srt").write_text("input")
    with pytest.raises(Exception, match="written over"):
        subtitles.export(rows.where("rec_id = 'y'"), spark.createDataFrame([("y", str(tmp_path / "y.srt"))], "rec_id string, source string"), str(tmp_path), suffix="", mode="overwrite")
    assert (tmp_path / "y.srt").read_text() == "input"


def test_subtitles_that_are_there_are_used_again(spark):
    there = spark.createDataFrame([("x", 1, 5, 9, "Kept", "")], "rec_id string, idx int, start_ms long, end_ms long, text string, speaker string")
    items = spark.createDataFrame([("x", 1, 0, 400, "No."), ("y", 1, 0, 700, "Built.")], "rec_id string, pos int, start_ms long, end_ms long, text string")
    got = sorted((r["rec_id"], r["text"]) for r in subtitles.resolve(there, items).collect())
    assert got == [("x", "Kept"), ("y", "Built.")]
