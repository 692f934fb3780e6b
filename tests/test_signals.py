from __future__ import annotations

import base64
import io
import wave

import numpy as np
import pytest

from cuelake.functions import audio, decoding
from cuelake.operators import cluster
from cuelake.sources import audio as source


def wav(x: np.ndarray, rate: int, channels: int = 1) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_wav():
    t = np.arange(8000) / 8000
    x = 0.5 * np.sin(2 * np.pi * 200 * t)
    got = source.load(wav(np.repeat(x, 2), 8000, 2), 16_000)
    assert len(got) == 16_000 and np.abs(got[500:-500] - 0.5 * np.sin(2 * np.pi * 200 * np.arange(16_000) / 16_000)[500:-500]).max() < 0.01
    assert len(source.load(wav(x, 8000), 8000, 0.25, 0.5)) == 4000
    assert source.from_base64("data:audio/wav;base64," + base64.b64encode(b"ab").decode()) == b"ab" == source.from_base64(base64.b64encode(b"ab").decode())
    with pytest.raises(ValueError):
        source.read_wav(b"nothing at all")


def test_read_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(np.zeros(800), 8000))
    (tmp_path / "b.txt").write_text("x")
    assert [len(r["wav"]) for r in source.read_files(spark, str(tmp_path)).collect()] == [1600]


def test_resample_and_normalize():
    assert len(audio.resample(np.ones(10), 3, 2)) == 15 and audio.resample(np.zeros(0), 3, 2).size == 0
    assert np.abs(audio.normalize(np.array([[2.0, -4.0]])).max()) <= 1 and audio.normalize(np.array([0.5])).tolist() == [0.5]


def test_split_points_lose_nothing_and_cut_in_silence():
    x = np.random.default_rng(1).normal(size=16_000 * 30)
    x[16_000 * 11 : 16_000 * 11 + 4000] = 0
    parts = audio.split_points(x, 16_000, 12.0)
    assert parts[0][0] == 0 and parts[-1][1] == len(x) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert 16_000 * 11 <= parts[0][1] <= 16_000 * 11 + 4000


def test_filter_bank():
    f = audio.filter_bank(np.random.default_rng(2).normal(size=16_000) * 0.1)
    assert f.shape == (98, 80) and np.abs(f.mean(axis=0)).max() < 1e-9 and audio.filter_bank(np.zeros(10)).shape == (1, 80) and audio.filter_bank(np.zeros(0)).shape == (0, 80)


def test_clustering():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(30, 8)) * 0.05 + c for c in np.eye(8)[:3]])
    assert cluster.agglomerate(x).tolist() == [0] * 30 + [1] * 30 + [2] * 30
    assert cluster.agglomerate(np.zeros((0, 4))).size == 0 and cluster.agglomerate(np.ones((1, 4))).tolist() == [0]


def test_decoding():
    u = decoding.Utf8Parts()
    raw = "é你".encode()
    assert "".join([u.feed(raw[:1]), u.feed(raw[1:4]), u.feed(raw[4:], True)]) == "é你"
    assert decoding.rollback([65, 0xE4, 0xBD, 0xA0, 66], 2, lambda t: bytes(t).decode("utf-8", "replace")) == [65]
