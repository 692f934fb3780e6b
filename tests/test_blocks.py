"""Operators on blocks against the same on whole signals."""

from __future__ import annotations

import numpy as np
import pytest

from cuelake.functions import audio
from cuelake.operators import blocks


def table(spark, recordings: dict, size: int):
    rows = [(rec, k, x[at : at + size].tolist()) for rec, x in recordings.items() for k, at in enumerate(range(0, max(1, len(x)), size))]
    np.random.default_rng(0).shuffle(rows)
    return spark.createDataFrame([(str(r), int(k), x) for r, k, x in rows], "rec_id string, block int, samples array<double>").repartition(4)


def signals(seed: int) -> dict:
    """Noise of changing loudness, silence, tones with a whole number of periods in a window, a fade, steps, short and empty recordings."""
    r = np.random.default_rng(seed)
    t = np.arange(3000)
    noise = r.normal(size=3000) * np.repeat(r.random(60), 50)
    gaps = noise.copy()
    gaps[900:1300] = gaps[2000:2030] = 0
    return {
        "noise": noise, "gaps": gaps, "silence": np.zeros(2500), "tone": np.sin(2 * np.pi * t / 10), "square": np.where(t // 7 % 2, 0.5, -0.5), "fade": np.linspace(1, 0, 3000), "rise": np.linspace(0, 1, 3000),
        "steps": np.round(r.random(3000) * 3) / 4, "exact": r.random(400), "one more": r.random(401), "short": r.random(7), "one": r.random(1), "none": np.zeros(0), "odd": np.where(t % 900 == 450, np.nan, noise),
    }


def test_halo(spark):
    x = np.arange(23.0)
    got = {r["block"]: r for r in blocks.halo(table(spark, {"a": x}, 5), 5, before=7, after=12).collect()}
    for k in range(5):
        assert got[k]["samples"] == x[5 * k : 5 * k + 5].tolist()
        assert got[k]["before"] == x[max(0, 5 * k - 7) : 5 * k].tolist() and got[k]["after"] == x[5 * k + 5 : 5 * k + 17].tolist()


@pytest.mark.parametrize("size,most_s,around_s,window_s", [(100, 4.0, 1.0, 0.1), (37, 4.0, 0.5, 0.1), (5000, 4.0, 1.0, 0.1), (64, 4.0, 1.0, 0.9), (50, 1.0, 2.0, 0.1), (1, 3.0, 0.4, 0.2)])
def test_quiet_splits_are_those_of_whole_signals(spark, size, most_s, around_s, window_s):
    recordings = {k: v for k, v in signals(size).items() if size > 1 or len(v) < 500}
    got = blocks.quiet_splits(table(spark, recordings, size), size, 100, most_s, around_s, window_s).collect()
    for rec, x in recordings.items():
        own = sorted((r["chunk"], r["start"], r["end"], r["length"]) for r in got if r["rec_id"] == rec)
        want = audio.split_points(x, 100, most_s, around_s, window_s)
        assert own == [(k, a, b, max(b - a, 50)) for k, (a, b) in enumerate(want)], rec


def test_quiet_splits_of_random_signals(spark):
    r = np.random.default_rng(8)
    for size in (23, 160):
        recordings = {str(i): np.round(r.normal(size=int(r.integers(1, 3000))) * r.choice([1, 4, 100])) / 128 for i in range(40)}
        got = blocks.quiet_splits(table(spark, recordings, size), size, 50, 5.0, 1.0, 0.2).collect()
        for rec, x in recordings.items():
            assert sorted((r["start"], r["end"]) for r in got if r["rec_id"] == rec) == audio.split_points(x, 50, 5.0, 1.0, 0.2)


def test_quiet_splits_refuse_a_range_within_a_window(spark):
    with pytest.raises(ValueError):
        blocks.quiet_splits(table(spark, {"a": np.zeros(5)}, 5), 5, 100, 4.0, 0.05, 0.1)


def test_chunk_samples_lose_nothing(spark):
    recordings = signals(3)
    b = table(spark, recordings, 64)
    parts = blocks.chunk_samples(b, blocks.quiet_splits(b, 64, 100, 4.0, 1.0), 64).collect()
    for rec, x in recordings.items():
        own = [s for p in sorted((p for p in parts if p["rec_id"] == rec), key=lambda p: (p["chunk"], p["part"])) for s in p["samples"]]
        np.testing.assert_array_equal(own, x)


def joined(rows, n_mels: int) -> np.ndarray:
    out, at = [], 0
    for r in sorted(rows, key=lambda r: r["first_frame"]):
        assert r["first_frame"] == at and len(r["energies"]) == r["n_frames"] * n_mels
        out.append(np.array(r["energies"]).reshape(-1, n_mels))
        at += r["n_frames"]
    return np.concatenate(out) if out else np.zeros((0, n_mels))


def speech(seed: int) -> dict:
    r = np.random.default_rng(seed)
    return {str(n): r.normal(size=n) * 0.1 * (1 + np.sin(np.arange(n) / 300)) for n in (0, 1, 159, 160, 200, 201, 319, 399, 400, 401, 560, 1000, 1600, 4321, 9000)}


@pytest.mark.parametrize("size", [150, 160, 400, 1000, 20_000])
def test_spectra_are_those_of_whole_signals(spark, size):
    recordings = speech(size)
    b = table(spark, recordings, size)
    bank = blocks.centred(blocks.log_filter_bank(b, size)).collect()
    mel = blocks.floored(blocks.log_mel_power(b, size)).collect()
    for rec, x in recordings.items():
        np.testing.assert_allclose(joined([r for r in bank if r["rec_id"] == rec], 80), audio.filter_bank(x), atol=1e-8)
        if len(x):
            np.testing.assert_allclose(joined([r for r in mel if r["rec_id"] == rec], 128), audio.log_mel(x).T, atol=1e-5)
