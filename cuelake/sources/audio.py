"""Audio inputs: PCM WAV files and base64 strings to mono samples. Other containers need an external decoder and are not read."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.audio import normalize, resample
from . import wav_blocks


def read_wav(raw: bytes) -> tuple[np.ndarray, int]:
    """(frames, channels) samples in [-1, 1] and the rate, of 8, 16, 24 or 32-bit integers or 32-bit floats."""
    form = wav_blocks.header(lambda n, at: raw[at : at + n], len(raw))
    return wav_blocks.channels(raw[form.first : form.end], form), form.rate


def load(raw: bytes, rate: int = 16_000, seek_s: float = 0.0, most_s: float | None = None) -> np.ndarray:
    """Mono samples at ``rate`` of a part of a WAV file."""
    x, own = read_wav(raw)
    first = int(seek_s * own)
    part = x[first : first + int(most_s * own)] if most_s is not None else x[first:]
    return normalize(resample(part.mean(axis=1), rate, own))


def from_base64(text: str) -> bytes:
    """Bytes of a base64 string, with or without a data URL's head."""
    return base64.b64decode(text.split(",", 1)[1] if text.startswith("data:") else text)


def read_files(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """path and wav (array of samples at ``rate``) of each WAV file."""

    @F.pandas_udf("array<float>")
    def samples(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: load(b, rate).astype("f4"))

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", samples("content").alias("wav"))
