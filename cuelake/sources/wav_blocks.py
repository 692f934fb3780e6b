"""A data source of WAV files as tables of blocks, of which only the bytes that are asked for are read.

    spark.dataSource.register(WavBlocks)          # or blocks(spark, path, ...)
    spark.read.format("wav_blocks").option("size", 160000).option("seek_s", 30).option("limit_s", 10).load(path)

Rows: path, rec_id (the path's name without its extension), block (from 0), start (its first sample, counted from the seek point), rate, samples (mono, the mean of all channels). A file is dealt to
several tasks by its size; each reads the header, and then its own share of the blocks that are wanted. ``seek_s`` and ``limit_s``, and filters on path, rec_id
and block, are met by reading less. Paths are local or of any store that Arrow opens (``file://``, ``hdfs://``, ``s3://``, ...); folders are searched for ``*.wav``.

Files are PCM of 8, 16, 24 or 32 bits or floats of 32 bits. One that is cut short has the samples that are there; one that isn't such a file is an error, or has no
rows with option ``broken`` at ``skip``. A file without samples has no rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .places import absolute, opened, shown

SCHEMA = "path string, rec_id string, block long, start long, rate int, samples array<float>"
#: Samples of a block; bytes of a file for each task; seconds for each task if the length is limited.
SIZE, SPLIT, SPAN_S = 160_000, 64 << 20, 600.0


@dataclass
class Form:
    """What a header says: format tag, channels, samples a second, bits, where the samples begin and end."""

    tag: int
    channels: int
    rate: int
    bits: int
    first: int
    end: int

    @property
    def frame(self) -> int:
        return self.channels * self.bits // 8

    @property
    def frames(self) -> int:
        return max(0, self.end - self.first) // self.frame


def header(read_at, n_bytes: int) -> Form:
    """The form of a file of ``n_bytes``; ``read_at(n, at)`` gives bytes. Only the heads of its parts are read."""
    if read_at(4, 0) != b"RIFF" or read_at(4, 8) != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= n_bytes:
        name, length = struct.unpack("<4sI", read_at(8, at))
        if name == b"fmt ":
            body = read_at(min(length, 40), at + 8)
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if tag == 0xFFFE and len(body) >= 26:  # the format proper is in the extension
                tag = struct.unpack_from("<H", body, 24)[0]
            if tag not in (1, 3) or bits not in ((8, 16, 24, 32) if tag == 1 else (32,)) or not channels or not rate:
                raise ValueError(f"samples of format {tag} with {bits} bits")
            form = tag, channels, rate, bits
        elif name == b"data" and form:
            known = length not in (0, 0xFFFFFFFF) or at + 8 + length == n_bytes  # a stream's writer may not know
            return Form(*form, at + 8, min(n_bytes, at + 8 + length) if known else n_bytes)
        at += 8 + length + length % 2
    raise ValueError("no samples")


def channels(raw: bytes, form: Form) -> np.ndarray:
    """(frames, channels) samples from -1 to 1, of whole frames."""
    raw = raw[: len(raw) // form.frame * form.frame]
    if form.tag == 3:
        x = np.frombuffer(raw, "<f4").astype(float)
    elif form.bits == 8:
        x = (np.frombuffer(raw, "u1").astype(float) - 128) / 128
    elif form.bits == 24:
        b = np.frombuffer(raw, "u1").reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2.0**23
    else:
        x = np.frombuffer(raw, f"<i{form.bits // 8}") / 2.0 ** (form.bits - 1)
    return x.reshape(-1, form.channels)


def wanted_frames(form: Form, seek_s: float, limit_s: float | None) -> tuple[int, int]:
    """First frame and end of the part that is asked for."""
    first = min(form.frames, int(seek_s * form.rate))
    return first, form.frames if limit_s is None else min(form.frames, first + int(limit_s * form.rate))


def read_blocks(read_at, form: Form, size: int, seek_s: float, limit_s: float | None, low: int, high: float, share: tuple[int, int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(block, start, samples) of the ``share`` (k of n) of the blocks from ``low`` to ``high``."""
    first, end = wanted_frames(form, seek_s, limit_s)
    a, b = max(0, low), min(-(-(end - first) // size), int(min(high, 2**62)) + 1)
    k, n = share
    for block in range(a + max(0, b - a) * k // n, a + max(0, b - a) * (k + 1) // n):
        at = first + block * size
        yield block, block * size, channels(read_at(min(size, end - at) * form.frame, form.first + at * form.frame), form).mean(axis=1)


def rec_id(path: str) -> str:
    return re.sub(r"(?<=.)\.[^.]*$", "", path.rsplit("/", 1)[-1])


@dataclass
class Part(InputPartition):
    place: str  # in the store
    path: str
    n_bytes: int
    share: tuple[int, int]


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.skip = absolute(options["path"]), options.get("broken", "fail").lower() == "skip"
        self.size, self.split = int(options.get("size", SIZE)), int(options.get("split", SPLIT))
        self.seek_s, self.limit_s = float(options.get("seek_s", 0)), float(options["limit_s"]) if options.get("limit_s") else None
        if self.size < 1 or self.split < 1 or self.seek_s < 0 or self.limit_s is not None and self.limit_s < 0:
            raise ValueError("size and split have to be 1 or more, seek_s and limit_s 0 or more")
        self.named: list[tuple[str, frozenset]] = []
        self.low, self.high = 0, float("inf")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps what it can't meet: whatever isn't a comparison of path, rec_id or block."""
        for f in filters:
            column, value = f.attribute if hasattr(f, "attribute") else None, getattr(f, "value", None)
            if column in (("path",), ("rec_id",)) and isinstance(f, (EqualTo, EqualNullSafe, In)) and value is not None:
                self.named.append((column[0], frozenset(value) if isinstance(f, In) else frozenset([value])))
            elif column == ("block",) and isinstance(f, (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and value is not None:
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, value - isinstance(f, LessThan))
            elif not (isinstance(f, IsNotNull) and column and column[0] in ("path", "rec_id", "block")):
                yield f

    def partitions(self) -> list[Part]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for f in sorted((f for f in files if f.is_file and f.path.lower().endswith(".wav")), key=lambda f: f.path):
            whole = shown(self.path, f.path)
            if all((whole if column == "path" else rec_id(whole)) in names for column, names in self.named):
                n = -(-(f.size or 1) // self.split)
                if self.limit_s is not None:
                    n = max(1, min(n, int(-(-self.limit_s // SPAN_S))))
                out += [Part(f.path, whole, f.size, (k, n)) for k in range(n)]
        return out

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no file
            return
        system, _ = opened(self.path)
        names, kinds = ["path", "rec_id", "block", "start", "rate", "samples"], [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float32())]
        with system.open_input_file(partition.place) as f:
            try:
                form = header(f.read_at, partition.n_bytes)
            except (ValueError, struct.error) as e:
                if self.skip:
                    return
                raise ValueError(f"{partition.path}: {e}") from e
            for block, start, x in read_blocks(f.read_at, form, self.size, self.seek_s, self.limit_s, self.low, self.high, partition.share):
                samples = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*(pa.array([v], kind) for v, kind in zip((partition.path, rec_id(partition.path), block, start, form.rate), kinds)), samples], names=names)


class WavBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(dict(self.options))


def blocks(spark: SparkSession, path: str, size: int = SIZE, seek_s: float = 0.0, limit_s: float | None = None, split: int = SPLIT, broken: str = "fail") -> DataFrame:
    """The blocks of the WAV files under ``path``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a source that takes filters can't be read without
    spark.dataSource.register(WavBlocks)
    source = spark.read.format("wav_blocks").option("size", size).option("seek_s", seek_s).option("split", split).option("broken", broken)
    return (source if limit_s is None else source.option("limit_s", limit_s)).load(path)
