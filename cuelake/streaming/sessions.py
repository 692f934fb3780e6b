"""Streams of audio: keyed sessions that buffer samples and re-decode a bounded tail, and event-time windows.

A session's state is its buffer, the samples that its prefix still needs, the number of its chunk and the text so far. The decoder
is a callable ``(samples, prefix, chunk_id) -> text`` that the caller supplies; ``count_decoder`` is a deterministic stand-in.
State is bounded: only the last ``keep`` samples are decoded again, and a session without input for ``ttl_ms`` ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "buffer binary, tail binary, chunk_id long, text string"
OUTPUT = "session_id string, chunk_id long, text string, finished boolean"

Decoder = Callable[[np.ndarray, str, int], str]


def count_decoder(samples: np.ndarray, prefix: str, chunk_id: int) -> str:
    return f"{prefix} {len(samples)}".strip()


def to_float(pcm: bytes, kind: str = "<f4") -> np.ndarray:
    """Samples in [-1, 1]; 16-bit integers are scaled. A length that isn't whole samples raises ValueError."""
    x = np.frombuffer(pcm, kind)
    return x.astype("<f4") / 32768 if kind == "<i2" else x


class Session:
    """The pure state machine; the same for a stream and for a batch replay."""

    def __init__(self, decode: Decoder, chunk: int, keep: int, state: tuple | None = None):
        self.decode, self.chunk, self.keep = decode, max(1, chunk), keep
        self.buffer, self.tail, self.chunk_id, self.text = state or (b"", b"", 0, "")

    def state(self) -> tuple:
        return self.buffer, self.tail, self.chunk_id, self.text

    def _step(self, samples: bytes) -> str:
        self.tail = (self.tail + samples)[-4 * self.keep :]
        self.text = self.decode(np.frombuffer(self.tail, "<f4"), self.text, self.chunk_id)
        self.chunk_id += 1
        return self.text

    def feed(self, pcm: bytes) -> None:
        self.buffer += pcm
        n = 4 * self.chunk
        while len(self.buffer) >= n:
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            self._step(part)

    def finish(self) -> None:
        if self.buffer:
            part, self.buffer = self.buffer, b""
            self._step(part)


def transcribe(stream: DataFrame, decode: Decoder = count_decoder, chunk: int = 16_000, keep: int = 480_000, ttl_ms: int = 600_000) -> DataFrame:
    """OUTPUT rows of ``stream`` (session_id, seq, pcm, last): one for each trigger of a session, and a final one at its end."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = Session(decode, chunk, keep, state.get if state.exists else None)
        last = state.hasTimedOut
        for pdf in batches:
            for pcm, ends in pdf.sort_values("seq")[["pcm", "last"]].itertuples(index=False, name=None):
                if pcm is not None and len(pcm) % 4 == 0:
                    session.feed(bytes(pcm))
                last = last or bool(ends)
        if last:
            session.finish()
            state.remove()
        else:
            state.update(session.state())
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"session_id": [key[0]], "chunk_id": [session.chunk_id], "text": [session.text], "finished": [last]})

    return stream.groupBy("session_id").applyInPandasWithState(run, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def rejected(stream: DataFrame) -> DataFrame:
    """Rows whose samples aren't whole 32-bit numbers."""
    return stream.where(F.col("pcm").isNull() | (F.octet_length("pcm") % 4 != 0))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "10 minutes", step: str = "1 minute") -> DataFrame:
    """Events in each sliding window, with a watermark for late ones; for streams and batches alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
