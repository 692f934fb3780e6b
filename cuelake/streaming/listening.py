"""Sessions of audio as a stateful processor: all audio so far is decoded again with each chunk, as long as a session lasts.

A session's audio is list state, to which a chunk is appended without rewriting what is there; what waits for a whole chunk, the number of chunks and the text are value
state. A timer ends a session that has been silent for ``ttl_ms``, and the state store forgets it. Rows whose samples aren't whole 32-bit numbers don't reach a
session: they come out of the same query as ``rejected``, with their seq. The state is in RocksDB, kept by the checkpoint; after a restart the stream goes on where it was.

Needs the state store provider of ``PROVIDER`` and, in Python workers, protobuf.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .sessions import Decoder, count_decoder

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "session_id string, kind string, seq long, chunk_id long, text string"


class Heard:
    """What a session has heard: the same for a stream and for a replay. ``parts`` gives its chunks so far, ``append`` adds one."""

    def __init__(self, decode: Decoder, chunk: int, parts: Callable[[], list[bytes]], append: Callable[[bytes], None], buffer: bytes = b"", chunk_id: int = 0, text: str = ""):
        self.decode, self.size, self.parts, self.append = decode, 4 * max(1, chunk), parts, append
        self.buffer, self.chunk_id, self.text = buffer, chunk_id, text

    def feed(self, pcm: bytes) -> None:
        pcm = self.buffer + pcm
        whole = len(pcm) // self.size * self.size
        for at in range(0, whole, self.size):
            self._step(pcm[at : at + self.size])
        self.buffer = pcm[whole:]

    def finish(self) -> None:
        if self.buffer:
            part, self.buffer = self.buffer, b""
            self._step(part)

    def _step(self, part: bytes) -> None:
        self.append(part)
        self.text = self.decode(np.frombuffer(b"".join(self.parts()), "<f4"), self.text, self.chunk_id)
        self.chunk_id += 1


def _row(session: str, kind: str, seq: int | None, heard: Heard | None) -> tuple:
    return session, kind, seq, heard.chunk_id if heard else None, heard.text if heard else None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["session_id", "kind", "seq", "chunk_id", "text"])
    return out.astype({"seq": "Int64", "chunk_id": "Int64"})


def listen(session: str, rows: Iterator[pd.DataFrame], heard: Heard) -> tuple[list[tuple], bool]:
    """The rejected rows, and whether the session has ended."""
    out, ended = [], False
    for pdf in rows:
        for seq, pcm, last in pdf.sort_values("seq")[["seq", "pcm", "last"]].itertuples(index=False, name=None):
            if pcm is None or len(pcm) % 4:
                out.append(_row(session, "rejected", seq, None))
            else:
                heard.feed(bytes(pcm))
            ended = ended or bool(last)
    return out, ended


class Listener(StatefulProcessor):
    """Rows (session_id, seq, pcm, last) -> OUTPUT: a row of kind ``text`` for each trigger of a session, ``final`` at its end, ``rejected`` for each row that can't be heard."""

    def __init__(self, decode: Decoder = count_decoder, chunk: int = 16_000, ttl_ms: int = 600_000):
        self.decode, self.chunk, self.ttl_ms = decode, chunk, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.audio = handle.getListState("audio", "part binary")
        self.rest = handle.getValueState("rest", "buffer binary, chunk_id long, text string")

    def _heard(self) -> Heard:
        rest = tuple(self.rest.get()) if self.rest.exists() else (b"", 0, "")
        return Heard(self.decode, self.chunk, lambda: [bytes(p[0]) for p in self.audio.get()], lambda part: self.audio.appendValue((part,)), bytes(rest[0]), rest[1], rest[2])

    def _forget(self) -> None:
        self.audio.clear()
        self.rest.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        heard = self._heard()
        out, ended = listen(key[0], rows, heard)
        if ended:
            heard.finish()
            self._forget()
        else:
            self.rest.update((heard.buffer, heard.chunk_id, heard.text))
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        yield _frame([*out, _row(key[0], "final" if ended else "text", None, heard)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        heard = self._heard()
        heard.finish()
        self._forget()
        yield _frame([_row(key[0], "final", None, heard)])

    def close(self) -> None:
        pass


def transcribe(stream: DataFrame, decode: Decoder = count_decoder, chunk: int = 16_000, ttl_ms: int = 600_000) -> DataFrame:
    """OUTPUT of a stream (session_id, seq, pcm, last)."""
    with_state_store(stream.sparkSession)
    return stream.groupBy("session_id").transformWithStateInPandas(Listener(decode, chunk, ttl_ms), OUTPUT, "Update", "ProcessingTime")


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def replay(rows: DataFrame, decode: Decoder = count_decoder, chunk: int = 16_000) -> DataFrame:
    """The rejected rows and the final text of each session of a table: what a stream of the same rows comes to, however it is cut."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts: list[bytes] = []
        heard = Heard(decode, chunk, lambda: parts, parts.append)
        out, _ = listen(key[0], iter([pdf]), heard)
        heard.finish()
        return _frame([*out, _row(key[0], "final", None, heard)])

    return rows.groupBy("session_id").applyInPandas(run, OUTPUT)
