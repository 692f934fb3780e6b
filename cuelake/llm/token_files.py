"""Token files of directly addressable codes.

A segment holds the ids of a run of documents. Each id is split into chunks of 8 bits, lowest first. Level 0 has the
lowest chunk of every id, level 1 the next chunk of those ids that go on, and so on; a level's continuation bitmap
tells which do, and its rank directory has the number of set bits before every block of ``BLOCK`` bits. So any id, and any
document, is found by one look and one rank in each level, without decoding others.

Layout (little-endian): ``DAC1``; u32 documents; u64 ids; u32 levels; documents' validity bitmap; i64 doc_ids; u64
offsets (documents + 1); then for each level u64 entries, its chunks, its bitmap, u32 rank directory.

A file set is a Spark table of segments (part, seq, first, n_tokens, segment) in ascending doc_id order, null first:
Spark's committed writes make it safe on any store and against lost executors. ``start`` of a segment is the tokens of
earlier parts (one sum for each part, held by the driver) plus ``first``.

Texts are encoded where they are read, and only ids are shuffled, to the parts of a range partitioning by (doc_id, hash of the ids). The
bounds are quantiles of doc_id, one for each part; a doc_id that fills several parts is dealt to them by the range of the hash. So rows of one doc_id
are in the order of that hash, which is the same in every run, and rows that are equal in both are interchangeable.

Null text counts as empty: the end id alone. Null doc_ids and repeated rows are written as rows of their own. Texts of any
length are encoded whole; a segment has at least one document, so it grows beyond ``SEGMENT`` ids only by its last one. An
empty table gives an empty file set. Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, parallelism, read

#: Bits of a rank block, ids of a segment at least (unless the part ends).
BLOCK, SEGMENT = 512, 1 << 20
SEGMENTS = "part int, seq int, first long, n_tokens long, segment binary"


def write_segment(doc_ids: list[int | None], ids: list[bytes], kind: str = "<u4") -> bytes:
    """``ids``: of each document, as bytes of ``kind`` each."""
    values = np.frombuffer(b"".join(ids), kind)
    valid = np.array([d is not None for d in doc_ids], bool)
    lengths = np.array([len(x) for x in ids], np.int64) // values.itemsize
    levels = []
    while True:
        more = values > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        sums = np.bitwise_count(bits.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        levels += [struct.pack("<Q", len(values)), values.astype("u1").tobytes(), bits.tobytes(), (np.cumsum(sums) - sums).astype("<u4").tobytes()]
        values = values[more] >> 8
        if not len(values):
            break
    head = struct.pack("<4sIQI", b"DAC1", len(doc_ids), int(lengths.sum()), len(levels) // 4)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    return b"".join([head, np.packbits(valid, bitorder="little").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), offsets.tobytes(), *levels])


class Segment:
    """A written segment; views into its bytes, no copies."""

    def __init__(self, raw: bytes):
        magic, self.n_docs, self.n_tokens, n_levels = struct.unpack_from("<4sIQI", raw)
        if magic != b"DAC1":
            raise ValueError("not a segment")
        at = struct.calcsize("<4sIQI")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.valid = np.unpackbits(take("u1", -(-self.n_docs // 8)), count=self.n_docs, bitorder="little").astype(bool)
        self.doc_ids, self.offsets = take("<i8", self.n_docs), take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-n // BLOCK)
            self.levels.append((take("u1", n), take("u1", blocks * BLOCK // 8), take("<u4", blocks)))

    @staticmethod
    def _rank(level: tuple, i: int) -> int:
        """Set bits before place ``i`` of a level: the directory's count and less than a block of bits."""
        chunks, bitmap, ranks = level
        if i >= len(chunks):
            if not len(chunks):
                return 0
            block = len(ranks) - 1
            return int(ranks[block]) + int.from_bytes(bitmap[block * BLOCK // 8 :].tobytes(), "little").bit_count()
        block = i // BLOCK
        inside = int.from_bytes(bitmap[block * BLOCK // 8 : (i >> 3) + 1].tobytes(), "little")
        return int(ranks[block]) + (inside & ((1 << (i - block * BLOCK)) - 1)).bit_count()

    def token(self, i: int) -> int:
        """Id at place ``i``, by one look and one rank in each level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = 0
        for k, level in enumerate(self.levels):
            out |= int(level[0][i]) << (8 * k)
            if not level[1][i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return out

    def span(self, a: int, b: int) -> np.ndarray:
        """Ids at places ``a`` to ``b`` (without it), by two ranks in each level; no other id is decoded."""
        parts = []
        for level in self.levels:
            if a >= b:
                break
            chunks, bitmap, _ = level
            more = np.unpackbits(bitmap[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a].view(bool)
            parts.append((chunks[a:b], more))
            a = self._rank(level, a)
            b = a + int(np.count_nonzero(more))
        values = np.zeros(0, "<u4")
        for chunks, more in reversed(parts):
            here = chunks.astype("<u4")
            if len(values):
                here[more] |= values << 8
            values = here
        return values

    def tokens(self) -> np.ndarray:
        """All ids."""
        return self.span(0, self.n_tokens)

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.offsets[k]), int(self.offsets[k + 1]))


class Bounds:
    """Parts of a range partitioning by (doc_id, hash): null first, then quantiles of doc_id."""

    def __init__(self, quantiles: list[int], nulls: int, rows: int, parts: int):
        # parts of null doc_ids in proportion; the quantiles part the other rows among the rest
        self.nulls = min(parts - 1, round(parts * nulls / rows)) if rows else 0
        n = max(1, parts - self.nulls)
        self.cuts = np.array([quantiles[k * len(quantiles) // n] for k in range(1, n)] if quantiles else [], np.int64)

    def part(self, doc_ids: list[int | None], hashes: list[int]) -> np.ndarray:
        ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
        null = np.array([d is None for d in doc_ids], bool)
        low = np.where(null, 0, self.nulls + np.searchsorted(self.cuts, ids, "left"))
        high = np.where(null, max(0, self.nulls - 1), self.nulls + np.searchsorted(self.cuts, ids, "right"))
        share = (np.array(hashes, np.uint64) >> np.uint64(32)).astype(np.int64)
        return low + ((share * (high - low + 1)) >> 32)


def bounds(docs: DataFrame, parts: int) -> Bounds:
    """From one scan of doc_id; the driver gets four quantiles for each part."""
    n = 4 * parts
    marks = F.percentile_approx("doc_id", F.array(*(F.lit(k / n) for k in range(n))), F.lit(50 * n)).alias("q")
    r = docs.select(F.col("doc_id").cast("long")).agg(marks, F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("known")).first()
    return Bounds(list(r["q"] or []), r["rows"] - r["known"], r["rows"], parts)


def write(docs: DataFrame, path: str, end_id: int = 2, vocabulary: str | None = None) -> None:
    """Writes the file set of ``docs`` (doc_id, text) at ``path``."""
    vocabulary, parts = vocabulary or tokens.default_path(), parallelism(docs.sparkSession)
    kind = tokens.Encoder(vocabulary).kind
    width, cut = int(kind[2]), bounds(docs, parts)

    def encoded(batches):
        encoder = tokens.encoder(vocabulary)
        for batch in batches:
            ids, at = tokens.with_end(*encoder.encode_array(batch.column(1)), end_id)
            column = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at * width), pa.py_buffer(ids)]).cast(pa.binary())
            hashes = [xxhash.xxh3_64_intdigest(x.as_buffer()) for x in column]
            ties = np.array(hashes, np.uint64) ^ np.uint64(1 << 63)  # so that signed order is the hashes'
            yield pa.RecordBatch.from_arrays([pa.array(cut.part(batch.column(0).to_pylist(), hashes), pa.int32()), batch.column(0), pa.array(ties.view(np.int64)), column], names=["part", "doc_id", "tie", "ids"])

    def segments(batches):
        doc_ids, ids, size, seq, first, part = [], [], 0, 0, 0, -1

        def segment():
            n = size // width
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first": pa.array([first], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "segment": pa.array([write_segment(doc_ids, ids, kind)], pa.binary())})

        for batch in batches:
            for p, doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if p != part or size >= width * SEGMENT:
                    if doc_ids:
                        yield segment()
                    seq, first = (seq + 1, first + size // width) if p == part else (0, 0)
                    doc_ids, ids, size, part = [], [], 0, p
                doc_ids.append(doc_id)
                ids.append(x)
                size += len(x)
        if doc_ids:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encoded, "part int, doc_id long, tie long, ids binary")
    ordered = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "tie").select("part", "doc_id", "ids")
    ordered.mapInArrow(segments, SEGMENTS).write.mode("overwrite").option("compression", "lz4").parquet(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the file set at ``path``, each read by its place in its segment."""
    files = spark.read.parquet(path)
    sums = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, total = {}, 0
    for part, n in sums:
        before[part], total = total, total + n

    def run(batches):
        for batch in batches:
            for part, first, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seg = Segment(raw)
                at = seg.offsets
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(seg.doc_ids, pa.int64(), mask=~seg.valid),
                    "start": pa.array(at[:-1] + (before[part] + first), pa.int64()),
                    "n_tokens": pa.array(np.diff(at), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(seg.document(k)) for k in range(seg.n_docs)], pa.int64()),
                })

    return files.select("part", "first", "segment").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-files")
    write(read(spark, sf_dir, "documents"), scratch.path("dac"))
    return scan(spark, scratch.path("dac"))
