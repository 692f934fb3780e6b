"""Packing of documents into sequences by hierarchical residual best fit.

Each partition packs its pieces by best fit, largest first. Bins that are full, or nearly so, are sequences. The bins
with room left become the items of the next round, which packs those of eight tasks in one, and so on up a tree until one
task is left, at every size. Best fit leaves at most one bin of half the capacity or less in a task, and two fuller ones never fit
together; so the eight tasks that merge have eight bins at most that can still be joined to others, and a task sends at most eight bins
of each fill up the tree. The others could not be joined in any later round, and a task has 8 * 8 bins of a fill at most. Each round is
a written table, so a lost executor costs only a reread.

Null text counts as empty: a document of the end id alone. Null doc_ids and repeated rows are packed as rows of their
own. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, read

#: Room that a nearly full bin may have, tasks that merge into one.
NEARLY, FAN_IN = 2, 8

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
MEMBERS = [*FIELDS, ("offset", pa.int64())]
BIN = f"bin_id long, fill long, goes_on boolean, members array<struct<{PIECE}, offset long>>"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes: largest first, each into the fullest bin that has room. Ties by index."""
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = open_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > size:
            by_room[room - size].append(b)
            open_rooms |= 1 << (room - size)
    return bins


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: only the first may be short of the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str) -> DataFrame:
    def run(batches):
        encoder = tokens.encoder(vocabulary)
        for batch in batches:
            ids, at = tokens.with_end(*encoder.encode_array(batch.column(1)), end_id)
            raw, rows = memoryview(ids.astype("<u4").tobytes()), [[] for _ in FIELDS]
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
                for k, (start, length) in enumerate(cut(b - a, capacity)):
                    for col, x in zip(rows, (doc_id, k, start, length, zlib.crc32(raw[4 * (a + start) : 4 * (a + start + length)]))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, FIELDS)], names=[n for n, _ in FIELDS])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def _bins(sizes: np.ndarray, of: np.ndarray, members: list[pa.Array], capacity: int, first_id: int) -> pa.RecordBatch:
    """Packs items; item i holds the members of[i]:of[i + 1]."""
    packed = best_fit(sizes, capacity)
    take = np.concatenate([np.arange(of[i], of[i + 1]) for b in packed for i in b]) if packed else np.zeros(0, int)
    columns = [c.take(pa.array(take, pa.int64())) for c in members[: len(FIELDS)]]
    counts = np.array([sum(int(of[i + 1] - of[i]) for i in b) for b in packed], int)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(int)
    length = columns[3].to_numpy()
    at = np.cumsum(length) - length
    columns.append(pa.array(at - np.repeat(at[starts[:-1]], counts), pa.int64()))
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(pa.struct(MEMBERS))))
    fill, goes_on, of_fill = [int(sizes[b].sum()) for b in packed], [], Counter()
    for f in fill:
        of_fill[f] += 1
        goes_on.append(f < capacity - NEARLY and of_fill[f] <= FAN_IN)
    return pa.RecordBatch.from_arrays([pa.array(range(first_id, first_id + len(packed)), pa.int64()), pa.array(fill, pa.int64()), pa.array(goes_on, pa.bool_()), lists], names=["bin_id", "fill", "goes_on", "members"])


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    cut_up = scratch.save(pieces(docs, capacity, end_id, vocabulary or tokens.default_path()), "pieces")

    def first_round(batches):
        got = list(batches)
        members = [pa.concat_arrays([b.column(i) for b in got] or [pa.array([], t)]) for i, (_, t) in enumerate(FIELDS)]
        yield _bins(members[3].to_numpy(), np.arange(len(members[3]) + 1), members, capacity, TaskContext.get().partitionId() << 32)

    def later_round(k: int):
        def run(batches):
            got = [b for b in batches if b.num_rows]
            if got:
                lists = pa.concat_arrays([b.column(1) for b in got])
                sizes = np.concatenate([b.column(0).to_numpy() for b in got])
                of = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                yield _bins(sizes, of, lists.flatten().flatten(), capacity, (k << 56) + (TaskContext.get().partitionId() << 32))

        return run

    small = cut_up.where(F.col("length") < capacity)
    bins = scratch.save(small.mapInArrow(first_round, BIN), "round0")
    task = F.shiftright("bin_id", 32).bitwiseAND((1 << 24) - 1).cast("int")
    rounds, tasks, k = [], (bins.agg(F.max(task)).first()[0] or 0) + 1, 0
    while tasks > 1:
        rounds.append(bins.where(~F.col("goes_on")))
        k, tasks = k + 1, -(-tasks // FAN_IN)
        up = bins.where("goes_on").repartitionById(tasks, F.floor(task / FAN_IN).cast("int"))
        bins = scratch.save(up.select("fill", "members").mapInArrow(later_round(k), BIN), f"round{k}")
    rounds.append(bins)
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    packed = out.select(F.col("bin_id").alias("sequence_id"), F.inline("members")).select(*(n for n, _ in FIELDS), "sequence_id", "offset")
    full = cut_up.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
