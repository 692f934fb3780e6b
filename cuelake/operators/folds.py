"""Greedy folds over recordings of any length: in stretches side by side, with the same rows as one fold over the whole.

A fold takes a recording's rows in order and gives outputs, each of which begins with a row; where one begins, the fold's state is as if nothing had gone before. That
holds at some rows whatever the rows before them are: after a sign that ends a clause, between two speakers. So a recording is cut into buckets, and each is
gone through by itself from the first such row (``certain`` finds it) on. The rows before it, and those of the last outputs, which the next bucket may go on
with, are left open. In a second pass each run of open rows that belong together is folded, in the order of the recording, and the outputs are numbered. A recording
costs two shuffles: one of its rows, and one of its outputs and the few open rows. A task holds a bucket, or a run of open rows; the latter is long only where no row of many buckets
is certain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .rows import batches_of


def _groups(batches, n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(keys, rows) of each run of rows with the same first columns."""
    keys, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if keys is None or row[:n_keys] != keys:
                if rows:
                    yield keys, rows
                keys, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield keys, rows


def fold(
    df: DataFrame, order: list[str], columns: list[str], bucket: Column, out: str, process: Callable[[list[tuple], bool, int | None], list[tuple[int, tuple]]],
    certain: Callable[[list[tuple], int | None], int | None], reach: tuple[Column, Column] | None = None, start: int = 0, loose: int = 1,
) -> DataFrame:
    """rec_id, idx (from 1) and the columns of ``out`` of each output, in order.

    ``process(rows, first, after)`` gives (number of its first row, output) of the outputs of rows (tuples of ``columns``): ``first`` if they are the recording's first, ``after``:
    place ``start`` of the output that follows them, if one does. ``certain(rows, reached)`` gives the number of a row, from 1, at which the fold's state
    is certain, or None. ``loose`` outputs at the end of a bucket may still change with what follows. ``bucket`` must not fall as ``order`` (one or two numbers) goes up. ``reach``: (last bucket that a row may have a say in, how far it reaches);
    ``reached`` is the farthest that earlier buckets' rows reach into this one."""
    kept, outs, rec = [df.schema[c] for c in columns], StructType.fromDDL(out).fields, df.schema["rec_id"]
    own_key = [F.col(c).cast("long").alias(f"at{i}") for i, c in enumerate([*order, *order][:2])]
    last, far = reach or (bucket, F.lit(None))
    spread = df.select("rec_id", bucket.cast("long").alias("bucket"), last.cast("long").alias("last"), far.cast("long").alias("far"), *own_key, *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    if reach is not None:  # a row is also seen where it has a say, but for its values
        spread = spread.withColumn("to", F.explode(F.sequence("bucket", F.greatest("last", "bucket"))))
    else:
        spread = spread.withColumn("to", F.col("bucket"))
    is_own = F.col("to") == F.col("bucket")
    spread = spread.select("rec_id", "to", is_own.alias("own"), "at0", "at1", "far", *(F.when(is_own, F.col(f"c{i}")).alias(f"c{i}") for i in range(len(columns))))
    marks = [*(StructField(name, LongType()) for name in ("at0", "at1", "at2")), StructField("open", BooleanType()), StructField("fresh", BooleanType()), StructField("after", LongType())]
    first = StructType([rec, *marks, *(StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)), *(StructField(f"o{i}", f.dataType) for i, f in enumerate(outs))])
    n, no_row, no_out = len(columns), (None,) * len(columns), (None,) * len(outs)

    def pass_one(batches) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (who, _), group in _groups(batches, 2):
                reached = max((g[3] for g in group if not g[0] and g[3] is not None), default=None)
                own = [g for g in group if g[0]]
                given = [g[4:] for g in own]
                cut = certain(given, reached) if own else None
                cut = len(own) if cut is None else cut
                found = process(given[cut:], False, None) if cut < len(own) else []
                after = found[0][1][start] if found else None
                settled = found[: max(0, len(found) - loose)]
                tail = cut + found[len(settled)][0] if found else cut
                for k, g in enumerate(own[:cut]):
                    yield who, g[1], g[2], k, True, False, after, *g[4:], *no_out
                for k, values in settled:
                    yield who, own[cut + k][1], own[cut + k][2], cut + k, False, False, None, *no_row, *values
                for k, g in enumerate(own[tail:], tail):
                    yield who, g[1], g[2], k, True, k == tail, None, *g[4:], *no_out

        yield from batches_of(rows(), first)

    second = StructType([rec, StructField("idx", LongType()), *outs])

    def pass_two(batches) -> Iterator[pa.RecordBatch]:
        def of(group: list[tuple]) -> Iterator[tuple]:
            held, seen, after = [], False, None
            for _, _, _, is_open, fresh, then, *rest in group:
                if held and (fresh or not is_open):
                    yield from (values for _, values in process(held, not seen, after))
                    held, seen, after = [], True, None
                if is_open:
                    held.append(tuple(rest[:n]))
                    after = then
                else:
                    seen = True
                    yield tuple(rest[n:])
            if held:
                yield from (values for _, values in process(held, not seen, after))

        def rows() -> Iterator[tuple]:
            for (who,), group in _streams(batches):
                for k, values in enumerate(of(group), 1):
                    yield who, k, *values

        yield from batches_of(rows(), second)

    one = spread.repartition("rec_id", "to").sortWithinPartitions("rec_id", "to", "own", "at0", "at1").mapInArrow(pass_one, first)
    two = one.repartition("rec_id").sortWithinPartitions("rec_id", "at0", "at1", "at2").mapInArrow(pass_two, second)
    return two.withColumn("idx", F.col("idx").cast("int"))


def _streams(batches) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) of each run of rows with the same first column, the rows one by one; they have to be taken before the next."""
    flat = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    row = next(flat, None)
    while row is not None:
        who = row[0]

        def own() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == who:
                yield row[1:]
                row = next(flat, None)

        yield (who,), own()
