"""What surrounds the recognition and alignment of chunks: what goes in with each chunk, and how results come back in order.

An item is a word with its times; a recording's chunks and a chunk's items are numbered. Lists are of one batch, chunk or recording.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .rows import batches_of

#: Milliseconds of an alignment class.
CLASS_MS = 80
# What the aligner reads around a text's words.
STAMPS, AUDIO = "<timestamp><timestamp>", "<|audio_start|><|audio_pad|><|audio_end|>"


def shift(items: DataFrame, offset: str, digits: int | None = 3, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Items' times in seconds moved by ``offset``, rounded to ``digits`` (None: not)."""
    moved = lambda c: F.col(c) + F.col(offset) if digits is None else F.round(F.col(c) + F.col(offset), digits)
    return items.withColumns({start: moved(start), end: moved(end)})


def spread(given: DataFrame, batches: DataFrame, key: str, order: str, value: str, strict: bool = True) -> DataFrame:
    """key, place (from 0), value: for each batch (key, n) its n values, or its only value n times. Any other number of values is an
    error, or null values if not ``strict``."""
    lists = given.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("given"))
    n, got = F.col("n").cast("int"), F.coalesce(F.size("given"), F.lit(0))
    none = F.array_repeat(F.lit(None).cast(dict(given.dtypes)[value]), n)
    wrong = F.when(F.raise_error(F.concat(F.lit("batch size mismatch: "), n.cast("string"), F.lit(" and "), got.cast("string"))).cast("string").isNull(), none) if strict else none
    full = F.when(got == n, F.col("given")).when(got == 1, F.array_repeat(F.get("given", F.lit(0)), n)).otherwise(wrong)
    return batches.join(lists, key, "left").select(key, F.posexplode(full).alias("place", value))


def with_context(chunks: DataFrame, recordings: DataFrame, key: str) -> DataFrame:
    """Chunks with the context and the language of their recording. Recordings may be many, so the join is left to the optimizer."""
    return chunks.join(recordings, key, "left")


def scatter(places: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Results back at the places that they were asked for; null at the others."""
    return places.join(results, keys, "left")


def merge_items(items: DataFrame, key: str, chunk: str, order: str, *columns: str) -> DataFrame:
    """key, items: all chunks' items in one list, chunk by chunk; null if there are none."""
    kept = F.filter(F.array_sort(F.collect_list(F.struct(chunk, order, *columns))), lambda x: x[columns[0]].isNotNull())
    return items.groupBy(key).agg(F.when(F.size(kept) > 0, F.transform(kept, lambda x: F.struct(*(x[c].alias(c) for c in columns)))).alias("items"))


def memory(chunks: DataFrame, keys: list[str], order: str, value: str, n: int, out: str = "memory") -> DataFrame:
    """``chunks`` with the values of the ``n`` chunks before each, oldest first."""
    return chunks.withColumn(out, F.collect_list(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)))


def chunk_of_token(tokens: DataFrame, keys: list[str], order: str, value: str, size: int, out: str = "chunk") -> DataFrame:
    """``tokens`` with the number (from 1) of the chunk each falls in. A chunk ends before the first token whose value reaches
    its number times ``size``; a token ends one chunk at most, however far its value jumps. Values don't decrease.

    The number goes up by one or to ``value / size + 1``, whichever is less; less its place, that is a running minimum."""
    w = Window.partitionBy(*keys).orderBy(order)
    place = F.row_number().over(w)
    slack = F.min(F.col("__slack")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return tokens.withColumn("__place", place).withColumn("__slack", F.floor(F.col(value) / size) + 1 - F.col("__place")).withColumn(out, F.col("__place") + F.least(F.lit(1), slack)).drop("__place", "__slack")


def chunk_spans(groups: DataFrame, keys: list[str], order: str, values: str, size: int) -> DataFrame:
    """keys, chunk, first, last: the places (from 1) of the first and the last token of each chunk of ``chunk_of_token``, of tokens that come as lists of values, one after the other by ``order``.

    Only lists are sorted: how many tokens come before a list, and their least slack, is all that it needs of others. It hands on the spans of its own tokens' chunks."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    least = F.array_min(F.transform(values, lambda v, k: F.floor(v / size) - k))  # of the list's slack, but for the tokens before it
    g = groups.select(*keys, order, F.col(values).alias("__values"), F.size(values).cast("long").alias("__n"), least.cast("long").alias("__least"))
    g = g.withColumn("__at", F.coalesce(F.sum("__n").over(w), F.lit(0).cast("long")))
    g = g.withColumn("__slack", F.least(F.lit(1).cast("long"), F.min(F.col("__least") - F.col("__at")).over(w)))
    schema = StructType([*(groups.schema[k] for k in keys), *(StructField(name, LongType()) for name in ("chunk", "first", "last"))])

    def spans(batches) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for i in range(b.num_rows):
                    *key, found, at, slack = (c[i].as_py() for c in b.columns)
                    chunk = first = place = None
                    for place, v in enumerate(found, at + 1):
                        slack = min(slack, v // size + 1 - place)
                        if place + slack != chunk:
                            if first is not None:
                                yield *key, chunk, first, place - 1
                            chunk, first = place + slack, place
                    if first is not None:
                        yield *key, chunk, first, place

        yield from batches_of(rows(), schema)

    found = g.select(*keys, "__values", "__at", "__slack").mapInArrow(spans, schema)
    return found.groupBy(*keys, "chunk").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def timestamp_prompt(words: Column) -> Column:
    """What the aligner reads: each word with two marks for its times, after the audio's place."""
    return F.concat(F.lit(AUDIO), F.array_join(words, STAMPS), F.lit(STAMPS))


def timed_words(words: Column, classes: Column, offset_ms: Column | int = 0) -> Column:
    """Array of (text, start_ms, end_ms): word i has the times of classes 2i and 2i + 1."""
    at = lambda i: F.get(classes, i).cast("long") * CLASS_MS + (F.lit(offset_ms) if isinstance(offset_ms, int) else offset_ms)
    return F.transform(words, lambda w, i: F.struct(w.alias("text"), at(2 * i).alias("start_ms"), at(2 * i + 1).alias("end_ms")))
