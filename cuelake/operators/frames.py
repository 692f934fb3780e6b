"""Frames of chunks that overlap: masks, sums over chunks, upsampling, decoding, and spans of active frames.

All is windows and aggregates; a chunk is a few hundred frames, so a window never holds more than that or one speaker of one recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .diarize import first_largest


def decode_classes(scores: DataFrame, vector: str, classes: DataFrame) -> DataFrame:
    """``scores`` with class, the first largest of ``vector``, and members from ``classes`` (class, members; one row for each class of a model)."""
    return scores.withColumn("class", first_largest(F.col(vector))).join(F.broadcast(classes), "class", "left")


def embedding_mask(frames: DataFrame, keys: list[str], frame: str, speaker: str, least: int = 1) -> DataFrame:
    """``frames`` (0/1 active) with used: active where nobody else of the chunk is; plain active if that leaves at most ``least`` frames."""
    alone = F.sum("active").over(Window.partitionBy(*keys, frame)) < 2
    clean = frames.withColumn("clean", F.when(alone, F.col("active")).otherwise(0))
    enough = F.sum("clean").over(Window.partitionBy(*keys, speaker)) > least
    return clean.withColumn("used", F.when(enough, F.col("clean")).otherwise(F.col("active"))).drop("clean")


def mark_inactive(clusters: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """``clusters`` (keys, cluster) with cluster -2 where no frame of the keys is active."""
    seen = frames.groupBy(*keys).agg(F.max("active").alias("seen"))
    return clusters.join(seen, keys, "left").withColumn("cluster", F.when(F.coalesce("seen", F.lit(0)) == 0, F.lit(-2)).otherwise(F.col("cluster"))).drop("seen")


def overlap_add(frames: DataFrame, keys: list[str], chunk: str, frame: str, score: str, chunk_step: float, frame_step: float, average: bool = True, missing: float = 0.0) -> DataFrame:
    """keys, at, value: for each frame of the recording the mean (or sum) over the chunks that cover it. Null and NaN scores don't
    count; a frame with no others has ``missing``. A chunk begins at the frame nearest to its start, halves to even."""
    at = (F.greatest(F.lit(0), F.rint(F.col(chunk) * F.lit(chunk_step) / F.lit(frame_step)).cast("int")) + F.col(frame)).alias("at")
    valid = F.col(score).isNotNull() & ~F.isnan(F.col(score))
    sums = frames.groupBy(*keys, at).agg(F.sum(F.when(valid, F.col(score).cast("double"))).alias("total"), F.count(F.when(valid, 1)).alias("weight"))
    value = F.col("total") / F.col("weight") if average else F.col("total")
    return sums.select(*keys, "at", F.when(F.col("weight") > 0, value).otherwise(F.lit(float(missing))).alias("value"))


def upsample(values: Column, size: int) -> Column:
    """An array of ``size`` values, each the nearest by place of the array given."""
    n = F.size(values)
    places = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.least(F.floor(i * (n / F.lit(size))).cast("int"), n - 1) + 1)
    return F.when(n == size, values).when(n > 0, F.transform(places, lambda i: F.element_at(values, i)))


def active_spans(frames: DataFrame, keys: list[str], frame: str, score: str, step: int, duration: int, onset: float = 0.5, offset: float = 0.5) -> DataFrame:
    """keys, run, start, end of spans in which the score has risen over ``onset`` and not fallen under ``offset`` yet.

    Edges are the middles of frames (``step`` and ``duration`` in any whole unit): the end is that of the first frame that is not active any more, or of the last frame of all."""
    w = Window.partitionBy(*keys).orderBy(frame)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col(frame) * step + F.floor(F.lit(duration) / 2).cast("long")
    decided = F.when(F.col(score) > onset, 1).when(F.col(score) < offset, 0)
    marked = frames.withColumn("on", F.coalesce(F.last(decided, ignorenulls=True).over(upto), F.lit(0)))
    marked = marked.withColumns({"edge": F.when(F.col("on") == F.lag("on").over(w), 0).otherwise(1), "from": middle, "to": F.coalesce(F.lead(middle).over(w), middle)})
    runs = marked.withColumn("run", F.sum("edge").over(upto)).where("on = 1")
    return runs.groupBy(*keys, "run").agg(F.min("from").alias("start"), F.max("to").alias("end")).where("end > start")


def cluster_bounds(n: Column, wanted: Column, least: Column, most: Column) -> tuple[Column, Column, Column]:
    """(wanted, least, most) numbers of clusters for ``n`` vectors; null or 0: not asked for. Bounds that cross raise an error."""
    asked = lambda c: F.nullif(c, F.lit(0))
    low = F.greatest(F.lit(1), F.least(n, F.coalesce(asked(wanted), asked(least), F.lit(1))))
    high = F.greatest(F.lit(1), F.least(n, F.coalesce(asked(wanted), asked(most), n)))
    high = F.when(low > high, F.raise_error(F.lit("the least number of clusters is over the most")).cast("int")).otherwise(high)
    return F.when(low == high, low).otherwise(wanted), low, high


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_absolute_error(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda p, q: F.abs(p.cast("double") - q.cast("double")))
    return F.try_divide(F.aggregate(gaps, F.lit(0.0), lambda s, p: s + p), F.size(a))
