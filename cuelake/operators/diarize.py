"""Numbers behind speaker labels: powerset classes, frame grids, centroids, nearest clusters, clustering."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def powerset(spark: SparkSession, speakers: int, together: int) -> DataFrame:
    """class and members: sets of at most ``together`` speakers, smaller ones first, then in order."""
    sets = [s for n in range(together + 1) for s in itertools.combinations(range(speakers), n)]
    rows = [(i, "".join("1" if k in s else "0" for k in range(speakers))) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "class int, members string")


def first_largest(scores):
    """Place (from 0) of the first of the largest values of an array column."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def closest_frame(at, start: float, step: float, duration: float):
    """Number of the frame whose middle is nearest, halves to even."""
    return F.rint((at - start - duration / 2) / step).cast("int")


def whole(vector):
    """Whether an array has no entry that is null or not a number."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def usable(frames: DataFrame, keys: list[str], frame: str, speaker: str, share: float = 0.2, vectors: DataFrame | None = None, vector: str = "embedding") -> DataFrame:
    """keys, speaker, clean, n: speakers that are alone in at least ``share`` of their chunk's frames, and, given ``vectors`` (keys, speaker, ``vector``), have a vector of numbers only."""
    alone = F.sum("active").over(Window.partitionBy(*keys, frame)) < 2
    counted = frames.withColumn("alone", F.when(alone & (F.col("active") == 1), 1).otherwise(0))
    sums = counted.groupBy(*keys, speaker).agg(F.sum("alone").alias("clean"), F.countDistinct(frame).alias("n"))
    found = sums.where(F.col("clean") >= share * F.col("n"))
    return found if vectors is None else found.join(vectors.where(whole(F.col(vector))).select(*keys, speaker).distinct(), [*keys, speaker], "left_semi")


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """label, dim, mean: element-wise means; partial sums on the map side, one row for each label and dimension shuffled."""
    return vectors.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))


def nearest(vectors: DataFrame, key: str, vector: str, centers: DataFrame, most: int = 50_000) -> DataFrame:
    """key and label of the center (label, center array) at the least cosine distance, the smallest label in a tie.

    There are as many centers as labels; an array of at most about ``most`` of them is broadcast at a time, and each vector keeps the best it has met."""
    blocks = max(1, -(-centers.count() // most))
    dealt = centers.select(F.pmod(F.xxhash64("label"), F.lit(blocks)).alias("__block"), "label", "center")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    scored = F.transform("__centers", lambda c: F.struct((-dot(F.col(vector), c["center"]) / F.sqrt(dot(c["center"], c["center"]))).alias("distance"), c["label"].alias("label")))
    out, best = vectors, None
    for k in range(blocks):
        one = dealt.where(F.col("__block") == k).agg(F.sort_array(F.collect_list(F.struct("label", "center"))).alias("__centers"))
        here = F.array_min(scored)
        out = out.join(F.broadcast(one)).withColumn("__best", here if best is None else F.least(best, here)).drop("__centers")
        best = F.col("__best")
    return out.select(key, F.col("__best.label").alias("nearest"))
