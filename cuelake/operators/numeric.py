"""Exact order statistics of groups that no task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_percentile(df: DataFrame, key: str, value: str, share: float, accuracy: int = 1000) -> DataFrame:
    """key, percentile, n: the value at place ``share * (known values - 1)``, between two places in proportion; n counts all rows.

    Sketches of each group give bounds around the place, four times as far from it as the sketch may err. Values below are only counted; those between, a few
    thousandths of a group, are counted by value and ranked."""
    near = [max(0.0, share - 4 / accuracy), min(1.0, share + 4 / accuracy)]
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("known"), F.percentile_approx(value, F.array(*map(F.lit, near)), F.lit(accuracy)).alias("q"), F.min(value).alias("least"), F.max(value).alias("most"))
    place = F.col("known").cast("double") - 1
    g = g.withColumns({"at": place * share, "low": F.get("q", F.lit(0)), "high": F.get("q", F.lit(1))})
    # a small group is taken whole: there the margin of the bounds is less than the places beside
    few = F.col("known") < accuracy
    g = g.withColumns({"low": F.when(few | (F.col("at") < 1), F.col("least")).otherwise(F.col("low")), "high": F.when(few | (F.col("at") > place - 1), F.col("most")).otherwise(F.col("high"))})
    # one row for each group
    both = df.where(F.col(value).isNotNull()).select(F.col(key).alias("__key"), F.col(value).alias("__v")).join(g.select(key, "low", "high", "at"), F.col("__key").eqNullSafe(F.col(key)))
    counts = both.where("__v <= high").groupBy(key, "at", F.when(F.col("__v") >= F.col("low"), F.col("__v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key).orderBy(F.asc_nulls_first("v"))
    upto = counts.withColumn("last", F.sum("c").over(w) - 1)  # place of the last row of each value
    at = lambda p: F.min(F.when((F.col("last") >= p) & F.col("v").isNotNull(), F.col("v")))
    found = upto.groupBy(key, "at").agg(at(F.floor("at")).alias("a"), at(F.ceil("at")).alias("b"))
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    return g.select(F.col(key).alias("__key"), "n").join(found.select(key, value_at.alias("percentile")), F.col("__key").eqNullSafe(F.col(key)), "left").select(F.col("__key").alias(key), "percentile", "n")
