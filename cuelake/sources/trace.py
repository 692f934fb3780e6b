"""Profiler traces: JSON lists of timed events of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "cat string, name string, ts long, dur long, args struct<op_name: string>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, op, ts, dur (microseconds) of the events that are operators' runs."""
    events = spark.read.schema(SCHEMA).json(path, multiLine=True).select(F.input_file_name().alias("path"), "*")
    op = F.coalesce("args.op_name", "name", F.lit("Unknown"))
    return events.where("cat = 'Node'").select("path", op.alias("op"), F.coalesce("ts", F.lit(0)).alias("ts"), F.coalesce("dur", F.lit(0)).alias("dur"))


def rollup(events: DataFrame, runs: int) -> DataFrame:
    """path, op, mean_ms and calls of a run, and percent of the file's time. Each operator's first run in a file, which warms up, is left out if it has
    as many events as there were runs; shares under 0.1 % are left out, the dearest come first."""
    w = Window.partitionBy("path", "op")
    marked = events.withColumns({"place": F.row_number().over(w.orderBy("ts")), "n": F.count(F.lit(1)).over(w)})
    warm = F.col("n") >= runs if runs > 1 else F.lit(False)
    kept = marked.where(~warm | (F.col("place") > F.floor(F.col("n") / runs)))
    calls, total = F.count(F.lit(1)), F.sum("dur") / 1000.0
    g = kept.groupBy("path", "op", warm.alias("warm")).agg(
        F.when(warm, total / (runs - 1 or 1)).otherwise(total / calls).alias("mean_ms"), F.when(warm, F.floor(calls / (runs - 1 or 1))).otherwise(calls).alias("calls")
    ).where("mean_ms > 0")
    share = g.withColumn("percent", 100 * F.col("mean_ms") / F.sum("mean_ms").over(Window.partitionBy("path")))
    return share.where("percent >= 0.1").drop("warm").orderBy("path", F.desc("mean_ms"))
