"""Domain entities from the driver's tables: utterances and words from conversations, turns and windows from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Spoken time of a character, where nothing better is known.
MS_PER_CHAR = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def before(*order):
    return lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, pos, speaker, text, dur_ms, start_ms, end_ms: turns laid end to end, MS_PER_CHAR for each character."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("dur_ms", (MS_PER_CHAR * F.length("text")).cast("long"))
    t = t.withColumn("start_ms", F.coalesce(F.sum("dur_ms").over(before("pos")("rec_id")), F.lit(0)))
    return t.withColumn("end_ms", F.col("start_ms") + F.col("dur_ms"))


UTTERANCES_SQL = f"""utterances AS (
  SELECT *, start_ms + dur_ms AS end_ms FROM (
    SELECT *, CAST(coalesce(sum(dur_ms) OVER (PARTITION BY rec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM (
      SELECT conv_id AS rec_id, turn AS pos, role AS speaker, coalesce(text, '') AS text, CAST({MS_PER_CHAR} * length(coalesce(text, '')) AS BIGINT) AS dur_ms FROM conversations)))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id (day), seq, start_ms, end_ms, speaker, label: each event a turn of ``value`` seconds."""
    e = table(spark, sf_dir, "events").where("value is not null and ts is not null")
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("rec_id"), F.col("event_id").alias("seq"), start.alias("start_ms"),
        (start + F.floor(F.col("value") * 1000)).cast("long").alias("end_ms"), F.col("user_id").alias("speaker"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("label"),
    )


TURNS_SQL = """turns AS (
  SELECT strftime(ts, '%Y-%m-%d') AS rec_id, event_id AS seq, epoch_us(ts) // 1000 AS start_ms,
         CAST(epoch_us(ts) // 1000 + CAST(floor(value * 1000) AS BIGINT) AS BIGINT) AS end_ms, user_id AS speaker, 'u' || CAST(user_id AS VARCHAR) AS label
  FROM events WHERE value IS NOT NULL AND ts IS NOT NULL)"""


def clauses(turn_rows: DataFrame, width_ms: int = 600_000) -> DataFrame:
    """rec_id, clause, start_ms, end_ms: the fixed windows of each recording that its turns begin in."""
    return turn_rows.select("rec_id", F.expr(f"start_ms div {width_ms}").alias("clause")).distinct().select(
        "rec_id", "clause", (F.col("clause") * width_ms).alias("start_ms"), ((F.col("clause") + 1) * width_ms).alias("end_ms")
    )


CLAUSES_SQL = "clauses AS (SELECT DISTINCT rec_id, start_ms // 600000 AS clause, start_ms // 600000 * 600000 AS start_ms, (start_ms // 600000 + 1) * 600000 AS end_ms FROM turns)"
