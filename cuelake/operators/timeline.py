"""Windows over the rows of a timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normalize(rows: DataFrame, keys: list[str], order: list[str], least_ms: int = 600) -> DataFrame:
    """Rows that last ``least_ms`` if the next leaves room, and end 20 ms before it; at the least 100 and 50 ms long. Starts never change,
    so the next row's start is all that a row needs. Rows are numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    start, following = F.col("start_ms"), F.lead("start_ms").over(w)
    end = F.when(F.col("end_ms") <= start, start + least_ms).otherwise(F.col("end_ms"))
    room = F.when(following.isNull(), start + least_ms).otherwise(F.least(start + least_ms, F.greatest(start + 100, following - 20)))
    end = F.when(end - start < least_ms, room).otherwise(end)
    end = F.when(end > following, F.greatest(start + 50, following - 20)).otherwise(end)
    return rows.select(*keys, F.row_number().over(w).alias("idx"), "start_ms", end.alias("end_ms"), "text", "speaker")


def proportional(parts: DataFrame, keys: list[str], order: str, weight, start: str, total: str) -> DataFrame:
    """Shares ``total`` milliseconds from ``start`` among the parts of each key by weight; running floors, so that nothing is lost."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(weight).over(Window.partitionBy(*keys))
    to = F.col(start) + F.floor(F.col(total) * upto / whole)
    since = F.col(start) + F.floor(F.col(total) * (upto - weight) / whole)
    return parts.withColumn("part_start_ms", since.cast("long")).withColumn("part_end_ms", to.cast("long"))


def fixed_chunks(recordings: DataFrame, length: str, size: int) -> DataFrame:
    """chunk, chunk_start, chunk_end of each recording: ``ceil(length / size)`` chunks, the last cut short."""
    chunks = recordings.where(F.col(length) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr(f"cast(({length} - 1) div {size} as int)"))))
    return chunks.withColumn("chunk_start", F.col("chunk").cast("long") * size).withColumn("chunk_end", F.least(F.col(length), (F.col("chunk").cast("long") + 1) * size))


def sliding_chunks(recordings: DataFrame, length: str, size: int, step: int) -> DataFrame:
    """chunk and chunk_start of windows of ``size`` every ``step``; one more, padded, for a remainder or a short recording."""
    whole = F.when(F.col(length) >= size, F.expr(f"({length} - {size}) div {step} + 1")).otherwise(0)
    rest = F.when((F.col(length) < size) | (F.expr(f"({length} - {size}) % {step}") > 0), 1).otherwise(0)
    n = (whole + rest).cast("int")
    return recordings.where(F.col(length) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("chunk_start", F.col("chunk").cast("long") * step)


def merge_languages(rows: DataFrame, keys: list[str], order: str, language: str) -> DataFrame:
    """Blank languages dropped, repeats in a row made one, the rest joined by commas."""
    w = Window.partitionBy(*keys).orderBy(order)
    named = rows.where(F.trim(F.coalesce(language, F.lit(""))) != "")
    kept = named.withColumn("new", F.when(F.col(language) == F.lag(language).over(w), 0).otherwise(1)).where("new = 1")
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, language))), lambda x: x[language]), ",").alias("languages"))


def looping(tokens: DataFrame, keys: list[str], order: str, token: str, window: int = 15, distinct: int = 3) -> DataFrame:
    """Marks the tokens where over ``window`` tokens have come and the last ``window`` hold at most ``distinct`` different ones."""
    w = Window.partitionBy(*keys).orderBy(order)
    seen = F.size(F.collect_set(token).over(w.rowsBetween(1 - window, 0)))
    return tokens.withColumn("loops", (F.row_number().over(w) > window) & (seen <= distinct))


def run_statistics(steps: DataFrame, key: str) -> DataFrame:
    """Of the steps of each run (``key``, dur_ms, chars, tokens, ms, goes_in): audio_ms, chars, tokens, run_ms, rtf (time taken over length of audio), tokens_per_s, and prefill_per_s and decode_per_s
    of the steps that go in and of the others. 0 where there is nothing to divide by."""
    into = lambda c: F.sum(F.when(F.col("goes_in"), F.col(c)).otherwise(0))
    r = steps.groupBy(key).agg(F.sum("dur_ms").alias("audio_ms"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"), F.sum("ms").alias("run_ms"), into("tokens").alias("in_tokens"), into("ms").alias("in_ms"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    speed = lambda n, ms: ratio(n * 1000, ms)
    return r.select(
        key, "audio_ms", "chars", "tokens", "run_ms", ratio(F.col("run_ms"), F.col("audio_ms")).alias("rtf"), speed(F.col("tokens"), F.col("run_ms")).alias("tokens_per_s"),
        speed(F.col("in_tokens"), F.col("in_ms")).alias("prefill_per_s"), speed(F.col("tokens") - F.col("in_tokens"), F.col("run_ms") - F.col("in_ms")).alias("decode_per_s"),
    )
