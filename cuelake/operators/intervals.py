"""Interval joins and interval algebra over turns and clauses of recordings.

Intervals are half-open, in integer milliseconds. A range predicate alone would compare all pairs of a recording, so
intervals are cut at bucket borders and joined by recording and bucket; a pair that meets in several buckets is kept in the
first bucket that both reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _buckets(df: DataFrame, width: int) -> DataFrame:
    last = F.expr(f"greatest(start_ms, end_ms - 1) div {width}")
    return df.withColumn("bucket", F.explode(F.sequence(F.expr(f"start_ms div {width}"), last)))


def overlap_join(left: DataFrame, right: DataFrame, width: int = 600_000) -> DataFrame:
    """All pairs of the same rec_id that share time; right's columns get the prefix ``r_``; overlap_ms is what they share."""
    r = _buckets(right, width).select("rec_id", "bucket", *(F.col(c).alias(f"r_{c}") for c in right.columns if c != "rec_id"))
    both = _buckets(left, width).join(r, ["rec_id", "bucket"]).where("start_ms < r_end_ms and r_start_ms < end_ms")
    both = both.where(F.col("bucket") == F.expr(f"greatest(start_ms, r_start_ms) div {width}"))
    return both.drop("bucket").withColumn("overlap_ms", F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms"))


def dominant_speaker(clause_rows: DataFrame, turn_rows: DataFrame, keys: list[str], width: int = 600_000, deal: list[str] | None = None) -> DataFrame:
    """``clause_rows`` with the label that shares most time with each; ties go to the label whose turn comes first in the list;
    null where no turn overlaps. A turn without length shares none. A clause without length has the label of the turn at its start, of several that which starts first. ``keys`` name a clause.

    Clauses are read once: a left join keeps those without a turn, and each goes through the votes with its other columns. They are shuffled twice: for the join, where the votes of a bucket are
    added up too, and by ``deal`` (some of rec_id and ``keys``; all of them if None), where a clause's buckets meet. What groups by ``deal`` afterwards needs no third."""
    others = [c for c in clause_rows.columns if c not in (*keys, "rec_id")]
    turns = _buckets(turn_rows.where("end_ms > start_ms"), width).select("rec_id", "bucket", *(F.col(c).alias(f"r_{c}") for c in ("seq", "start_ms", "end_ms", "label")))
    c = clause_rows.withColumn("__end", F.greatest("end_ms", F.col("start_ms") + 1))
    c = c.withColumn("bucket", F.explode(F.sequence(F.expr(f"start_ms div {width}"), F.expr(f"(__end - 1) div {width}")))).alias("c")
    shares = (F.col("start_ms") < F.col("r_end_ms")) & (F.col("r_start_ms") < F.col("__end")) & (F.col("c.bucket") == F.expr(f"greatest(start_ms, r_start_ms) div {width}"))
    met = c.join(turns.alias("r"), (F.col("c.rec_id") == F.col("r.rec_id")) & (F.col("c.bucket") == F.col("r.bucket")) & shares, "left").drop(F.col("r.rec_id"), F.col("r.bucket"))
    point = F.col("end_ms") <= F.col("start_ms")
    shared = F.when(point, 0).otherwise(F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")).cast("long")
    group = list(dict.fromkeys(["rec_id", *keys]))
    rest = F.first(F.struct(*(F.col(x) for x in others))).alias("rest")
    label = F.col("r_label").alias("label")
    votes = met.groupBy("rec_id", "bucket", *(k for k in group if k != "rec_id"), label).agg(rest, F.first(point).alias("point"), F.sum(shared).alias("overlap_ms"), F.min("r_seq").alias("seq"), F.min(F.struct("r_start_ms", "r_seq")).alias("turn"))
    votes = votes.repartition(*(deal or group)).groupBy(*group, "label").agg(F.first("rest").alias("rest"), F.first("point").alias("point"), F.sum("overlap_ms").alias("overlap_ms"), F.min("seq").alias("seq"), F.min("turn").alias("turn"))
    rank = F.when(F.col("point"), F.struct(F.col("turn.r_start_ms").alias("a"), F.col("turn.r_seq").alias("b"))).otherwise(F.struct((-F.col("overlap_ms")).alias("a"), F.col("seq").alias("b")))
    best = F.min(F.when(F.col("label").isNotNull(), F.struct(rank.alias("rank"), "label", "overlap_ms"))).alias("best")
    won = votes.groupBy(*group).agg(F.first("rest").alias("rest"), best)
    return won.select(*(F.col(x) if x in group else F.col(f"rest.{x}").alias(x) for x in clause_rows.columns), F.col("best.label").alias("label"), F.col("best.overlap_ms").alias("overlap_ms"))


def speaker_at(points: DataFrame, turn_rows: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (rec_id, at_ms) with the label of the turn that holds the point; of several, the one that starts first."""
    spans = points.withColumn("start_ms", F.col("at_ms")).withColumn("end_ms", F.col("at_ms") + 1)
    hits = overlap_join(spans, turn_rows).groupBy(*keys).agg(F.min(F.struct("r_start_ms", "r_seq", "r_label")).alias("x"))
    return points.join(hits.select(*keys, F.col("x.r_label").alias("label")), keys, "left")


def chunk_speakers(chunk_rows: DataFrame, turn_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct labels of each chunk in the order of their first turns, joined by commas."""
    seen = overlap_join(chunk_rows, turn_rows).groupBy(*keys, "r_label").agg(F.min("r_seq").alias("first_seq"))
    return seen.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "r_label"))), lambda x: x["r_label"]), ",").alias("labels"))


def fill_gaps(spans: DataFrame, keys: list[str], collar_ms: int) -> DataFrame:
    """Spans of the same keys whose gap is at most the collar, merged."""
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.where("end_ms > start_ms").withColumn("opens", F.when(reach.isNull() | (F.col("start_ms") - reach > collar_ms), 1).otherwise(0))
    island = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_spans"))


def active_runs(frames: DataFrame, keys: list[str], order: str, active) -> DataFrame:
    """Runs of active frames: first and last place in ``order`` and the number of frames."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = frames.withColumn("on", active.cast("int"))
    marked = marked.withColumn("edge", F.when(F.col("on") == F.lag("on").over(w), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("edge").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("on = 1").groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n_frames"))


def speaker_labels(turn_rows: DataFrame, keys: list[str], speaker: str = "speaker") -> DataFrame:
    """keys, speaker, spk: ``spk0``, ``spk1`` ... in the order of first appearance by (start, end)."""
    first = turn_rows.groupBy(*keys, speaker).agg(F.min(F.struct("start_ms", "end_ms")).alias("first"))
    w = Window.partitionBy(*keys).orderBy("first", speaker)
    return first.select(*keys, speaker, F.concat(F.lit("spk"), (F.row_number().over(w) - 1).cast("string")).alias("spk"))
