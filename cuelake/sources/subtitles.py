"""Subtitle files: reading, parsing, rendering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import speaker_prefix, srt_ms, srt_time
from ..operators import segment
from . import text_files

#: Encodings that are tried in turn.
ENCODINGS = ("utf-8-sig", "gb18030", "big5", "latin-1")
TIME_LINE = r"^\s*(\d+:\d{1,2}:\d{1,2}[,.]\d{1,3})\s*-->\s*(\d+:\d{1,2}:\d{1,2}[,.]\d{1,3})"


def decode(raw: bytes) -> str:
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of each file, decoded by the first encoding that fits."""
    @F.pandas_udf("string")
    def text(raw: pd.Series) -> pd.Series:
        return raw.map(decode)

    return spark.read.format("binaryFile").load(path).select("path", text("content").alias("content"))


def parse(files: DataFrame, key: str = "rec_id") -> DataFrame:
    """key, idx, start_ms, end_ms, text, speaker of every cue of ``content``. A line with times opens a cue and an empty line closes it;
    text before the first times is left out, cues without text too. A cue that doesn't end after its start lasts 50 ms."""
    clean = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "^﻿", "")
    lines = files.select(key, F.posexplode(F.split(clean, "\n")).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("is_time", F.col("line").rlike(TIME_LINE)).withColumn("blank", F.trim("line") == "")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("cue", F.sum(F.col("is_time").cast("int")).over(upto))
    in_cue = Window.partitionBy(key, "cue").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("closed", F.max(F.col("blank").cast("int")).over(in_cue)).where("cue > 0")
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_time") & (F.col("closed") == 0), F.struct("line_no", F.trim("line").alias("line"))))), lambda x: x["line"])
    cues = lines.groupBy(key, "cue").agg(F.max(F.when(F.col("is_time"), F.col("line"))).alias("times"), F.array_join(body, " ").alias("text"))
    start = srt_ms(F.regexp_extract("times", TIME_LINE, 1))
    cues = cues.withColumn("start_ms", start).withColumn("end_ms", srt_ms(F.regexp_extract("times", TIME_LINE, 2)))
    speaker, rest = speaker_prefix(F.col("text"))
    cues = cues.withColumn("speaker", speaker).withColumn("text", F.trim(rest)).where("text <> ''")
    cues = cues.withColumn("end_ms", F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + 50).otherwise(F.col("end_ms")))
    return cues.select(key, F.row_number().over(Window.partitionBy(key).orderBy("cue")).alias("idx"), "start_ms", "end_ms", "text", "speaker")


def render(rows: DataFrame, key: str = "rec_id", with_speaker: bool = True) -> DataFrame:
    """key, content: the rows as one subtitle file for each key. Rows without text are left out, the rest numbered from 1."""
    w = Window.partitionBy(key).orderBy("start_ms", "idx")
    rows = rows.where(F.trim("text") != "").withColumn("n", F.row_number().over(w))
    start = F.greatest("start_ms", F.lit(0))
    end = F.greatest("end_ms", start + 50)
    said = F.when((F.coalesce("speaker", F.lit("")) != "") & F.lit(with_speaker), F.concat(F.lit("["), "speaker", F.lit("] "), F.col("text"))).otherwise(F.col("text"))
    cue = F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(end), F.lit("\n"), said, F.lit("\n"))
    return rows.select(key, "n", cue.alias("cue")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "cue"))), lambda x: x["cue"]), "\n").alias("content"))


def export(rows: DataFrame, recordings: DataFrame, folder: str, suffix: str = "", with_speaker: bool = True, mode: str = "append") -> None:
    """One file ``<name of the source without its extension><suffix>.srt`` in ``folder`` for each of ``recordings`` (rec_id, source); without rows an empty one. All files
    are there, or none. A recording's source is never written over."""
    name = F.concat(F.regexp_replace(F.regexp_extract("source", "[^/]*$", 0), r"(?<=.)\.[^.]+$", ""), F.lit(f"{suffix}.srt"))
    out = recordings.select("rec_id", "source").join(render(rows, with_speaker=with_speaker), "rec_id", "left")
    text_files.write(out.select(name.alias("name"), "content", "source"), folder, mode)


def resolve(there: DataFrame, items: DataFrame, turn_rows: DataFrame | None = None, with_speaker: bool = True) -> DataFrame:
    """Subtitle lines that are there already, and for recordings without any those built from items (``segment.build_subtitles``)."""
    missing = items.join(there.select("rec_id").distinct(), "rec_id", "left_anti")
    return there.unionByName(segment.build_subtitles(missing, turn_rows, with_speaker).select(*there.columns))


def with_flag(rows: DataFrame, key: str = "rec_id") -> DataFrame:
    """Parsed rows with has_speaker: whether any row of the file has a speaker."""
    return rows.withColumn("has_speaker", F.max(F.coalesce("speaker", F.lit("")) != "").over(Window.partitionBy(key)))


def _seconds(ms: str):
    return F.round(F.col(ms) / 1000, 3)


def _document(rows: DataFrame, order, columns: list) -> DataFrame:
    """rec_id, json: the rows of each recording as a list of objects."""
    listed = F.array_sort(F.collect_list(F.struct(order.alias("__at"), F.struct(*columns).alias("row"))))
    return rows.groupBy("rec_id").agg(F.to_json(F.transform(listed, lambda x: x["row"])).alias("json"))


def to_json(rows: DataFrame) -> DataFrame:
    """index (from 1 in order of start), start, end (seconds, three digits), speaker and text, one JSON document for each recording."""
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("rec_id").orderBy("start_ms", "idx")))
    return _document(numbered, F.col("n"), [F.col("n").alias("index"), _seconds("start_ms").alias("start"), _seconds("end_ms").alias("end"), F.col("speaker"), F.col("text")])


def words_json(items: DataFrame) -> DataFrame:
    """text, start, end (seconds, three digits) and speaker, if there is one, of items, one JSON document for each recording."""
    speaker = [F.col("speaker")] if "speaker" in items.columns else []
    return _document(items, F.struct("start_ms", "pos"), [F.col("text"), _seconds("start_ms").alias("start"), _seconds("end_ms").alias("end"), *speaker])
