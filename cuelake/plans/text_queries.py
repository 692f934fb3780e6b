"""Queries over text: sentence ends, joins, tokens, tags, languages, subtitle files, segmentation, numerals. Each has its SQL beside it where SQL can say it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import itn as N
from ..functions import text as T
from ..operators import align, intervals, segment, words
from ..sources import subtitles
from .adapters import UTTERANCES_SQL, table, utterances

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _values(spark, schema: str, rows: list[tuple]):
    return spark.createDataFrame(rows, schema)


def _sql_values(rows: list[tuple], columns: str) -> str:
    text = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({columns})"


@query("ends_sentence_flag", f"WITH {UTTERANCES_SQL} SELECT rec_id, pos, regexp_matches(text, '[。！？!?….][\"''”’」』）)》】…～ ]*[ \\t\\n\\r]*$') AS ends FROM utterances")
def ends_sentence_flag(spark, d):
    return utterances(spark, d).select("rec_id", "pos", T.ends_sentence(F.col("text")).alias("ends"))


@query("smart_join_text", f"WITH {UTTERANCES_SQL}, n AS (SELECT rec_id, list(trim(text) ORDER BY pos) AS l FROM utterances GROUP BY rec_id) SELECT rec_id, list_reduce(list_prepend('', l), lambda a, x: CASE WHEN a = '' OR x = '' THEN a || x WHEN regexp_matches(right(a, 1), '[0-9A-Za-z.,!?;:''\")\\]%-]') AND regexp_matches(left(x, 1), '[0-9A-Za-z(''\"\\[$¥#@]') THEN a || ' ' || x ELSE a || x END) AS text FROM n")
def smart_join_text(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("text").alias("text")))), lambda x: x["text"])
    return utterances(spark, d).groupBy("rec_id").agg(ordered.alias("l")).select("rec_id", T.smart_join(F.col("l")).alias("text"))


@query("clean_token", r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}'']', '', 'g') AS cleaned FROM documents")
def clean_token(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_token(F.col("text")).alias("cleaned"))


@query("tokenize_general", r"SELECT item_id, CAST(len(t) AS INTEGER) AS n_tokens, t[1] AS first_token, t[-1] AS last_token FROM (SELECT item_id, regexp_extract_all(regexp_replace(text, '[^\p{L}\p{N}''\s]', '', 'g'), '[^\s]+') AS t FROM benchmark)")
def tokenize_general(spark, d):
    t = table(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("t"))
    return t.select("item_id", F.size("t").alias("n_tokens"), F.try_element_at("t", F.lit(1)).alias("first_token"), F.try_element_at("t", F.lit(-1)).alias("last_token"))


@query("speaker_prefix_split", f"WITH {UTTERANCES_SQL}, t AS (SELECT rec_id, pos, ' [' || speaker || '] ' || text AS tagged FROM utterances) SELECT rec_id, pos, regexp_extract(tagged, '^\\s*\\[([^\\]]{{1,32}})\\]\\s*', 1) AS speaker, regexp_replace(regexp_replace(tagged, '^\\s*\\[([^\\]]{{1,32}})\\]\\s*', ''), '^\\s+|\\s+$', '', 'g') AS body FROM t")
def speaker_prefix_split(spark, d):
    u = utterances(spark, d).withColumn("tagged", F.concat(F.lit(" ["), "speaker", F.lit("] "), F.col("text")))
    speaker, body = T.speaker_prefix(F.col("tagged"))
    return u.select("rec_id", "pos", speaker.alias("speaker"), body.alias("body"))


@query("collapse_char_runs")
def collapse_char_runs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(T.fix_repetitions(F.col("text"))).alias("n_chars"))


_RAW = [("language Chinese<asr_text>你好", None), ("language None<asr_text>", None), ("plain words", None), ("language ENGLISH<asr_text>hi there", None), ("<asr_text>only", None), ("language german<asr_text>ja", "french"), ("", None)]
_PARSED = [("language Chinese<asr_text>你好", "Chinese", "你好"), ("language None<asr_text>", "", ""), ("plain words", "", "plain words"), ("language ENGLISH<asr_text>hi there", "English", "hi there"), ("<asr_text>only", "", "only"), ("language german<asr_text>ja", "French", "ja"), ("", "", "")]


@query("parse_asr_output", _sql_values(_PARSED, "raw, language, text"))
def parse_asr_output(spark, d):
    r = _values(spark, "raw string, forced string", _RAW)
    language, text = T.parse_transcript(F.col("raw"), F.col("forced"))
    return r.select("raw", language.alias("language"), text.alias("text"))


@query("language_normalize", "SELECT lang, name, name IN ('English', 'French', 'German', 'Spanish') AS supported FROM (SELECT lang, upper(left(n, 1)) || lower(substr(n, 2)) AS name FROM (SELECT DISTINCT lang, CASE lang WHEN 'en' THEN ' eNGlish' WHEN 'fr' THEN 'FRENCH ' WHEN 'de' THEN 'german' WHEN 'es' THEN 'SPANish' ELSE lang END AS n0, trim(n0) AS n FROM documents))")
def language_normalize(spark, d):
    names = F.create_map(*(F.lit(x) for x in ("en", " eNGlish", "fr", "FRENCH ", "de", "german", "es", "SPANish")))
    l = table(spark, d, "documents").select("lang").distinct().withColumn("name", T.language_name(F.coalesce(names[F.col("lang")], "lang")))
    return l.withColumn("supported", F.col("name").isin(*T.LANGUAGES))


@query("srt_time_parse", f"WITH {UTTERANCES_SQL} SELECT rec_id, pos, start_ms AS ms FROM utterances")
def srt_time_parse(spark, d):
    return utterances(spark, d).select("rec_id", "pos", T.srt_ms(T.srt_time(F.col("start_ms"))).alias("ms"))


_STAMP = lambda x: f"lpad(CAST({x} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({x} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({x} // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST({x} % 1000 AS VARCHAR), 3, '0')"


def _subtitles(spark, d):
    return utterances(spark, d).select("rec_id", F.col("pos").alias("idx"), "start_ms", "end_ms", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), "speaker")


@query("srt_render", f"WITH {UTTERANCES_SQL}, s AS (SELECT rec_id, pos, start_ms, end_ms, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, speaker FROM utterances), n AS (SELECT *, greatest(end_ms, start_ms + 50) AS e, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, pos) AS n FROM s WHERE text <> '') SELECT rec_id, string_agg(CAST(n AS VARCHAR) || chr(10) || {_STAMP('start_ms')} || ' --> ' || {_STAMP('e')} || chr(10) || '[' || speaker || '] ' || text || chr(10), chr(10) ORDER BY n) AS content FROM n GROUP BY rec_id")
def srt_render(spark, d):
    return subtitles.render(_subtitles(spark, d))


@query("srt_roundtrip", f"WITH {UTTERANCES_SQL}, s AS (SELECT rec_id, pos, start_ms, end_ms, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, speaker FROM utterances) SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, pos) AS INTEGER) AS idx, start_ms, greatest(end_ms, start_ms + 50) AS end_ms, text, speaker FROM s WHERE text <> ''")
def srt_roundtrip(spark, d):
    return subtitles.parse(subtitles.render(_subtitles(spark, d)))


@query("srt_json", f"WITH {UTTERANCES_SQL} SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, pos) AS idx, round(CAST(start_ms AS DOUBLE) / 1000, 3) AS start, round(CAST(end_ms AS DOUBLE) / 1000, 3) AS \"end\", speaker, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM utterances")
def srt_json(spark, d):
    """Rows as one JSON document for each recording, and back."""
    back = F.from_json("json", "array<struct<index long, start double, end double, speaker string, text string>>")
    return subtitles.to_json(_subtitles(spark, d)).select("rec_id", F.inline(back)).withColumnRenamed("index", "idx")


@query("srt_has_speaker", f"WITH {UTTERANCES_SQL} SELECT rec_id, count(*) AS n, bool_or(rec_id % 2 = 0) AS has_speaker FROM utterances WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' GROUP BY rec_id")
def srt_has_speaker(spark, d):
    """Files with and without speakers, as they are loaded."""
    some = _subtitles(spark, d).withColumn("speaker", F.when(F.col("rec_id") % 2 == 0, F.col("speaker")).otherwise(""))
    return subtitles.with_flag(subtitles.parse(subtitles.render(some))).groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"), F.first("has_speaker").alias("has_speaker"))


@query("text_paragraphs", r"SELECT item_id, regexp_replace(regexp_replace(text, '([，。？！：])', '\1' || chr(10), 'g'), '([A-Za-z][,.]) ', '\1' || chr(10), 'g') AS text FROM benchmark")
def text_paragraphs(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.paragraphs(F.col("text")).alias("text"))


@query("feature_lengths", "SELECT n, CAST(floor(((floor(((floor((n % 100 - 1) / 2) + 1) - 1) / 2) + 1) - 1) / 2) + 1 + n // 100 * 13 AS BIGINT) AS frames FROM (SELECT DISTINCT length(text) AS n FROM documents)")
def feature_lengths(spark, d):
    return table(spark, d, "documents").select(F.length("text").cast("long").alias("n")).distinct().withColumn("frames", T.feature_length(F.col("n")))


@query("placeholder_expand", "SELECT item_id, replace('a<pad>b', '<pad>', repeat('<pad>', CAST(item_id % 5 AS INTEGER))) AS text FROM benchmark")
def placeholder_expand(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.expand_placeholder(F.lit("a<pad>b"), "<pad>", F.col("item_id") % 5).alias("text"))


_ITN = [("幺九二点幺六八点幺点幺", "192.168.1.1"), ("三五百人", "300~500人"), ("五六十", "50~60"), ("三四十万", "30~40万"), ("十五六", "15~16"), ("四十五六万", "45~46万"), ("一百六七", "160~170"), ("三四", "34"), ("二零二五年十月", "2025年10月"), ("三五成群", "三五成群"), ("九九八十一", "九九八十一"), ("十一十二", "11 12"), ("三百万", "300万"), ("百分之五十", "50%"), ("三分之一", "1/3"), ("三比二", "3:2"), ("八点三十分", "08:30"), ("五千克", "5kg"), ("好几百", "好几百"), ("一百二", "120")]


@query("itn_golden", _sql_values(_ITN, "raw, text"))
def itn_golden(spark, d):
    return _values(spark, "raw string", [(a,) for a, _ in _ITN]).select("raw", N.itn(F.col("raw")).alias("text"))


def _items(spark, d):
    u = utterances(spark, d).select("rec_id", "pos", "start_ms", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), 0)).alias("k", "word"))
    u = u.withColumn("dur", 200 * F.length("word"))
    w = Window.partitionBy("rec_id").orderBy("pos", "k")
    u = u.withColumn("at", F.row_number().over(w)).withColumn("start_ms", F.coalesce(F.sum("dur").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return u.select("rec_id", F.col("at").alias("pos"), "start_ms", (F.col("start_ms") + F.col("dur")).cast("long").alias("end_ms"), F.concat("word", F.lit(" ")).alias("text"))


_ITEMS = r"""w AS (SELECT rec_id, pos, unnest(regexp_extract_all(text, '\S+')) AS word, generate_subscripts(regexp_extract_all(text, '\S+'), 1) AS k FROM utterances),
  it AS (SELECT rec_id, row_number() OVER o AS n, word, CAST(coalesce(sum(200 * length(word)) OVER (PARTITION BY rec_id ORDER BY pos, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, CAST(sum(200 * length(word)) OVER (PARTITION BY rec_id ORDER BY pos, k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM w WINDOW o AS (PARTITION BY rec_id ORDER BY pos, k))"""
_CLAUSES = f"""WITH RECURSIVE {UTTERANCES_SQL}, {_ITEMS},
  f AS (SELECT *, regexp_matches(word || ' ', '[。！？!?…～，、；：,;:]|[.]\\s') AS brk FROM it),
  r AS (SELECT rec_id, n, word, 1 AS c, s, e, s AS bs, e AS be, NOT (brk OR e - s >= 6000) AS o FROM f WHERE n = 1
    UNION ALL
    SELECT f.rec_id, f.n, f.word, r.c + CASE WHEN x THEN 1 ELSE 0 END, f.s, f.e, CASE WHEN x THEN f.s ELSE r.bs END, CASE WHEN x THEN f.e ELSE greatest(r.be, f.e) END,
      NOT (f.brk OR CASE WHEN x THEN f.e - f.s ELSE greatest(r.be, f.e) - r.bs END >= 6000)
    FROM (SELECT r.*, f.n AS n2, (NOT r.o OR f.s - r.be > 1200 OR f.e - r.bs > 6000) AS x FROM r JOIN f ON f.rec_id = r.rec_id AND f.n = r.n + 1) r JOIN f ON f.rec_id = r.rec_id AND f.n = r.n2)
  SELECT rec_id, CAST(c AS INTEGER) AS idx, min(s) AS start_ms, max(e) AS end_ms, string_agg(word, ' ' ORDER BY n) AS text FROM r GROUP BY rec_id, c"""


@query("clause_split", _CLAUSES)
def clause_split(spark, d):
    return segment.split_into_clauses(_items(spark, d))


def _clauses(spark, d):
    return segment.split_into_clauses(_items(spark, d)).withColumn("speaker", F.lit(""))


@query("clause_pack")
def clause_pack(spark, d):
    return segment.pack_lines(_clauses(spark, d))


@query("merge_short")
def merge_short(spark, d):
    return segment.merge_short_lines(segment.pack_lines(_clauses(spark, d)))


@query("build_subtitles")
def build_subtitles(spark, d):
    return segment.build_subtitles(_items(spark, d))


def _speaker_turns(spark, d):
    u = utterances(spark, d)
    return u.join(intervals.speaker_labels(u, ["rec_id"]), ["rec_id", "speaker"]).select("rec_id", F.col("pos").alias("seq"), "start_ms", "end_ms", F.col("spk").alias("label"))


_SPK = """labels_ AS (SELECT rec_id, speaker, 'spk' || CAST(row_number() OVER (PARTITION BY rec_id ORDER BY s, e, speaker) - 1 AS VARCHAR) AS spk FROM (SELECT rec_id, speaker, min(start_ms) AS s, arg_min(end_ms, (start_ms, end_ms)) AS e FROM utterances GROUP BY ALL)),
  turns AS (SELECT rec_id, pos AS seq, start_ms, end_ms, spk AS label FROM utterances JOIN labels_ USING (rec_id, speaker))"""


@query("attach_speakers", f"WITH {UTTERANCES_SQL}, {_SPK}, c AS (SELECT rec_id, pos AS idx, start_ms + 1000 AS s, CASE WHEN pos % 3 = 0 THEN start_ms + 1000 ELSE end_ms + 2500 END AS e FROM utterances), v AS (SELECT c.rec_id, c.idx, label, sum(least(e, end_ms) - greatest(s, start_ms)) AS ov, min(seq) AS f FROM c JOIN turns t ON t.rec_id = c.rec_id AND e > s AND start_ms < e AND s < end_ms GROUP BY ALL), b AS (SELECT rec_id, idx, label FROM v QUALIFY row_number() OVER (PARTITION BY rec_id, idx ORDER BY ov DESC, f) = 1), p AS (SELECT c.rec_id, c.idx, label FROM c JOIN turns t ON t.rec_id = c.rec_id AND e <= s AND start_ms <= s AND s < end_ms QUALIFY row_number() OVER (PARTITION BY c.rec_id, c.idx ORDER BY start_ms, seq) = 1) SELECT c.rec_id, c.idx, s AS start_ms, e AS end_ms, coalesce(b.label, p.label, '') AS speaker FROM c LEFT JOIN b ON b.rec_id = c.rec_id AND b.idx = c.idx LEFT JOIN p ON p.rec_id = c.rec_id AND p.idx = c.idx")
def attach_speakers(spark, d):
    """Spans that reach into the next turn, and points."""
    u = utterances(spark, d)
    end = F.when(F.col("pos") % 3 == 0, F.col("start_ms") + 1000).otherwise(F.col("end_ms") + 2500)
    spans = u.select("rec_id", F.col("pos").alias("idx"), (F.col("start_ms") + 1000).alias("start_ms"), end.alias("end_ms"))
    return segment.attach_speakers(spans, _speaker_turns(spark, d), ["rec_id", "idx"])


@query("speaker_subtitles")
def speaker_subtitles(spark, d):
    """Lines that change with the speaker."""
    return segment.build_subtitles(_items(spark, d), _speaker_turns(spark, d))


@query("alignment_srt")
def alignment_srt(spark, d):
    return subtitles.render(speaker_subtitles(spark, d))


@query("subtitles_from_text")
def subtitles_from_text(spark, d):
    texts = utterances(spark, d).groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"), F.max("end_ms").alias("total_ms"))
    return segment.build_subtitles_from_text(texts, _speaker_turns(spark, d))


@query("alignment_json", f"WITH {UTTERANCES_SQL}, {_SPK}, w AS (SELECT rec_id, pos, unnest(regexp_extract_all(text, '\\S+')) AS word, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) AS k FROM utterances), i AS (SELECT rec_id, word || ' ' AS text, row_number() OVER (PARTITION BY rec_id ORDER BY pos, k) AS n, CAST(coalesce(sum(200 * length(word)) OVER (PARTITION BY rec_id ORDER BY pos, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, CAST(sum(200 * length(word)) OVER (PARTITION BY rec_id ORDER BY pos, k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM w), v AS (SELECT i.rec_id, n, label, sum(least(e, end_ms) - greatest(s, start_ms)) AS ov, min(seq) AS f FROM i JOIN turns t ON t.rec_id = i.rec_id AND start_ms < e AND s < end_ms GROUP BY ALL), b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY rec_id, n ORDER BY ov DESC, f) = 1) SELECT i.rec_id, i.text, round(CAST(s AS DOUBLE) / 1000, 3) AS start, round(CAST(e AS DOUBLE) / 1000, 3) AS \"end\", coalesce(label, '') AS speaker FROM i LEFT JOIN b ON b.rec_id = i.rec_id AND b.n = i.n")
def alignment_json(spark, d):
    """Words with their speakers as one JSON document for each recording, and back."""
    items = segment.attach_speakers(_items(spark, d), _speaker_turns(spark, d), ["rec_id", "pos"], deal=["rec_id"])
    back = F.from_json("json", "array<struct<text string, start double, end double, speaker string>>")
    return subtitles.words_json(items).select("rec_id", F.inline(back))


@query("export_text", f"WITH {UTTERANCES_SQL}, t AS (SELECT rec_id, string_agg(text, ' ' ORDER BY pos) AS text, string_agg('[' || speaker || '] ' || text, chr(10) ORDER BY pos) || chr(10) AS spoken FROM utterances GROUP BY rec_id) SELECT rec_id, regexp_replace(regexp_replace(text, '([，。？！：])', '\\1' || chr(10), 'g'), '([A-Za-z][,.] )', '\\1' || chr(10), 'g') AS text, spoken FROM t")
def export_text(spark, d):
    """A recording's text in lines after its signs, and line by line with its speakers."""
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("pos", x.alias("x")))), lambda r: r["x"])
    u = utterances(spark, d).groupBy("rec_id").agg(F.array_join(ordered(F.col("text")), " ").alias("text"), F.concat(F.array_join(ordered(T.spoken(F.col("speaker"), F.col("text"))), "\n"), F.lit("\n")).alias("spoken"))
    return u.select("rec_id", T.text_file(N.itn(F.col("text"))).alias("text"), "spoken")


_JOIN = lambda a, b: f"{a} || CASE WHEN {a} <> '' AND {b} <> '' AND regexp_matches(right({a}, 1), '[0-9A-Za-z.,!?;:''\")\\]%-]') AND regexp_matches(left({b}, 1), '[0-9A-Za-z(''\"\\[$¥#@]') THEN ' ' ELSE '' END || {b}"
_UNITS = f"""WITH RECURSIVE {UTTERANCES_SQL},
  s AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY pos) AS n, start_ms AS s, end_ms AS e, speaker, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^\\[([^\\]]{{1,32}})\\]\\s*', '') AS t FROM utterances),
  f AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY n) AS k, regexp_matches(regexp_replace(t, '[”"’''\\)）】》」』…～ ]+$', ''), '[。！？!?….～]$') AS ends FROM s WHERE t <> ''),
  r AS (SELECT rec_id, n, k, 1 AS unit, s AS bs, e AS be, e - s AS dur, t AS text, speaker AS who, speaker AS first, 1 AS rows, [n] AS members, ends OR e - s >= 45000 AS closed, ends FROM f WHERE k = 1
    UNION ALL
    SELECT f.rec_id, f.n, f.k, CASE WHEN x THEN unit + 1 ELSE unit END, CASE WHEN x THEN f.s ELSE bs END, CASE WHEN x THEN f.e ELSE greatest(be, f.e) END, CASE WHEN x THEN f.e - f.s ELSE dur + f.e - f.s END,
      CASE WHEN x THEN f.t ELSE {_JOIN('text', 'f.t')} END, f.speaker, CASE WHEN x THEN f.speaker ELSE first END, CASE WHEN x THEN 1 ELSE rows + 1 END, CASE WHEN x THEN [f.n] ELSE list_append(members, f.n) END,
      f.ends OR CASE WHEN x THEN f.e - f.s ELSE greatest(be, f.e) - bs END >= 45000, f.ends
    FROM (SELECT r.*, r.closed OR (r.who <> '' AND f.speaker <> '' AND r.who <> f.speaker) AS x FROM r JOIN f ON f.rec_id = r.rec_id AND f.k = r.k + 1) r JOIN f ON f.rec_id = r.rec_id AND f.k = r.k + 1)
  SELECT rec_id, CAST(unit AS INTEGER) AS idx, bs AS start_ms, be AS end_ms, dur AS duration_ms, text, first AS speaker, ends AS complete, CAST(rows AS INTEGER) AS n_rows, members FROM r QUALIFY row_number() OVER (PARTITION BY rec_id, unit ORDER BY k DESC) = 1"""


@query("translation_units", _UNITS)
def translation_units(spark, d):
    return segment.translation_units(_subtitles(spark, d)).drop("rows")


@query("group_conservation", f"WITH {UTTERANCES_SQL} SELECT rec_id, CAST(sum(dur_ms) AS BIGINT) AS rows_ms, CAST(sum(dur_ms) AS BIGINT) AS units_ms, count(*) AS n_rows FROM utterances WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' GROUP BY rec_id")
def group_conservation(spark, d):
    """Units take all rows and all of their time."""
    rows = _subtitles(spark, d).where("text <> ''").groupBy("rec_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("rows_ms"))
    units = segment.translation_units(_subtitles(spark, d)).groupBy("rec_id").agg(F.sum("duration_ms").alias("units_ms"), F.sum("n_rows").alias("n_rows"))
    return rows.join(units, "rec_id")


def _translated(spark, d):
    u = segment.translation_units(_subtitles(spark, d))
    signs = F.regexp_replace(F.regexp_replace("text", r"\. ?", "。"), ", ?", "，")
    return u.withColumn("translation", F.when(F.col("idx") % 4 == 0, F.lit(None)).when(F.col("idx") % 4 == 2, F.lit(" ")).otherwise(signs))


@query("split_translation")
def split_translation(spark, d):
    return segment.translated_rows(_translated(spark, d))


@query("translated_segments")
def translated_segments(spark, d):
    """Units without a translation keep their rows."""
    return segment.translated_rows(_translated(spark, d), keep_source=True)


@query("translation_backfill", f"WITH {UTTERANCES_SQL} SELECT rec_id, pos, CASE WHEN pos % 3 = 0  THEN text ELSE '>' || text END AS text, pos % 3 = 0 AS is_source FROM utterances")
def translation_backfill(spark, d):
    u = utterances(spark, d).select("rec_id", "pos", "text")
    done = u.where("pos % 3 <> 0").select("rec_id", "pos", F.concat(F.lit(">"), "text").alias("translation"))
    return u.join(done, ["rec_id", "pos"], "left").select("rec_id", "pos", F.coalesce(F.nullif("translation", F.lit("")), "text").alias("text"), F.col("translation").isNull().alias("is_source"))


@query("fix_timestamps")
def fix_timestamps(spark, d):
    @F.pandas_udf("array<int>")
    def fixed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: align.fix_timestamps(list(v)))

    e = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: F.floor(x["value"]).cast("int")).alias("v"))
    return e.select("user_id", fixed("v").alias("fixed"))


# a token reaches from the first to the last kept character between blanks; the rest is between tokens
_KEPT = "\\p{L}\\p{N}''"
_RECONCILED = f"""WITH {UTTERANCES_SQL}, l AS (SELECT rec_id, pos, regexp_extract_all(text, '[{_KEPT}](?:[^\\s{_KEPT}]*[{_KEPT}])*|[^{_KEPT}]+') AS l FROM utterances WHERE text <> ''),
  i AS (SELECT rec_id, pos, unnest(l) AS text, generate_subscripts(l, 1) AS k FROM l), n AS (SELECT *, regexp_matches(text, '^[{_KEPT}]') AS is_token FROM i),
  c AS (SELECT *, CAST(80 * coalesce(sum(CAST(is_token AS INTEGER)) OVER (PARTITION BY rec_id, pos ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM n)
  SELECT rec_id, pos, CAST(k AS INTEGER) AS k, text, s AS start_ms, CASE WHEN is_token THEN s + 80 ELSE s END AS end_ms FROM c"""


@query("reconcile_gaps", _RECONCILED)
def reconcile_gaps(spark, d):
    """Cleaned tokens of 80 ms put back into their text, with what is between them."""
    u = utterances(spark, d).where("text <> ''").select("rec_id", "pos", "text", T.tokens(F.col("text")).alias("tokens"))
    return align.reconciled(u, ["rec_id", "pos"], lambda tokens: [(w, 80 * i, 80 * i + 80) for i, w in enumerate(tokens)])


def _clean_sql() -> str:
    """The rule step by step over the column t of r."""
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    steps = [strip("regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '</?think>', '', 'g')"), strip("regexp_replace(t, '(?i)^(?:译文|翻译结果|翻译|translation)\\s*[:：]\\s*', '')"), strip("replace(t, '**', '')")]
    steps += [f"CASE WHEN length(t) >= 2 AND left(t, 1) = '{a}' AND right(t, 1) = '{b}' THEN {strip('substr(t, 2, length(t) - 2)')} ELSE t END" for a, b in ('""', ("''", "''"), "「」", "『』", "“”", "‘’")]
    steps.append(strip("regexp_replace(t, '^(?:译文|翻译)\\s*[:：]\\s*', '')"))
    sql = "r"
    for step in steps:
        sql = f"(SELECT rec_id, pos, {step} AS t FROM {sql})"
    return f"SELECT rec_id, pos, t AS text FROM {sql}"


_REPLY = f"r AS (SELECT rec_id, pos, CASE pos % 6 WHEN 0 THEN '\"' || text || '\"' WHEN 1 THEN '译文：' || text WHEN 2 THEN '**' || text || '** ' WHEN 3 THEN '<think>x' || chr(10) || 'y</think>' || text WHEN 4 THEN 'Translation: 「' || text || '」' ELSE '“翻译：' || text || '”' END AS t FROM utterances)"


@query("clean_translation", f"WITH {UTTERANCES_SQL}, {_REPLY} {_clean_sql()}")
def clean_translation(spark, d):
    wrapped = ["'\"' || text || '\"'", "'译文：' || text", "'**' || text || '** '", "'<think>x\\ny</think>' || text", "'Translation: 「' || text || '」'"]
    raw = F.expr("CASE pos % 6 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(wrapped)) + " ELSE '“翻译：' || text || '”' END")
    return utterances(spark, d).select("rec_id", "pos", T.clean_translation(raw).alias("text"))


_SPACED = lambda t, more: f"{t} || CASE WHEN regexp_matches(right({t}, 1), '[0-9A-Za-z.,!?;:''\")\\]%-]') THEN ' ' ELSE '' END || {more}"


@query("parse_numbered", f"WITH {UTTERANCES_SQL}, u AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY pos) AS k, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM utterances) SELECT rec_id, CASE WHEN bool_or(t = '') OR (rec_id % 5 = 0 AND count(*) > 1) THEN NULL ELSE string_agg(CASE WHEN k = 1 AND rec_id % 3 = 0 THEN {_SPACED('t', chr(39) + 'more' + chr(39))} WHEN k = 1 AND rec_id % 3 = 1 THEN {_SPACED('t', chr(39) + '900. stray' + chr(39))} ELSE t END, '|' ORDER BY k) END AS parts FROM u GROUP BY rec_id")
def parse_numbered(spark, d):
    """Numbered replies from the last to the first; in some a line goes on, with or without a number that no item has, in others one is missing."""
    u = _subtitles(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("rec_id").orderBy("idx")))
    further = F.when((F.col("k") == 1) & (F.col("rec_id") % 3 == 0), "\nmore").when((F.col("k") == 1) & (F.col("rec_id") % 3 == 1), "\n900. stray").otherwise("")
    line = F.concat(F.lit(" 第"), F.col("k").cast("string"), F.lit("条: "), "text", further)
    g = u.withColumn("line", F.when((F.col("k") != 2) | (F.col("rec_id") % 5 != 0), line)).groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line")), False), lambda x: x["line"]), "\n\n").alias("reply"))
    return g.select("rec_id", F.array_join(T.numbered_translations(F.col("reply"), F.col("n")), "|").alias("parts"))


@query("numbered_prompt", f"WITH {UTTERANCES_SQL} SELECT rec_id, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(k AS VARCHAR) || '. ' || text, chr(10) ORDER BY k) AS prompt FROM (SELECT rec_id, text, row_number() OVER (PARTITION BY rec_id ORDER BY pos) AS k FROM utterances) GROUP BY rec_id")
def numbered_prompt(spark, d):
    u = utterances(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("rec_id").orderBy("pos")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: F.concat(x["k"].cast("string"), F.lit(". "), x["text"]))
    return u.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(lines, "\n").alias("prompt"))


@query("route_files", "WITH p AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.SRT' WHEN 2 THEN '.srt' ELSE '' END AS path FROM pages) SELECT page_id, regexp_matches(path, '[^/]\\.[sS][rR][tT]$') AS subtitle, nullif(regexp_replace(path, '([^/])\\.[^./]+$', '\\1') || CASE WHEN page_id % 8 = 2 THEN '' ELSE '.zh' END || '.srt', path) AS output FROM p")
def route_files(spark, d):
    """Whether an input is a subtitle file, and where its translation goes; null where that would be the input itself."""
    ends = F.element_at(F.array(F.lit(".mp4"), F.lit(".SRT"), F.lit(".srt"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    p = table(spark, d, "pages").select("page_id", F.concat("url", ends).alias("path"))
    output = F.when(F.col("page_id") % 8 == 2, T.output_path(F.col("path"), "")).otherwise(T.output_path(F.col("path"), ".zh"))
    return p.select("page_id", T.is_subtitle_file(F.col("path")).alias("subtitle"), output.alias("output"))


_LAST = "regexp_extract(a, '[^\\x01]*$')"


@query("split_oversize", f"WITH t AS (SELECT item_id, replace(text, chr(10), ' ') AS t FROM benchmark), l AS (SELECT item_id, CASE WHEN t IS NULL THEN NULL WHEN t = '' THEN [] WHEN length(t) <= 48 THEN [t] WHEN NOT contains(t, ' ') THEN [substr(t, i, 48) FOR i IN range(1, length(t) + 1, 48)] ELSE list_filter(string_split(list_reduce(string_split(t, ' '), lambda a, x: CASE WHEN {_LAST} = '' THEN a || x WHEN length({_LAST}) + 1 + length(x) <= 48 THEN a || ' ' || x ELSE a || chr(1) || x END), chr(1)), lambda x: x <> '') END AS lines FROM t) SELECT item_id, array_to_string(lines, ' ') AS text, lines FROM l")
def split_oversize(spark, d):
    """The wrapped lines of every item, and those joined by spaces; null: null. Line breaks become spaces first."""
    @F.pandas_udf("array<string>")
    def wrapped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else segment.split_oversize(t, 48))

    t = table(spark, d, "benchmark").select("item_id", wrapped(F.regexp_replace("text", "\n", " ")).alias("lines"))
    return t.select("item_id", F.array_join("lines", " ").alias("text"), "lines")


_PREFIXES = """WITH t AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\S+')) AS token FROM documents) GROUP BY token),
  c AS (SELECT left(token, k) AS string, k AS length, CAST(sum(n) AS BIGINT) AS n FROM t, range(1, 9) AS r(k) WHERE k <= length(token) GROUP BY ALL),
  s AS (SELECT c.string, c.length, c.n, f.n AS n_first, CASE WHEN c.length > 1 THEN round(pow(CAST(c.n AS DOUBLE) / f.n, CAST(1 AS DOUBLE) / (c.length - 1)), 12) ELSE 0 END AS score FROM c JOIN c f ON f.length = 1 AND f.string = left(c.string, 1))"""


@query("prefix_scores", f"{_PREFIXES} SELECT string, CAST(length AS INTEGER) AS length, n, n_first FROM s")
def prefix_scores(spark, d):
    """The prefixes of all words with the counts that say how well they hold together."""
    tokens = words.distinct_tokens(table(spark, d, "documents"))
    return words.prefix_scores(tokens).drop("score")


@query("left_parts", f"{_PREFIXES} SELECT token, left(token, best.length) AS \"left\", substr(token, best.length + 1) AS \"right\" FROM (SELECT token, max({{'score': score, 'length': s.length}}) AS best FROM (SELECT token, left(token, k) AS string FROM t, range(1, 9) AS r(k) WHERE k <= length(token)) JOIN s USING (string) GROUP BY token)")
def left_parts(spark, d):
    """All words, cut after the prefix that holds together best."""
    tokens = words.distinct_tokens(table(spark, d, "documents"))
    return words.left_parts(tokens, words.prefix_scores(tokens))


@query("lattice_words")
def lattice_words(spark, d):
    """Utterances with their words cut into what holds together."""
    u = utterances(spark, d).withColumn("key", F.struct("rec_id", "pos"))
    tokens = words.distinct_tokens(u)
    splits = words.lattice(tokens, words.substring_scores(tokens))
    return words.split_texts(u, "key", splits).select("key.rec_id", "key.pos", F.array_join("tokens", "|").alias("tokens"))
