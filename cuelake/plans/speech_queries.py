"""Queries over recordings: speakers, overlaps, timelines, chunks. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import errors
from ..functions import text as T
from ..operators import intervals, numeric, timeline
from .adapters import CLAUSES_SQL, TURNS_SQL, UTTERANCES_SQL, clauses, table, turns, utterances

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


LABELS_SQL = """labels_ AS (SELECT rec_id, speaker, 'spk' || CAST(row_number() OVER (PARTITION BY rec_id ORDER BY s, e, speaker) - 1 AS VARCHAR) AS spk FROM (
  SELECT rec_id, speaker, min(start_ms) AS s, arg_min(end_ms, (start_ms, end_ms)) AS e FROM utterances GROUP BY ALL))"""


@query("speaker_talk_time", f"WITH {UTTERANCES_SQL}, {LABELS_SQL} SELECT u.rec_id, l.spk, CAST(sum(dur_ms) AS BIGINT) AS talk_ms, count(*) AS n_turns, min(start_ms) AS first_ms, max(end_ms) AS last_ms FROM utterances u JOIN labels_ l ON u.rec_id = l.rec_id AND u.speaker = l.speaker GROUP BY u.rec_id, l.spk")
def speaker_talk_time(spark, d):
    u = utterances(spark, d)
    l = intervals.speaker_labels(u, ["rec_id"])
    return u.join(l, ["rec_id", "speaker"]).groupBy("rec_id", "spk").agg(F.sum("dur_ms").alias("talk_ms"), F.count(F.lit(1)).alias("n_turns"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))


_PAIRS = "pairs AS (SELECT c.rec_id, clause, label, seq, t.start_ms AS ts, least(c.end_ms, t.end_ms) - greatest(c.start_ms, t.start_ms) AS ov FROM clauses c JOIN turns t ON c.rec_id = t.rec_id AND c.start_ms < t.end_ms AND t.start_ms < c.end_ms)"


@query("dominant_speaker_overlap", f"WITH {TURNS_SQL}, {CLAUSES_SQL}, {_PAIRS}, v AS (SELECT rec_id, clause, label, sum(ov) AS ov, min(seq) AS f FROM pairs GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY rec_id, clause ORDER BY ov DESC, f) AS k FROM v) SELECT c.rec_id, c.clause, b.label, CAST(b.ov AS BIGINT) AS overlap_ms FROM clauses c LEFT JOIN b ON c.rec_id = b.rec_id AND c.clause = b.clause AND k = 1")
def dominant_speaker_overlap(spark, d):
    t = turns(spark, d)
    return intervals.dominant_speaker(clauses(t), t, ["rec_id", "clause"]).select("rec_id", "clause", "label", "overlap_ms")


@query("speaker_at_point", f"WITH {TURNS_SQL}, {CLAUSES_SQL}, h AS (SELECT c.rec_id, clause, label, row_number() OVER (PARTITION BY c.rec_id, clause ORDER BY t.start_ms, seq) AS k FROM clauses c JOIN turns t ON c.rec_id = t.rec_id AND t.start_ms <= c.start_ms + 300000 AND c.start_ms + 300000 < t.end_ms) SELECT c.rec_id, c.clause, c.start_ms + 300000 AS at_ms, label FROM clauses c LEFT JOIN h ON h.rec_id = c.rec_id AND h.clause = c.clause AND k = 1")
def speaker_at_point(spark, d):
    t = turns(spark, d)
    points = clauses(t).select("rec_id", "clause", (F.col("start_ms") + 300_000).alias("at_ms"))
    return intervals.speaker_at(points, t, ["rec_id", "clause"])


@query("chunk_speakers_semi", f"WITH {TURNS_SQL}, {CLAUSES_SQL}, {_PAIRS}, s AS (SELECT rec_id, clause, label, min(seq) AS f FROM pairs GROUP BY ALL) SELECT rec_id, clause, string_agg(label, ',' ORDER BY f) AS labels FROM s GROUP BY ALL")
def chunk_speakers_semi(spark, d):
    t = turns(spark, d)
    return intervals.chunk_speakers(clauses(t), t, ["rec_id", "clause"])


@query("fill_gaps_merge", f"WITH {TURNS_SQL}, o AS (SELECT *, max(end_ms) OVER (PARTITION BY rec_id, speaker ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM turns WHERE end_ms > start_ms), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, speaker ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM o) SELECT rec_id, speaker, CAST(island AS BIGINT) AS island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_spans FROM i GROUP BY rec_id, speaker, island")
def fill_gaps_merge(spark, d):
    return intervals.fill_gaps(turns(spark, d), ["rec_id", "speaker"], 500)


@query("hysteresis_segments", "WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, CASE WHEN value > 50 THEN 1 ELSE 0 END AS a FROM events), e AS (SELECT *, CASE WHEN a = lag(a) OVER w THEN 0 ELSE 1 END AS edge FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame)), r AS (SELECT *, sum(edge) OVER (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id, CAST(run AS BIGINT) AS run, CAST(min(frame) AS INTEGER) AS first, CAST(max(frame) AS INTEGER) AS last, count(*) AS n_frames FROM r WHERE a = 1 GROUP BY user_id, run")
def hysteresis_segments(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = table(spark, d, "events").select("user_id", F.row_number().over(w).alias("frame"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("active"))
    return intervals.active_runs(f, ["user_id"], "frame", F.col("active"))


@query("speaker_labels", f"WITH {UTTERANCES_SQL}, {LABELS_SQL} SELECT * FROM labels_")
def speaker_labels(spark, d):
    return intervals.speaker_labels(utterances(spark, d), ["rec_id"])


@query("speaker_changes", f"WITH {UTTERANCES_SQL} SELECT rec_id, pos, start_ms, speaker FROM (SELECT *, lag(speaker) OVER (PARTITION BY rec_id ORDER BY pos) AS p FROM utterances) WHERE p IS NULL OR p <> speaker")
def speaker_changes(spark, d):
    w = Window.partitionBy("rec_id").orderBy("pos")
    return utterances(spark, d).withColumn("p", F.lag("speaker").over(w)).where("p is null or p <> speaker").select("rec_id", "pos", "start_ms", "speaker")


@query("timeline_normalize", f"WITH {UTTERANCES_SQL}, a AS (SELECT rec_id, text, speaker, start_ms AS s, CASE WHEN pos % 4 = 1 THEN start_ms + 200 WHEN pos % 4 = 2 THEN start_ms - 5 ELSE end_ms + 300 END AS e0, lead(start_ms) OVER w AS nxt, row_number() OVER w AS idx FROM utterances WINDOW w AS (PARTITION BY rec_id ORDER BY start_ms, pos)), b AS (SELECT *, CASE WHEN e0 <= s THEN s + 600 ELSE e0 END AS e1 FROM a), c AS (SELECT *, CASE WHEN e1 - s >= 600 THEN e1 WHEN nxt IS NULL THEN s + 600 ELSE least(s + 600, greatest(s + 100, nxt - 20)) END AS e2 FROM b) SELECT rec_id, CAST(idx AS INTEGER) AS idx, s AS start_ms, CAST(CASE WHEN e2 > nxt THEN greatest(s + 50, nxt - 20) ELSE e2 END AS BIGINT) AS end_ms, text, speaker FROM c")
def timeline_normalize(spark, d):
    end = F.when(F.col("pos") % 4 == 1, F.col("start_ms") + 200).when(F.col("pos") % 4 == 2, F.col("start_ms") - 5).otherwise(F.col("end_ms") + 300)
    u = utterances(spark, d).withColumn("end_ms", end)
    return timeline.normalize(u, ["rec_id"], ["start_ms", "pos"])


_WORDS = "w AS (SELECT rec_id, pos, start_ms, dur_ms, unnest(regexp_extract_all(text, '[^ ]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^ ]+'), 1) AS k FROM utterances)"


@query("proportional_timing", f"WITH {UTTERANCES_SQL}, {_WORDS}, s AS (SELECT *, sum(length(word)) OVER (PARTITION BY rec_id, pos ORDER BY k ROWS UNBOUNDED PRECEDING) AS u, sum(length(word)) OVER (PARTITION BY rec_id, pos) AS t FROM w) SELECT rec_id, pos, CAST(k AS INTEGER) AS k, word, CAST(start_ms + dur_ms * (u - length(word)) // t AS BIGINT) AS part_start_ms, CAST(start_ms + dur_ms * u // t AS BIGINT) AS part_end_ms FROM s")
def proportional_timing(spark, d):
    u = utterances(spark, d).select("rec_id", "pos", "start_ms", "dur_ms", F.posexplode(F.regexp_extract_all("text", F.lit("[^ ]+"), 0)).alias("k", "word")).withColumn("k", F.col("k") + 1)
    return timeline.proportional(u, ["rec_id", "pos"], "k", F.length("word"), "start_ms", "dur_ms").select("rec_id", "pos", "k", "word", "part_start_ms", "part_end_ms")


_REC = "rec AS (SELECT rec_id, max(end_ms) AS len FROM utterances GROUP BY rec_id)"


@query("fixed_chunks", f"WITH {UTTERANCES_SQL}, {_REC} SELECT rec_id, CAST(c AS INTEGER) AS chunk, CAST(c * 40000 AS BIGINT) AS chunk_start, CAST(least(len, (c + 1) * 40000) AS BIGINT) AS chunk_end FROM rec, unnest(range(0, (len - 1) // 40000 + 1)) AS x(c) WHERE len > 0")
def fixed_chunks(spark, d):
    rec = utterances(spark, d).groupBy("rec_id").agg(F.max("end_ms").alias("len"))
    return timeline.fixed_chunks(rec, "len", 40_000).select("rec_id", "chunk", "chunk_start", "chunk_end")


@query("sliding_chunks", f"WITH {UTTERANCES_SQL}, {_REC} SELECT rec_id, CAST(c AS INTEGER) AS chunk, CAST(c * 1000 AS BIGINT) AS chunk_start FROM rec, unnest(range(0, CASE WHEN len >= 10000 THEN (len - 10000) // 1000 + 1 + CASE WHEN (len - 10000) % 1000 > 0 THEN 1 ELSE 0 END ELSE 1 END)) AS x(c) WHERE len > 0")
def sliding_chunks(spark, d):
    rec = utterances(spark, d).groupBy("rec_id").agg(F.max("end_ms").alias("len"))
    return timeline.sliding_chunks(rec, "len", 10_000, 1_000).select("rec_id", "chunk", "chunk_start")


_FRAMES = "g AS (SELECT user_id, epoch_us(ts) // 60000000 AS minute, CAST(round(value * 1000) AS BIGINT) AS v FROM events), x AS (SELECT user_id, minute + o AS frame, v FROM g, (SELECT unnest(range(0, 10)) AS o))"


@query("sliding_frame_average", f"WITH {_FRAMES} SELECT frame, CAST(sum(v) AS BIGINT) AS total, count(*) AS n, CAST(sum(v) AS DOUBLE) / count(*) AS mean FROM x GROUP BY frame")
def sliding_frame_average(spark, d):
    # events of a minute cover the same frames: they are summed before they are spread
    minutes = _events(spark, d).groupBy("minute").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))
    f = minutes.select(F.explode(F.expr("transform(sequence(0, 9), o -> minute + o)")).alias("frame"), "total", "n")
    return f.groupBy("frame").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), (F.sum("total").cast("double") / F.sum("n")).alias("mean"))


def _events(spark, d):
    return table(spark, d, "events").select("user_id", F.expr("unix_micros(cast(ts as timestamp)) div 60000000").alias("minute"), F.round(F.col("value") * 1000).cast("long").alias("v"))


def _frames(spark, d):
    """Each event covers ten one-minute frames, as overlapping chunks cover frames."""
    return _events(spark, d).withColumn("frame", F.explode(F.expr("transform(sequence(0, 9), o -> minute + o)"))).drop("minute")


@query("speaker_count_frames", f"WITH {_FRAMES}, a AS (SELECT frame, user_id, max(v) AS v FROM x GROUP BY ALL) SELECT frame, CAST(round_even(CAST(sum(CASE WHEN v > 50000 THEN 1 ELSE 0 END) AS DOUBLE) / 2, 0) AS INTEGER) AS n_speakers FROM a GROUP BY frame")
def speaker_count_frames(spark, d):
    a = _frames(spark, d).groupBy("frame", "user_id").agg(F.max("v").alias("v"))
    return a.groupBy("frame").agg(F.rint(F.sum(F.when(F.col("v") > 50_000, 1).otherwise(0)).cast("double") / 2).cast("int").alias("n_speakers"))


@query("top_count_reconstruct", f"WITH {_FRAMES}, a AS (SELECT frame, user_id, max(v) AS v FROM x GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY v DESC NULLS LAST, user_id) AS place, round_even(CAST(sum(CASE WHEN v > 50000 THEN 1 ELSE 0 END) OVER (PARTITION BY frame) AS DOUBLE) / 2, 0) AS n FROM a) SELECT frame, user_id, v, CAST(place AS INTEGER) AS place FROM k WHERE place <= n")
def top_count_reconstruct(spark, d):
    a = _frames(spark, d).groupBy("frame", "user_id").agg(F.max("v").alias("v"))
    w = Window.partitionBy("frame").orderBy(F.desc("v"), "user_id")
    # the count of speaker_count_frames; a window over the frame alone, so frames aren't shuffled again
    n = F.rint(F.sum(F.when(F.col("v") > 50_000, 1).otherwise(0)).over(Window.partitionBy("frame")).cast("double") / 2).cast("int")
    return a.withColumns({"place": F.row_number().over(w), "n_speakers": n}).where("place <= n_speakers").select("frame", "user_id", "v", "place")


@query("token_loop_breaker", f"WITH {UTTERANCES_SQL}, {_WORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY pos, k) AS n FROM w), m AS (SELECT *, list(word) OVER (PARTITION BY rec_id ORDER BY n ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS l FROM o) SELECT rec_id, CAST(n AS INTEGER) AS n, word, n > 15 AND len(list_distinct(l)) <= 3 AS loops FROM m")
def token_loop_breaker(spark, d):
    w = utterances(spark, d).select("rec_id", "pos", F.posexplode(F.regexp_extract_all("text", F.lit("[^ ]+"), 0)).alias("k", "word"))
    w = w.withColumn("n", F.row_number().over(Window.partitionBy("rec_id").orderBy("pos", "k")))
    return timeline.looping(w, ["rec_id"], "n", "word", 15, 3).select("rec_id", "n", "word", "loops")


@query("merge_languages", "WITH l AS (SELECT doc_id // 10 AS rec_id, doc_id AS pos, lang FROM documents), n AS (SELECT *, lag(lang) OVER (PARTITION BY rec_id ORDER BY pos) AS p FROM l WHERE trim(coalesce(lang, '')) <> '') SELECT rec_id, string_agg(lang, ',' ORDER BY pos) AS languages FROM n WHERE p IS NULL OR p <> lang GROUP BY rec_id")
def merge_languages(spark, d):
    l = table(spark, d, "documents").select(F.expr("doc_id div 10").alias("rec_id"), F.col("doc_id").alias("pos"), "lang")
    return timeline.merge_languages(l, ["rec_id"], "pos", "lang")


@query("merged_text", f"WITH {UTTERANCES_SQL} SELECT rec_id, string_agg(text, '' ORDER BY pos) AS text FROM utterances GROUP BY rec_id")
def merged_text(spark, d):
    return utterances(spark, d).groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("text"))


_RATIO = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END"


@query("run_statistics", f"WITH {UTTERANCES_SQL}, u AS (SELECT *, len(regexp_extract_all(text, '[^ ]+')) AS n FROM utterances), r AS (SELECT rec_id, CAST(sum(dur_ms) AS BIGINT) AS audio_ms, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CASE WHEN speaker = 'user' THEN n ELSE 0 END) AS BIGINT) AS prefill_tokens, CAST(sum(CASE WHEN speaker = 'user' THEN 0 ELSE n END) AS BIGINT) AS decode_tokens, CAST(sum(CASE WHEN speaker = 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS prefill_ms, CAST(sum(CASE WHEN speaker = 'user' THEN 0 ELSE 7 * length(text) END) AS BIGINT) AS decode_ms FROM u GROUP BY rec_id) SELECT rec_id, audio_ms, chars, prefill_tokens + decode_tokens AS tokens, prefill_ms + decode_ms AS run_ms, {_RATIO('prefill_ms + decode_ms', 'audio_ms')} AS rtf, {_RATIO('(prefill_tokens + decode_tokens) * 1000', '(prefill_ms + decode_ms)')} AS tokens_per_s, {_RATIO('prefill_tokens * 1000', 'prefill_ms')} AS prefill_per_s, {_RATIO('decode_tokens * 1000', 'decode_ms')} AS decode_per_s FROM r")
def run_statistics(spark, d):
    """Real-time factor and speed of runs, also of what goes in and what comes out; 0 where there is nothing to divide by. A user's words stand in for what goes in, a millisecond a
    character, all others for what comes out, seven."""
    u = utterances(spark, d).select("rec_id", "dur_ms", F.length("text").alias("chars"), F.size(F.regexp_extract_all("text", F.lit("[^ ]+"), 0)).alias("tokens"), (F.col("speaker") == "user").alias("goes_in"))
    u = u.withColumn("ms", F.when(F.col("goes_in"), F.col("chars")).otherwise(7 * F.col("chars")))
    return timeline.run_statistics(u, "rec_id")


@query("profile_rollup", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events), g AS (SELECT event_type, count(*) AS calls, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS total FROM k WHERE n > 1 GROUP BY event_type), p AS (SELECT *, CAST(total AS DOUBLE) / calls AS mean, 100 * CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS BIGINT) AS pct FROM g) SELECT * FROM p WHERE pct >= 0.1")
def profile_rollup(spark, d):
    """Calls without each operator's first, which warms up: number, mean, share of all; shares under 0.1 % are left out, the dearest come first."""
    ms = F.round(F.col("value") * 1000).cast("long")
    g = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(ms).alias("sum"), F.min_by(ms, F.struct("ts", "event_id")).alias("first"))
    g = g.where("n > 1").select("event_type", (F.col("n") - 1).alias("calls"), (F.col("sum") - F.coalesce("first", F.lit(0))).alias("total"))
    whole = F.sum("total").over(Window.partitionBy())  # over one row for each operator
    p = g.withColumns({"mean": F.col("total").cast("double") / F.col("calls"), "pct": 100 * F.col("total").cast("double") / whole})
    return p.where("pct >= 0.1").orderBy(F.desc("total"))


@query("alignment_shift", f"WITH {UTTERANCES_SQL} SELECT rec_id, avg(CAST(abs(start_ms - (start_ms // 80) * 80) AS DOUBLE)) AS shift_ms FROM utterances GROUP BY rec_id")
def alignment_shift(spark, d):
    return utterances(spark, d).groupBy("rec_id").agg(F.avg(F.abs(F.col("start_ms") - F.expr("start_ms div 80 * 80")).cast("double")).alias("shift_ms"))


def _heard(spark, d):
    """Utterances with what a poor transcript has of them: of each eleven words one is left out, one comes twice and one is backwards. They are dealt out one by one, as counting edits takes far longer
    than reading, and files may have few parts; the number of parts is given, since few bytes are much work and would be put together."""
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    heard = F.flatten(F.transform(words, lambda w, k: F.when(k % 11 == 3, F.array().cast("array<string>")).when(k % 11 == 5, F.array(w, w)).when(k % 11 == 8, F.array(F.reverse(w))).otherwise(F.array(w))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return utterances(spark, d).repartition(parts, "rec_id", "pos").withColumn("heard", F.array_join(heard, " "))


_HEARD = f"""WITH RECURSIVE {UTTERANCES_SQL}, w AS (SELECT rec_id, pos, speaker, regexp_extract_all(text, '\\S+') AS a FROM utterances),
  h AS (SELECT *, flatten(list_transform(a, lambda x, k: CASE (k - 1) % 11 WHEN 3 THEN [] WHEN 5 THEN [x, x] WHEN 8 THEN [reverse(x)] ELSE [x] END)) AS b FROM w),
  dp AS (SELECT rec_id, pos, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: j * 1048577) AS row FROM h
    UNION ALL SELECT rec_id, pos, a, b, i + 1, list_transform(range(0, len(b) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda k: c[k + 1] + (j - k) * 1048577))) FROM
      (SELECT *, list_transform(range(0, len(b) + 1), lambda k: CASE WHEN k = 0 THEN (i + 1) * 1048577 ELSE least(row[k + 1] + 1048577, row[k] + CASE WHEN a[i + 1] = b[k] THEN 0 ELSE 1048576 END) END) AS c FROM dp WHERE i < len(a))),
  e AS (SELECT rec_id, pos, CAST(len(a) AS BIGINT) AS n_reference, CAST(len(b) AS BIGINT) AS n_hypothesis, row[-1] // 1048576 AS edits, row[-1] % 1048576 AS indels FROM dp WHERE i = len(a)),
  s AS (SELECT rec_id, pos, n_reference, n_hypothesis, edits - indels AS substitutions, (indels + n_hypothesis - n_reference) // 2 AS insertions, (indels - n_hypothesis + n_reference) // 2 AS deletions FROM e)"""


@query("word_errors", f"{_HEARD} SELECT * FROM s")
def word_errors(spark, d):
    return _heard(spark, d).select("rec_id", "pos", errors.word_counts(F.col("text"), F.col("heard")).alias("c")).select("rec_id", "pos", "c.*")


@query("error_rates", f"{_HEARD} SELECT speaker, count(*) AS n, CAST(sum(substitutions + insertions + deletions) AS BIGINT) AS edits, CAST(sum(n_reference) AS BIGINT) AS n_reference, CAST(sum(substitutions + insertions + deletions) AS DOUBLE) / nullif(sum(n_reference), 0) AS pooled, avg(CAST(substitutions + insertions + deletions AS DOUBLE) / nullif(n_reference, 0)) AS macro FROM s JOIN utterances USING (rec_id, pos) GROUP BY speaker")
def error_rates(spark, d):
    """Word error rates of each role, pooled and as the mean of its utterances'."""
    return errors.error_rates(_heard(spark, d).withColumn("counts", errors.word_counts(F.col("text"), F.col("heard"))), ["speaker"])


@query("character_errors")
def character_errors(spark, d):
    """Edits between the characters that were said and those that were written, for each conversation."""
    c = _heard(spark, d).select("rec_id", errors.character_counts(F.col("text"), F.col("heard")).alias("c"))
    return c.groupBy("rec_id").agg(F.sum(F.col("c.substitutions") + F.col("c.insertions") + F.col("c.deletions")).alias("edits"), F.sum("c.n_reference").alias("chars"))


@query("latency_percentiles", "SELECT event_type, quantile_cont(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return numeric.exact_percentile(table(spark, d, "events"), "event_type", "value", 0.95).withColumnRenamed("percentile", "p95")


@query("stage_progress", f"WITH {UTTERANCES_SQL} SELECT rec_id, pos, least(99, 25 + 55 * (row_number() OVER (PARTITION BY rec_id ORDER BY pos)) // (count(*) OVER (PARTITION BY rec_id))) AS percent FROM utterances")
def stage_progress(spark, d):
    w = Window.partitionBy("rec_id")
    return utterances(spark, d).select("rec_id", "pos", F.least(F.lit(99).cast("long"), F.lit(25) + F.floor(55 * F.row_number().over(w.orderBy("pos")) / F.count(F.lit(1)).over(w))).alias("percent"))


@query("batches", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS batch FROM conversations")
def batches(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.expr("(row_number() over (partition by conv_id order by turn) - 1) div 4").alias("batch"))


@query("missing_speakers_anti", "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT label FROM embeddings WHERE label IS NOT NULL)")
def missing_speakers_anti(spark, d):
    """Users without an embedding."""
    return table(spark, d, "events").select("user_id").where("user_id is not null").distinct().join(table(spark, d, "embeddings").select(F.col("label").cast("long").alias("user_id")), "user_id", "left_anti")


@query("language_check", "SELECT lang, count(*) AS n, lang IS NOT NULL AND name IN ('English', 'French', 'Spanish') AS valid FROM (SELECT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'Deutsch' WHEN 'es' THEN 'Spanish' ELSE lang END AS name FROM documents) GROUP BY lang, name")
def language_check(spark, d):
    """Documents of each language, and whether its name, however written, is one that is supported."""
    names = F.create_map(*(F.lit(x) for x in ("en", "english", "fr", " FRENCH", "de", "Deutsch", "es", "spanish ")))
    g = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return g.select("lang", "n", T.is_language(F.coalesce(names[F.col("lang")], "lang")).alias("valid"))
