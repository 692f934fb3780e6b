"""Queries over chunks, their items and their prompts. Each has its SQL beside it where SQL can say it."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import align, chunks, timeline
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


def _words(spark, d):
    """Words of the utterances with their times, and the chunk of 40 s that each starts in."""
    u = utterances(spark, d).select("rec_id", "pos", "start_ms", "dur_ms", F.posexplode(F.regexp_extract_all("text", F.lit("[^ ]+"), 0)).alias("k", "word")).withColumn("k", F.col("k") + 1)
    w = timeline.proportional(u, ["rec_id", "pos"], "k", F.length("word"), "start_ms", "dur_ms")
    return w.select("rec_id", "pos", "k", "word", F.col("part_start_ms").alias("ws"), F.col("part_end_ms").alias("we"), F.expr("part_start_ms div 40000").alias("chunk"))


_WORDS = f"""{UTTERANCES_SQL}, w0 AS (SELECT rec_id, pos, start_ms, dur_ms, unnest(regexp_extract_all(text, '[^ ]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^ ]+'), 1) AS k FROM utterances),
  w1 AS (SELECT *, sum(length(word)) OVER (PARTITION BY rec_id, pos ORDER BY k ROWS UNBOUNDED PRECEDING) AS u, sum(length(word)) OVER (PARTITION BY rec_id, pos) AS t FROM w0),
  w AS (SELECT rec_id, pos, k, word, CAST(start_ms + dur_ms * (u - length(word)) // t AS BIGINT) AS ws, CAST(start_ms + dur_ms * u // t AS BIGINT) AS we, CAST((start_ms + dur_ms * (u - length(word)) // t) // 40000 AS BIGINT) AS chunk FROM w1)"""


@query("shift_items", f"WITH {_WORDS} SELECT rec_id, chunk, pos, k, round(CAST(ws AS DOUBLE) / 1000, 3) AS start_s, round(CAST(we AS DOUBLE) / 1000, 3) AS end_s FROM w")
def shift_items(spark, d):
    """Words timed within their chunk, moved to their place in the recording."""
    w = _words(spark, d).withColumn("offset_s", F.col("chunk") * 40.0)
    inside = w.withColumns({"start_s": F.col("ws") / 1000 - F.col("offset_s"), "end_s": F.col("we") / 1000 - F.col("offset_s")})
    return chunks.shift(inside, "offset_s").select("rec_id", "chunk", "pos", F.col("k").cast("long").alias("k"), "start_s", "end_s")


@query("spread_context", f"WITH {UTTERANCES_SQL}, n AS (SELECT rec_id, count(*) AS n FROM utterances GROUP BY rec_id), g AS (SELECT rec_id, pos, speaker, row_number() OVER (PARTITION BY rec_id ORDER BY pos) AS k FROM utterances), v AS (SELECT g.rec_id, k, speaker FROM g JOIN n USING (rec_id) WHERE CASE WHEN rec_id % 3 = 0 THEN k = 1 WHEN rec_id % 3 = 1 THEN TRUE ELSE k <= 2 END), c AS (SELECT rec_id, count(*) AS c FROM v GROUP BY rec_id) SELECT g.rec_id, CAST(g.k - 1 AS INTEGER) AS place, CASE WHEN c = n THEN v.speaker WHEN c = 1 THEN f.speaker END AS speaker FROM g JOIN n USING (rec_id) JOIN c USING (rec_id) LEFT JOIN v ON v.rec_id = g.rec_id AND v.k = g.k LEFT JOIN v f ON f.rec_id = g.rec_id AND f.k = 1")
def spread_context(spark, d):
    """One, all or two contexts are given for a recording's utterances; two are wrong unless there are two utterances."""
    u = utterances(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("rec_id").orderBy("pos")))
    third = F.col("rec_id") % 3
    given = u.where(F.when(third == 0, F.col("k") == 1).when(third == 1, F.lit(True)).otherwise(F.col("k") <= 2))
    return chunks.spread(given, u.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n")), "rec_id", "k", "speaker", strict=False)


@query("context_lookup", f"WITH {_WORDS}, r AS (SELECT conv_id AS rec_id, arg_min(role, turn) AS context FROM conversations GROUP BY conv_id) SELECT rec_id, chunk, context, count(*) AS n_words FROM w LEFT JOIN r USING (rec_id) GROUP BY ALL")
def context_lookup(spark, d):
    recordings = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("rec_id")).agg(F.min_by("role", "turn").alias("context"))
    found = _words(spark, d).groupBy("rec_id", "chunk").agg(F.count(F.lit(1)).alias("n_words"))
    return chunks.with_context(found, recordings, "rec_id").select("rec_id", "chunk", "context", "n_words")


@query("scatter_alignment", f"WITH {_WORDS}, r AS (SELECT rec_id, pos, count(*) AS n_items, max(we) AS end_ms FROM w GROUP BY ALL) SELECT u.rec_id, u.pos, n_items, r.end_ms FROM utterances u LEFT JOIN r ON u.rec_id = r.rec_id AND u.pos = r.pos")
def scatter_alignment(spark, d):
    """Only utterances with words are aligned; the others keep their place."""
    results = _words(spark, d).groupBy("rec_id", "pos").agg(F.count(F.lit(1)).alias("n_items"), F.max("we").alias("end_ms"))
    return chunks.scatter(utterances(spark, d).select("rec_id", "pos"), results, ["rec_id", "pos"])


@query("merge_alignments", f"WITH {_WORDS}, r AS (SELECT rec_id, string_agg(word, '|' ORDER BY chunk, ws, pos, k) AS words, count(*) AS n FROM w GROUP BY rec_id) SELECT DISTINCT u.rec_id, words, CAST(n AS INTEGER) AS n FROM utterances u LEFT JOIN r ON u.rec_id = r.rec_id")
def merge_alignments(spark, d):
    w = _words(spark, d).withColumn("at", F.struct("ws", "pos", "k"))
    some = utterances(spark, d).select("rec_id").distinct().join(w, "rec_id", "left")
    m = chunks.merge_items(some, "rec_id", "chunk", "at", "word", "ws", "we")
    return m.select("rec_id", F.array_join(F.transform("items", lambda x: x["word"]), "|").alias("words"), F.when(F.col("items").isNotNull(), F.size("items")).alias("n"))


@query("chunk_memory", f"WITH {_WORDS}, c AS (SELECT rec_id, chunk, string_agg(word, ' ' ORDER BY ws, pos, k) AS text FROM w GROUP BY ALL) SELECT rec_id, chunk, coalesce(string_agg(text, '|') OVER (PARTITION BY rec_id ORDER BY chunk ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS memory FROM c")
def chunk_memory(spark, d):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ws", "pos", "k", "word"))), lambda x: x["word"])
    c = _words(spark, d).groupBy("rec_id", "chunk").agg(F.array_join(texts, " ").alias("text"))
    return chunks.memory(c, ["rec_id"], "chunk", "text", 2).select("rec_id", "chunk", F.array_join("memory", "|").alias("memory"))


@query("chunked_index", f"WITH RECURSIVE {_WORDS}, t AS (SELECT rec_id, ws // 80 AS v, row_number() OVER (PARTITION BY rec_id ORDER BY pos, k) AS i FROM w), r AS (SELECT rec_id, i, v, 1 + CASE WHEN v >= 50 THEN 1 ELSE 0 END AS c FROM t WHERE i = 1 UNION ALL SELECT t.rec_id, t.i, t.v, r.c + CASE WHEN t.v >= r.c * 50 THEN 1 ELSE 0 END FROM r JOIN t ON t.rec_id = r.rec_id AND t.i = r.i + 1) SELECT rec_id, c AS chunk, min(i) AS first, max(i) AS last FROM r GROUP BY ALL")
def chunked_index(spark, d):
    """Tokens at 80 ms a step in chunks of 50 steps. An utterance's tokens stay in one row."""
    @F.pandas_udf("array<long>")
    def steps(text: pd.Series, start: pd.Series, total: pd.Series) -> pd.Series:
        out = []
        for t, s, ms in zip(text, start, total):
            sizes = [len(w) for w in t.split(" ") if w]
            whole = sum(sizes)
            out.append([(s + ms * since // whole) // 80 for since in itertools.accumulate(sizes[:-1], initial=0)] if sizes else [])
        return pd.Series(out, dtype=object)

    u = utterances(spark, d).select("rec_id", "pos", steps("text", "start_ms", "dur_ms").alias("v"))
    return chunks.chunk_spans(u.where(F.size("v") > 0), ["rec_id"], "pos", "v", 50)


_BREAKS = "。！？!?…～，、；：,;:"


@query("split_by_signs", f"WITH {UTTERANCES_SQL}, s AS (SELECT rec_id, pos, string_split(regexp_replace(regexp_replace(text, '([{_BREAKS}\\n\\r])', '\\1' || chr(1), 'g'), '\\.(\\s)', '.' || chr(1) || '\\1', 'g'), chr(1)) AS p FROM utterances) SELECT rec_id, pos, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS pieces FROM s")
def split_by_signs(spark, d):
    return utterances(spark, d).select("rec_id", "pos", T.split_by_signs(F.col("text")).alias("pieces"))


@query("tokenize_mixed", r"SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}'']+') AS tokens FROM benchmark")
def tokenize_mixed(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.mixed_tokens(F.col("text")).alias("tokens"))


@query("timestamp_prompt", r"WITH t AS (SELECT doc_id, lang, regexp_extract_all(regexp_replace(text, '[^\p{L}\p{N}''\s]', '', 'g'), '[^\s]+') AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, '<|audio_start|><|audio_pad|><|audio_end|>' || array_to_string(t, '<timestamp><timestamp>') || '<timestamp><timestamp>' AS prompt FROM t")
def timestamp_prompt(spark, d):
    texts = table(spark, d, "documents").where("text is not null")
    return texts.select("doc_id", chunks.timestamp_prompt(T.tokens_of(F.col("text"), F.col("lang"))).alias("prompt"))


@query("character_tokens", "SELECT item_id, string_split(text, '') AS tokens FROM benchmark WHERE text <> ''")
def character_tokens(spark, d):
    """What is taken as words of Japanese and Korean texts where no library for them is there."""
    return table(spark, d, "benchmark").where("text <> ''").select("item_id", T.tokens_of(F.col("text"), F.lit("Japanese")).alias("tokens"))


@query("parse_timestamps")
def parse_timestamps(spark, d):
    """Words with the times of their repaired classes; every class that a word of seven letters begins is an outlier."""
    @F.pandas_udf("array<int>")
    def fixed(classes: pd.Series) -> pd.Series:
        return classes.map(lambda v: align.fix_timestamps(list(v)))

    words = T.tokens(F.col("text"))
    raw = F.flatten(F.transform(words, lambda w, i: F.array(F.when(F.length(w) == 7, 3999).otherwise(3 * i), 3 * i + 2)))
    u = utterances(spark, d).select("rec_id", "pos", "start_ms", words.alias("words"), fixed(raw).alias("classes"))
    return u.select("rec_id", "pos", F.inline(chunks.timed_words(F.col("words"), F.col("classes"), F.col("start_ms"))))


@query("resolve_backend", "SELECT user_id, CASE WHEN n % 4 = 0 THEN 'cpu' WHEN n % 4 = 1 AND c THEN 'cuda' WHEN n % 4 = 2 AND v THEN 'vulkan' WHEN n % 4 = 3 AND c THEN 'cuda' WHEN n % 4 = 3 AND v THEN 'vulkan' ELSE 'cpu' END AS backend FROM (SELECT user_id, count(*) AS n, user_id % 2 = 0 AS c, user_id % 3 = 0 AS v FROM events GROUP BY user_id)")
def resolve_backend(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    want = F.element_at(F.array(*(F.lit(x) for x in (" OFF", "nvidia", "Vk ", ""))), (F.col("n") % 4 + 1).cast("int"))
    return u.select("user_id", T.resolve_backend(want, F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0).alias("backend"))


@query("translation_prompt", f"WITH {UTTERANCES_SQL}, g AS (SELECT rec_id, list(text ORDER BY pos) AS l FROM utterances WHERE text <> '' GROUP BY rec_id) SELECT rec_id, 'Translate.' || CASE WHEN len(l) > 1 THEN chr(10) || 'Give ' || len(l) || ' parts.' ELSE '' END AS system, trim(array_to_string(list_transform(l, lambda x, i: CASE WHEN len(l) > 1 THEN CAST(i AS VARCHAR) || '. ' ELSE '' END || x), chr(10)) || ' end') AS user FROM g")
def translation_prompt(spark, d):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    g = utterances(spark, d).where("text <> ''").groupBy("rec_id").agg(texts.alias("l"))
    system, user = T.translation_prompt(F.col("l"), "Translate.\n{text} end", "Give {count} parts.")
    return g.select("rec_id", system.alias("system"), user.alias("user"))
