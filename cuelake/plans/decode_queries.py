"""Queries over logits, prompts and weights; embeddings stand for logits, parts for tensors and files. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decode
from .adapters import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_ROWS = "l AS (SELECT vec_id, k - 1 AS token, CAST(x AS DOUBLE) * 20 AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings))"
_BEST = "row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, token) AS place"
_LIST = "string_agg(CAST(token AS VARCHAR), ' ' ORDER BY place) AS tokens"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _logits(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 20).alias("logits"))


def _tokens(found):
    return F.array_join(F.transform(found, lambda c: c["token"].cast("string")), " ").alias("tokens")


@query("token_mask", f"WITH {_ROWS}, m AS (SELECT vec_id, token, CASE WHEN token >= 8 AND token < 24 OR token IN (3, 40) THEN x ELSE -1e10 END AS x FROM l) SELECT vec_id, count(*) FILTER (x > -1e10) AS n_open, CAST(arg_max(token, (x, -token)) AS INTEGER) AS token FROM m GROUP BY vec_id")
def token_mask(spark, d):
    x = decode.allowed(F.col("logits"), 8, 24, (3, 40))
    return _logits(spark, d).select("vec_id", F.size(F.filter(x, lambda y: y > decode.NEVER)).cast("long").alias("n_open"), decode.greedy(decode.candidates(x)).alias("token"))


@query("sampler_top_k", f"WITH {_ROWS}, r AS (SELECT *, {_BEST} FROM l) SELECT vec_id, {_LIST} FROM r WHERE place <= 5 GROUP BY vec_id")
def sampler_top_k(spark, d):
    return _logits(spark, d).select("vec_id", _tokens(decode.top_k(decode.candidates(F.col("logits")), 5)))


@query("sampler_top_p", f"WITH {_ROWS}, r AS (SELECT *, {_BEST}, exp(x - max(x) OVER (PARTITION BY vec_id)) AS m FROM l), s AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY vec_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(m) OVER (PARTITION BY vec_id) AS total FROM r) SELECT vec_id, {_LIST} FROM s WHERE before < 0.8 * total GROUP BY vec_id")
def sampler_top_p(spark, d):
    return _logits(spark, d).select("vec_id", _tokens(decode.top_p(decode.candidates(F.col("logits")), 0.8)))


@query("sampler_min_p", f"WITH {_ROWS}, r AS (SELECT *, {_BEST}, max(x) OVER (PARTITION BY vec_id) AS best FROM l) SELECT vec_id, {_LIST} FROM r WHERE x >= best + ln(CAST(0.1 AS DOUBLE)) GROUP BY vec_id")
def sampler_min_p(spark, d):
    return _logits(spark, d).select("vec_id", _tokens(decode.min_p(decode.candidates(F.col("logits")), 0.1)))


_CHAIN = f"""WITH {_ROWS}, h(token, n) AS (VALUES (1, 2), (5, 1), (9, 1)), b AS (SELECT vec_id, token, x + CASE token WHEN 2 THEN 1.5 WHEN 7 THEN -2.0 ELSE 0.0 END AS x FROM l),
 p AS (SELECT vec_id, b.token, CASE WHEN n IS NULL THEN x ELSE CASE WHEN x > 0 THEN x / 1.1 ELSE x * 1.1 END - n * 0.2 - 0.1 END AS x FROM b LEFT JOIN h ON b.token = h.token),
 k AS (SELECT * FROM (SELECT *, {_BEST} FROM p) WHERE place <= 20),
 m AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS m FROM k),
 c AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY vec_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(m) OVER (PARTITION BY vec_id) AS total FROM m),
 e AS (SELECT *, exp((x - max(x) OVER (PARTITION BY vec_id)) / 0.8) AS w FROM c WHERE before < 0.9 * total AND m >= 0.05),
 f AS (SELECT vec_id, token, place, sum(w) OVER (PARTITION BY vec_id ORDER BY place) AS upto, sum(w) OVER (PARTITION BY vec_id) AS whole, CAST(('0x' || substr(md5('11:' || vec_id), 1, 8)) AS UBIGINT) / 4294967296.0 AS u FROM e)
 SELECT vec_id, CAST(arg_min(token, place) AS INTEGER) AS token FROM f WHERE upto > u * whole GROUP BY vec_id"""


@query("sampler_chain", _CHAIN)
def sampler_chain(spark, d):
    # the first 1 is out of the last four
    history = F.array(*map(F.lit, (1, 1, 5, 9, 1)))
    token = decode.sample(F.col("logits"), F.col("vec_id"), k=20, p=0.9, least=0.05, bias={2: 1.5, 7: -2.0}, history=history, last=4, repeat=1.1, frequency=0.2, presence=0.1, seed=11)
    return _logits(spark, d).select("vec_id", token.alias("token"))


@query("prompt_positions", "WITH t AS (SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n, CAST(doc_id % 3 AS BIGINT) AS spans FROM documents) SELECT doc_id, greatest(n, CASE WHEN spans > 0 THEN 300 * spans ELSE 0 END) - n AS delta, greatest(n, CASE WHEN spans > 0 THEN 300 * spans ELSE 0 END) AS n_positions FROM t")
def prompt_positions(spark, d):
    spans = F.slice(F.array(*(F.struct(F.lit(a).alias("offset"), F.lit(200).alias("length")) for a in (100, 400))), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    p = decode.positions(F.length(F.coalesce("text", F.lit(""))).cast("long"), spans)
    return table(spark, d, "documents").select("doc_id", p.alias("p")).select("doc_id", "p.delta", F.size("p.positions").cast("long").alias("n_positions"))


@query("gather_rows", "SELECT event_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x, len(embedding) IS NOT NULL AS found FROM events LEFT JOIN embeddings ON user_id = vec_id")
def gather_rows(spark, d):
    g = decode.gather(table(spark, d, "events").select("event_id", "user_id"), "user_id", table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    return g.select("event_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("x"), F.col("embedding").isNotNull().alias("found"))


_BITS = "CAST(event_id * 37 % 31744 AS BIGINT)"


@query("half_precision", f"SELECT event_id, CASE WHEN b < 1024 THEN b * pow(2.0, -24) ELSE (1024 + b % 1024) * pow(2.0, b // 1024 - 25) END AS x FROM (SELECT event_id, {_BITS} AS b FROM events)")
def half_precision(spark, d):
    return table(spark, d, "events").select("event_id", decode.small_float((F.col("event_id") * 37 % 31744).cast("int"), 5, 10).alias("x"))


@query("tensor_stats", "WITH g AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'blk.' || (p_partkey % 7) WHEN 1 THEN 'enc.blk.' || (p_partkey % 3) WHEN 2 THEN 'dec' ELSE 'base' END AS tensor_group, CAST(sum(p_size) AS BIGINT) AS elements, CAST(sum(CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 4 END * p_size) AS BIGINT) AS bytes FROM part GROUP BY 1) SELECT tensor_group, elements, bytes, round(elements / sum(elements) OVER () * 100, 6) AS percent, round(bytes * 8 / elements, 6) AS bits FROM g")
def tensor_stats(spark, d):
    key = F.col("p_partkey")
    name = F.when(key % 5 == 0, F.concat(F.lit("blk."), (key % 7).cast("string"), F.lit(".attn.weight"))).when(key % 5 == 1, F.concat(F.lit("enc.blk."), (key % 3).cast("string"), F.lit(".w"))).when(key % 5 == 2, F.lit("dec.norm")).otherwise(F.lit("output.weight"))
    p = table(spark, d, "part").select(name.alias("name"), F.col("p_size").cast("long").alias("n"), (F.when(key % 2 == 0, 2).otherwise(4) * F.col("p_size")).cast("long").alias("size"))
    return decode.tensor_stats(p, "name", "n", "size").withColumns({"percent": F.round("percent", 6), "bits": F.round("bits", 6)})


@query("release_files", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN page_id // 4 % 4 IN (0, 2) WHEN 2 THEN true ELSE false END AS released FROM pages")
def release_files(spark, d):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    path = F.concat(F.lit("dist/"), pick(("model", "__pycache__", "src", ".git"), F.col("page_id")), F.lit("/a"), F.col("page_id").cast("string"), pick((".txt", ".bin", ".TXT", ".py"), F.expr("page_id div 4")))
    return table(spark, d, "pages").select("page_id", decode.released(path).alias("released"))


@query("settings_merge", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '0') AS k, 'false' AS dark_mode, 2 AS n FROM events")
def settings_merge(spark, d):
    s = table(spark, d, "events").select("event_id", decode.settings(F.col("props"), {"k": "0", "dark_mode": "false"}).alias("s"))
    return s.select("event_id", F.col("s")["k"].alias("k"), F.col("s")["dark_mode"].alias("dark_mode"), F.size("s").alias("n"))
