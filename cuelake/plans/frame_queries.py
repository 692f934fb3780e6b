"""Queries over frames of overlapping chunks, made of the embeddings: three vectors are a chunk's three speakers, their places its frames. Each has its SQL beside it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import cluster, diarize, frames
from .adapters import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _frames(spark, d):
    f = table(spark, d, "embeddings").select(F.expr("vec_id div 3").alias("chunk"), (F.col("vec_id") % 3).alias("spk"), F.posexplode("embedding").alias("frame", "x"))
    return f.withColumn("active", (F.col("x") > 0.1).cast("int"))


_FRAMES = "f AS (SELECT vec_id // 3 AS chunk, vec_id % 3 AS spk, k - 1 AS frame, x, CASE WHEN x > CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END AS active FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings))"


@query("embedding_mask", f"WITH {_FRAMES}, c AS (SELECT *, CASE WHEN sum(active) OVER (PARTITION BY chunk, frame) < 2 THEN active ELSE 0 END AS clean FROM f), u AS (SELECT *, CASE WHEN sum(clean) OVER (PARTITION BY chunk, spk) > 6 THEN clean ELSE active END AS used FROM c) SELECT chunk, spk, CAST(sum(active) AS BIGINT) AS active, CAST(sum(used) AS BIGINT) AS used FROM u GROUP BY ALL")
def embedding_mask(spark, d):
    u = frames.embedding_mask(_frames(spark, d), ["chunk"], "frame", "spk", 6)
    return u.groupBy("chunk", "spk").agg(F.sum("active").alias("active"), F.sum("used").alias("used"))


@query("inactive_clusters", f"WITH {_FRAMES}, s AS (SELECT chunk, spk, max(CASE WHEN x > CAST(0.35 AS DOUBLE) THEN 1 ELSE 0 END) AS seen FROM f GROUP BY ALL) SELECT e.vec_id // 3 AS chunk, e.vec_id % 3 AS spk, CASE WHEN seen = 0 THEN -2 ELSE e.label END AS cluster FROM embeddings e JOIN s ON e.vec_id // 3 = s.chunk AND e.vec_id % 3 = s.spk")
def inactive_clusters(spark, d):
    clusters = table(spark, d, "embeddings").select(F.expr("vec_id div 3").alias("chunk"), (F.col("vec_id") % 3).alias("spk"), F.col("label").alias("cluster"))
    loud = _frames(spark, d).withColumn("active", (F.col("x") > 0.35).cast("int"))
    return frames.mark_inactive(clusters, loud, ["chunk", "spk"])


#: Where a chunk has no score: every seventh value of the first speaker.
@query("overlap_add", f"WITH {_FRAMES}, m AS (SELECT spk, CAST(greatest(0, round_even(chunk * CAST(1.0 AS DOUBLE) / CAST(0.016 AS DOUBLE), 0)) + frame AS INTEGER) AS \"at\", CASE WHEN spk = 0 AND (frame % 7 = 3) THEN NULL ELSE CAST(round(CAST(x AS DOUBLE) * 1024) AS BIGINT) END AS s FROM f) SELECT spk, \"at\", CASE WHEN count(s) = 0 THEN -1.0 ELSE CAST(sum(s) AS DOUBLE) / count(s) END AS value FROM m GROUP BY ALL")
def overlap_add(spark, d):
    f = _frames(spark, d).withColumn("s", F.when(~((F.col("spk") == 0) & (F.col("frame") % 7 == 3)), F.round(F.col("x").cast("double") * 1024)))
    return frames.overlap_add(f, ["spk"], "chunk", "frame", "s", 1.0, 0.016, missing=-1.0)


@query("overlap_sum", f"WITH {_FRAMES}, m AS (SELECT spk, CAST(greatest(0, round_even(chunk * CAST(0.5 AS DOUBLE) / CAST(0.25 AS DOUBLE), 0)) + frame AS INTEGER) AS \"at\", active FROM f) SELECT spk, \"at\", CAST(sum(active) AS DOUBLE) AS value FROM m GROUP BY ALL")
def overlap_sum(spark, d):
    return frames.overlap_add(_frames(spark, d), ["spk"], "chunk", "frame", "active", 0.5, 0.25, average=False)


@query("nearest_upsample", "SELECT vec_id, [embedding[CAST(least(floor(i * (CAST(64 AS DOUBLE) / 100)), 63) AS INTEGER) + 1] FOR i IN range(0, 100)] AS values FROM embeddings")
def nearest_upsample(spark, d):
    return table(spark, d, "embeddings").select("vec_id", frames.upsample(F.col("embedding"), 100).alias("values"))


@query("active_spans", "WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value FROM events), s AS (SELECT *, coalesce(last_value(CASE WHEN value > 60 THEN 1 WHEN value < 30 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS a FROM f), e AS (SELECT *, CASE WHEN a = lag(a) OVER w THEN 0 ELSE 1 END AS edge, frame * 17 + 10 AS m, coalesce(lead(frame * 17 + 10) OVER w, frame * 17 + 10) AS t FROM s WINDOW w AS (PARTITION BY user_id ORDER BY frame)), r AS (SELECT *, sum(edge) OVER (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id, CAST(run AS BIGINT) AS run, min(m) AS start, max(t) AS \"end\" FROM r WHERE a = 1 GROUP BY user_id, run HAVING max(t) > min(m)")
def active_spans(spark, d):
    f = table(spark, d, "events").select("user_id", "value", (F.expr("row_number() over (partition by user_id order by ts, event_id)") - 1).alias("frame"))
    return frames.active_spans(f, ["user_id"], "frame", "value", 17, 20, 60, 30)


@query("cluster_bounds", "WITH n AS (SELECT label, CAST(count(*) AS INTEGER) AS n, CASE WHEN label % 4 = 0 THEN NULL ELSE label % 4 END AS wanted, label % 3 AS least, CASE WHEN label % 5 = 0 THEN 0 ELSE 20 END AS most FROM embeddings GROUP BY label), b AS (SELECT *, greatest(1, least(n, coalesce(nullif(wanted, 0), nullif(least, 0), 1))) AS low, greatest(1, least(n, coalesce(nullif(wanted, 0), nullif(most, 0), n))) AS high FROM n) SELECT label, CAST(CASE WHEN low = high THEN low ELSE wanted END AS INTEGER) AS wanted, CAST(low AS INTEGER) AS low, CAST(high AS INTEGER) AS high FROM b")
def cluster_bounds(spark, d):
    n = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).cast("int").alias("n"))
    wanted, most = F.when(F.col("label") % 4 != 0, F.col("label") % 4), F.when(F.col("label") % 5 == 0, 0).otherwise(20)
    w, low, high = frames.cluster_bounds(F.col("n"), wanted, F.col("label") % 3, most)
    return n.select("label", w.cast("int").alias("wanted"), low.cast("int").alias("low"), high.cast("int").alias("high"))


@query("cluster_vectors")
def cluster_vectors(spark, d):
    """Each 400 vectors a recording: its clusters, five of them wanted."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        found = cluster.agglomerate(np.stack(pdf["embedding"].to_numpy()).astype(float), wanted=5)
        return pd.DataFrame({"rec_id": key[0], "vec_id": pdf["vec_id"], "cluster": found})

    return table(spark, d, "embeddings").select(F.expr("vec_id div 400").alias("rec_id"), "vec_id", "embedding").groupBy("rec_id").applyInPandas(run, "rec_id long, vec_id long, cluster int")


@query("powerset_decode", "WITH p AS (SELECT * FROM (VALUES (0, '000'), (1, '100'), (2, '010'), (3, '001'), (4, '110'), (5, '101'), (6, '011')) AS v(class, members)), s AS (SELECT vec_id, embedding[1:7] AS h FROM embeddings) SELECT vec_id, CAST(list_position(h, list_max(h)) - 1 AS INTEGER) AS class, members FROM s JOIN p ON class = list_position(h, list_max(h)) - 1")
def powerset_decode(spark, d):
    heads = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 7).alias("h"))
    return frames.decode_classes(heads, "h", diarize.powerset(spark, 3, 2)).select("vec_id", "class", "members")


@query("quantized_similarity", "WITH q AS (SELECT vec_id, embedding AS a, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 16) / 16 AS FLOAT)) AS b FROM embeddings) SELECT vec_id, round(list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])), 8) AS cosine, round(list_sum(list_transform(list_zip(a, b), lambda z: abs(CAST(z[1] AS DOUBLE) - z[2]))) / len(a), 8) AS mae, CAST(len(a) AS DOUBLE) / len(list_distinct(b)) AS ratio FROM q")
def quantized_similarity(spark, d):
    """Vectors against coarser ones, as an exported model is held against its source; the ratio is that of two costs."""
    q = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"), F.transform("embedding", lambda x: (F.round(x.cast("double") * 16) / 16).cast("float")).alias("b"))
    ratio = F.try_divide(F.size("a").cast("double"), F.size(F.array_distinct("b")))
    return q.select("vec_id", F.round(frames.similarity(F.col("a"), F.col("b")), 8).alias("cosine"), F.round(frames.mean_absolute_error(F.col("a"), F.col("b")), 8).alias("mae"), ratio.alias("ratio"))


@query("event_cube", "SELECT event_type, user_id % 4 AS part, count(*) AS n, CAST(grouping(event_type) AS INTEGER) AS all_types FROM events GROUP BY CUBE (event_type, user_id % 4)")
def event_cube(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 4).alias("part"))
    return e.cube("event_type", "part").agg(F.count(F.lit(1)).alias("n"), F.grouping("event_type").cast("int").alias("all_types"))


@query("distinct_sketch", "SELECT event_type, count(DISTINCT user_id) AS n_users, TRUE AS near FROM events GROUP BY event_type")
def distinct_sketch(spark, d):
    """Exact distinct users, and whether a HyperLogLog sketch, merged from day sketches, is within a twentieth (or one) of them."""
    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id", F.lit(14)).alias("sketch"))
    merged = days.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
    exact = table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))
    return exact.join(merged, "event_type").select("event_type", "n_users", (F.abs(F.col("about") - F.col("n_users")) <= F.greatest(F.lit(1.0), F.col("n_users") / 20)).alias("near"))


@query("labels_except_intersect", "SELECT label, 'large' AS kind FROM (SELECT label FROM embeddings GROUP BY label INTERSECT SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 12) UNION ALL SELECT label, 'small' FROM (SELECT label FROM embeddings EXCEPT SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 12)")
def labels_except_intersect(spark, d):
    """Labels of clusters that are large and small, by set operations."""
    labels = table(spark, d, "embeddings").select("label")
    large = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 12").select("label")
    return labels.intersect(large).withColumn("kind", F.lit("large")).unionByName(labels.subtract(large).withColumn("kind", F.lit("small")))
