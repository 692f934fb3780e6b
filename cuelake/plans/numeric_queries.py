"""Queries over frames and embeddings, and plain relational queries over the star schema. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diarize
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


@query("powerset_dim", "SELECT CAST(k AS INTEGER) AS class, m AS members FROM (VALUES (0, '000'), (1, '100'), (2, '010'), (3, '001'), (4, '110'), (5, '101'), (6, '011')) AS v(k, m)")
def powerset_dim(spark, d):
    return diarize.powerset(spark, 3, 2)


@query("embedding_argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS place FROM embeddings")
def embedding_argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", diarize.first_largest(F.col("embedding")).alias("place"))


@query("centroid_mean", "SELECT label, CAST(k - 1 AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 5) AS mean, count(*) AS n FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY ALL")
def centroid_mean(spark, d):
    return diarize.centroids(table(spark, d, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 5))


@query("nearest_centroid", "WITH c AS (SELECT label, list(m ORDER BY k) AS center FROM (SELECT label, k, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY ALL) GROUP BY label), s AS (SELECT vec_id, c.label, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), center) DESC, c.label) AS k FROM embeddings, c) SELECT vec_id, label AS nearest FROM s WHERE k = 1")
def nearest_centroid(spark, d):
    e = table(spark, d, "embeddings")
    c = diarize.centroids(e, "label", "embedding").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda x: x["mean"]).alias("center"))
    return diarize.nearest(e, "vec_id", "embedding", c)


@query("label_cluster_sizes", "SELECT label, count(*) AS n, count(*) >= least(12, greatest(1, round_even(0.1 * sum(count(*)) OVER (), 0))) AS is_large FROM embeddings GROUP BY label")
def label_cluster_sizes(spark, d):
    g = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = g.agg(F.sum("n").alias("whole"))
    return g.join(F.broadcast(whole)).select("label", "n", (F.col("n") >= F.least(F.lit(12.0), F.greatest(F.lit(1.0), F.rint(0.1 * F.col("whole"))))).alias("is_large"))


@query("active_embedding_filter", "WITH f AS (SELECT vec_id // 3 AS chunk, vec_id % 3 AS spk, k AS frame, CASE WHEN x > 0 THEN 1 ELSE 0 END AS active FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings)), a AS (SELECT *, sum(active) OVER (PARTITION BY chunk, frame) AS busy FROM f) SELECT chunk, spk, CAST(sum(CASE WHEN busy < 2 AND active = 1 THEN 1 ELSE 0 END) AS BIGINT) AS clean, count(DISTINCT frame) AS n FROM a GROUP BY chunk, spk HAVING sum(CASE WHEN busy < 2 AND active = 1 THEN 1 ELSE 0 END) >= 0.2 * count(DISTINCT frame)")
def active_embedding_filter(spark, d):
    f = table(spark, d, "embeddings").select(F.expr("vec_id div 3").alias("chunk"), (F.col("vec_id") % 3).alias("spk"), F.posexplode("embedding").alias("frame", "x"))
    return diarize.usable(f.withColumn("active", (F.col("x") > 0).cast("int")), ["chunk"], "frame", "spk")


# Plain relational queries: what any SQL engine has, over the star schema.


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS qty_cents, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price_cents, count(*) AS n FROM lineitem GROUP BY ALL")
def pricing_summary(spark, d):
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(cents("l_quantity").alias("qty_cents"), cents("l_extendedprice").alias("price_cents"), F.count(F.lit(1)).alias("n"))


@query("orders_by_nation", "SELECT n_name, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def orders_by_nation(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers"))


@query("event_rollup", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ROLLUP (CAST(ts AS DATE), event_type)")
def event_rollup(spark, d):
    return table(spark, d, "events").select(F.to_date("ts").cast("string").alias("day"), "event_type").rollup("day", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def customers_without_orders(spark, d):
    """Customers without an urgent order."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("event_windows", "SELECT w AS start_min, event_type, count(*) AS n FROM (SELECT epoch_us(ts) // 600000000 * 10 AS w, event_type FROM events) GROUP BY ALL")
def event_windows(spark, d):
    return table(spark, d, "events").select((F.expr("unix_micros(cast(ts as timestamp)) div 600000000") * 10).alias("start_min"), "event_type").groupBy("start_min", "event_type").agg(F.count(F.lit(1)).alias("n"))
