"""Sharding by Karmarkar-Karp differencing: near-equal bytes over a fixed number of shards, equal texts together.

Law ``bytes``. The items are groups of equal texts. Every group that fits a shard's share stays whole; only a larger one, of which there
are fewer than shards, is divided into as few pieces as fit. Differencing holds a heap of partial partitions (one
sum for each shard), and repeatedly takes the two with the largest spread and adds one to the other in opposite
order. No task and not the driver ever holds all items:

* heavy items, with over ``1/HEAVY`` of all bytes or rows, are at most ``2 * HEAVY`` whatever the input; they wait for the last step.
* the other items are hashed to buckets of about ``ITEMS`` items; each bucket is differenced in its own task to a partial partition.
* partial partitions are differenced with one another, ``ITEMS`` in a task, level by level, until at most ``ITEMS`` are left; the
  driver differences those together with the heavy items. A bucket keeps, for each level, which set of the result its sets went to.

Null text counts as empty text (size 8, crc32 0). Texts of any length count whole. Null doc_ids are kept as rows. Repeated rows are rows of
their own, in the group of their text; their slots follow the order in which they are read. An empty table gives an empty result. Other columns of the
input, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, read, scalar

#: Items above this fraction of all bytes or rows are placed first; bounds what the driver differences.
HEAVY = 1536
#: Items of a bucket, partial partitions that are differenced together, and rows of a slot block, on average.
ITEMS, BLOCK = 2000, 20_000


def combine(parts: list[list[float]], k: int) -> tuple[list[list[int]], list[float]]:
    """Karmarkar-Karp differencing of partial partitions into ``k`` sets: for each the set that each of its places goes to, and
    the sets' sums. A part of one place is an item. Ties go by the parts' order."""
    if k < 1:
        raise ValueError("k must be positive")
    # a partition: (-spread, id, sums in ascending order, for each place of those the members as a linked list)
    heap = []
    for i, part in enumerate(parts):
        places = sorted(range(len(part)), key=part.__getitem__)
        sums = [0.0] * (k - len(part)) + [float(part[j]) for j in places]
        slots = [None] * (k - len(part)) + [((i, j), None, None) for j in places]
        order = sorted(range(k), key=sums.__getitem__)
        heap.append((sums[order[0]] - sums[order[-1]], i, [sums[j] for j in order], [slots[j] for j in order]))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, a_slots = heapq.heappop(heap)
        _, _, b, b_slots = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b))]
        slots = [x if y is None else y if x is None else (None, x, y) for x, y in zip(a_slots, reversed(b_slots))]
        by = sorted(range(k), key=sums.__getitem__)
        sums = [sums[j] for j in by]
        n += 1
        heapq.heappush(heap, (sums[0] - sums[-1], n, sums, [slots[j] for j in by]))
    to, totals = [[0] * len(part) for part in parts], [0.0] * k
    for shard, (total, slot) in enumerate(zip(heap[0][2], heap[0][3]) if heap else ()):
        totals[shard] = total
        stack = [slot] if slot else []
        while stack:
            leaf, x, y = stack.pop()
            if leaf is None:
                stack += [x, y]
            else:
                to[leaf[0]][leaf[1]] = shard
    return to, totals


def differencing(sizes: list[float], k: int) -> tuple[list[int], list[float]]:
    """The set of each item, and the sets' sums."""
    to, totals = combine([[s] for s in sizes], k)
    return [x[0] for x in to], totals


def shard(docs: DataFrame, n_shards: int = 24, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, group, shard and slot of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = scratch.save(
        docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.octet_length(text)).alias("grp"), F.monotonically_increasing_id().alias("uid")),
        "base",
    )
    groups = base.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    whole = scalar(base.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    total, rows = whole["bytes"] or 0, whole["n"]
    share = total / n_shards
    # fewer groups than shards are over a share
    large = groups.where(F.col("bytes") > share).withColumn("pieces", F.ceil(F.col("bytes") / share).cast("int")).select("grp", "pieces")
    large = spark.createDataFrame([tuple(r) for r in large.collect()], "grp long, pieces int")
    base = base.join(F.broadcast(large), "grp", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("uid"), F.col("pieces")).cast("int"), F.lit(0))).drop("pieces")
    items = scratch.save(base.groupBy("grp", "piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "items")
    is_heavy = (F.col("bytes") > max(1, total) / HEAVY) | (F.col("n") > max(1, rows) / HEAVY)
    heavy = sorted((r["bytes"], r["grp"], r["piece"]) for r in items.where(is_heavy).collect())

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "grp", "piece"], kind="stable")
        to, _ = differencing(pdf["bytes"].tolist(), n_shards)
        return pd.DataFrame({"node": np.full(len(pdf), key[0], "int64"), "grp": pdf["grp"].to_numpy(), "piece": pdf["piece"].to_numpy(), "bytes": pdf["bytes"].to_numpy(), "place": np.array(to, "int32")})

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        to, _ = combine([list(x) for x in pdf["sums"]], n_shards)
        return pd.DataFrame({"node": pdf["node"].to_numpy(), "up": np.full(len(pdf), key[0], "int64"), "places": to, "sums": pdf["sums"]})

    def dealt(column: str, n: int):
        return F.pmod(F.xxhash64(column, F.lit(n)), F.lit(max(1, -(-n // ITEMS)))).cast("long")

    def sums(df: DataFrame, node: str) -> DataFrame:
        """The partial partition of each node, from bytes by place."""
        by = df.groupBy(F.col(node).alias("node"), "place").agg(F.sum("bytes").cast("double").alias("bytes"))
        at = lambda j: F.coalesce(F.sum(F.when(F.col("place") == j, F.col("bytes"))), F.lit(0.0))
        return by.groupBy("node").agg(F.array(*(at(j) for j in range(n_shards))).alias("sums"))

    light = items.where(~is_heavy)
    placed = scratch.save(light.withColumn("bucket", dealt("grp", light.count())).groupBy("bucket").applyInPandas(place, "node long, grp long, piece int, bytes long, place int"), "buckets")
    nodes, level = scratch.save(sums(placed, "node"), "nodes0"), 0
    while (n := nodes.count()) > ITEMS:
        level += 1
        up = scratch.save(nodes.withColumn("up", dealt("node", n)).groupBy("up").applyInPandas(merge, "node long, up long, places array<int>, sums array<double>"), f"up{level}")
        placed = placed.join(up.select("node", "up", "places"), "node").select(F.col("up").alias("node"), "grp", "piece", "bytes", F.element_at("places", F.col("place") + 1).alias("place"))
        went = up.select("up", F.posexplode(F.arrays_zip("places", "sums")).alias("k", "x")).select("up", F.col("x.places").alias("place"), F.col("x.sums").alias("bytes"))
        nodes = scratch.save(sums(went, "up"), f"nodes{level}")
    left = sorted((r["node"], r["sums"]) for r in nodes.collect())  # ITEMS at most
    to, _ = combine([*([h[0]] for h in heavy), *(s for _, s in left)], n_shards)
    heavy_rows = spark.createDataFrame([(h[1], h[2], x[0]) for h, x in zip(heavy, to)], "grp long, piece int, heavy_shard int")
    last = spark.createDataFrame([(node, x) for (node, _), x in zip(left, to[len(heavy) :])], "node long, places array<int>")
    light = placed.join(F.broadcast(last), "node").select("grp", "piece", F.element_at("places", F.col("place") + 1).alias("light_shard"))
    of_heavy = base.join(F.broadcast(heavy_rows), ["grp", "piece"])
    of_light = base.join(F.broadcast(heavy_rows), ["grp", "piece"], "left_anti").join(light, ["grp", "piece"])
    placed_rows = of_heavy.withColumnRenamed("heavy_shard", "shard").unionByName(of_light.withColumnRenamed("light_shard", "shard"))
    blocks = max(1, -(-rows // (n_shards * BLOCK)))
    placed_rows = scratch.save(placed_rows.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(blocks)).cast("int")), "placed")
    counts = placed_rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "block").orderBy("uid")
    return placed_rows.withColumn("at", F.row_number().over(inside) - 1).join(offsets, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.col("grp").alias("group"), F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("at")).cast("long").alias("slot")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
