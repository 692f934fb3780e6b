"""Merging rounds of packing go on to one task, however many bins are left."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from cuelake.llm import packing


def test_one_small_bin_is_left_at_most(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_ITEMS", 10, raising=False)  # what once ended the rounds
    r = random.Random(1)
    sizes = [r.randint(1, 12) for _ in range(20)] + [r.choice([33, 34, 35]) for _ in range(600)]
    parts = [i // 2 if i < 20 else 10 + i % 10 for i in range(620)]  # small ones apart from large ones

    def one_word_a_token(docs, capacity, end_id, vocabulary):
        return docs.select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.col("n").alias("length"), F.lit(0).cast("long").alias("ids_crc32"))

    monkeypatch.setattr(packing, "pieces", one_word_a_token)
    docs = spark.createDataFrame(list(zip(range(620), sizes, parts)), "doc_id long, n long, part int").repartitionById(20, "part")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = packing.pack(docs, capacity=64, vocabulary="none").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(x["doc_id"] for x in got) == list(range(len(sizes)))
    fill: Counter = Counter()
    for x in sorted(got, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == fill[x["sequence_id"]]
        fill[x["sequence_id"]] += x["length"]
    assert max(fill.values()) <= 64 and sum(f <= 32 for f in fill.values()) <= 1
    assert len(fill) == 600
