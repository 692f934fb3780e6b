"""Counts of edits against working out every cell, on long texts against what was done to them, and rates by hand."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake.functions import errors
from cuelake.plans import speech_queries


def brute_cost(a, b) -> tuple[int, int]:
    """(edits, insertions and deletions), the least such pair."""
    row = [(j, j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [(i, i)]
        for j, y in enumerate(b, 1):
            up, left, both = row[j], new[-1], row[j - 1]
            new.append(min((up[0] + 1, up[1] + 1), (left[0] + 1, left[1] + 1), (both[0] + (x != y), both[1])))
        row = new
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(st.text("abc", max_size=30), st.text("abc", max_size=30))
def test_counts_are_the_least(a, b):
    s, i, d = errors.edit_counts(list(a), list(b))
    assert (s + i + d, i + d) == brute_cost(a, b) and i - d == len(b) - len(a) and min(s, i, d) >= 0


def test_bands_double():
    r = random.Random(2)
    for _ in range(60):
        a = [r.randrange(6) for _ in range(r.randrange(150))]
        b = a[r.randrange(40) :] + [r.randrange(6) for _ in range(r.randrange(80))]
        r.shuffle(b) if r.random() < 0.3 else None
        s, i, d = errors.edit_counts(a, b)
        assert (s + i + d, i + d) == brute_cost(a, b)


def test_a_hundred_thousand_words():
    r = np.random.default_rng(3)
    a = [f"w{x}" for x in r.integers(0, 50_000, 100_000)]
    b = list(a)
    for k in range(0, 99_000, 1000):
        b[k] = "other"  # 99 substitutions
    del b[50_500:50_540]  # 40 deletions
    b[20_200:20_200] = ["new"] * 25  # 25 insertions
    start = time.time()
    assert errors.edit_counts(a, b) == (99, 25, 40) and time.time() - start < 60


def test_rates(spark):
    rows = [("x", "a b c d", "a x c"), ("x", "one", "one"), ("x", "", "more words"), ("y", None, None), ("y", "é 你", "é"), ("z", "", "")]
    d = spark.createDataFrame(rows, "who string, said string, heard string")
    counted = d.withColumn("counts", errors.word_counts(F.col("said"), F.col("heard")))
    by = {(r["said"], r["heard"]): tuple(r["counts"]) for r in counted.collect()}
    assert by["a b c d", "a x c"] == (4, 3, 1, 0, 1) and by["", "more words"] == (0, 2, 0, 2, 0) and by[None, None] == (0, 0, 0, 0, 0)
    rates = {r["who"]: r for r in errors.error_rates(counted, ["who"]).collect()}
    assert rates["x"]["pooled"] == pytest.approx(4 / 5) and rates["x"]["macro"] == pytest.approx((0.5 + 0) / 2) and rates["x"]["n"] == 3
    assert rates["y"]["pooled"] == rates["y"]["macro"] == 0.5 and rates["z"]["pooled"] is None is rates["z"]["macro"]
    chars = d.select(errors.character_counts(F.col("said"), F.col("heard")).alias("c")).collect()
    assert tuple(chars[0]["c"]) == (4, 3, 1, 0, 1) and tuple(chars[4]["c"]) == (2, 1, 0, 0, 1)


def poor(items: list) -> list:
    """What a poor transcript has of items."""
    return [y for k, x in enumerate(items) for y in ([] if k % 11 == 3 else [x, x] if k % 11 == 5 else [x[::-1]] if k % 11 == 8 else [x])]


def test_characters_with_many_edits_take_little_time():
    r = random.Random(4)
    texts = [["".join(r.choice("etaoinshr") for _ in range(r.randint(1, 10))) for _ in range(350)] for _ in range(60)]
    start = time.time()
    got = [errors.edit_counts(list("".join(t)), list("".join(poor(t)))) for t in texts]
    assert time.time() - start < 5
    a, b = "".join(texts[0]), "".join(poor(texts[0]))
    assert (sum(got[0]), got[0][1] + got[0][2]) == brute_cost(a, b)


@pytest.mark.parametrize("held, ways", [(1 << 26, 64), (0, 64), (400, 64), (1 << 26, 0), (0, 0)])
def test_all_ways_of_counting_agree(monkeypatch, held, ways):
    monkeypatch.setattr(errors, "HELD", held)
    monkeypatch.setattr(errors, "WAYS", ways)
    r = random.Random(6)
    for _ in range(150):
        a, b = ([r.randrange(4) for _ in range(r.randrange(40))] for _ in "ab")
        s, i, d = errors.edit_counts(a, b)
        assert (s + i + d, i + d) == brute_cost(a, b)


@pytest.mark.parametrize("few, side, items", [(1, 1 << 15, 1 << 20), (1, 60, 40), (16, 400, 500), (1, 1 << 15, 1)])
def test_pairs_side_by_side_agree_with_every_cell(monkeypatch, few, side, items):
    for name, value in (("FEW", few), ("SIDE", side), ("ITEMS", items)):
        monkeypatch.setattr(errors, name, value)
    r = random.Random(7)
    pairs = [tuple([f"w{r.randrange(k % 5 + 1)}" for _ in range(r.randrange(45))] for _ in "ab") for k in range(250)]
    pairs += [(a, a[k % 30 :] + a[: k % 30]) for k, (a, _) in enumerate(pairs[:60])] + [(a, poor(a)) for a, _ in pairs[:20]] + [(["x"] * 80, ["y"]), ([], []), ([1], [])]
    r.shuffle(pairs)
    got = errors._all_counts(iter(pairs))
    assert len(got) == len(pairs)
    for (a, b), (n, m, s, i, d) in zip(pairs, got):
        assert (n, m) == (len(a), len(b)) and (s + i + d, i + d) == brute_cost(a, b) and i - d == m - n and min(s, i, d) >= 0


def test_many_pairs_take_less_time_side_by_side():
    r = random.Random(8)
    texts = [[f"w{r.randrange(300)}" for _ in range(90)] for _ in range(6000)]
    pairs = [(t, poor(t)) for t in texts]
    pairs += [(["x"] * 1500, ["y"] * 20), (["x"] * 3000, list(range(3000)))]  # two that need far wider bands than the others
    start = time.process_time()
    one = [(len(a), len(b), *errors.edit_counts(a, b)) for a, b in pairs]
    alone, start = time.process_time() - start, time.process_time()
    assert errors._all_counts(iter(pairs)) == one and time.process_time() - start < alone / 1.5


def test_words_of_many_texts_take_little_time():
    r = random.Random(5)
    texts = [[f"w{r.randrange(300)}" for _ in range(90)] for _ in range(2000)]
    start = time.time()
    got = [errors.edit_counts(t, poor(t)) for t in texts]
    assert time.time() - start < 6
    for t, (s, i, d) in list(zip(texts, got))[:20]:
        assert (s + i + d, i + d) == brute_cost(t, poor(t))


def test_rates_of_texts_with_all_kinds_of_blanks(spark):
    d = spark.createDataFrame([("x", "a\x0bb c d\x1ce f", "a b c d\x1ce f"), ("x", "\t \n", None)], "who string, said string, heard string")
    counted = d.withColumn("counts", errors.word_counts(F.col("said"), F.col("heard")))
    words = d.select(F.size(F.regexp_extract_all("said", F.lit(r"\S+"), F.lit(0)))).collect()
    assert [r["counts"]["n_reference"] for r in counted.collect()] == [r[0] for r in words] == [3, 0]
    assert errors.error_rates(counted, ["who"]).collect()[0]["edits"] == 0


def test_texts_of_one_file_are_counted_in_many_tasks(spark, tmp_path):
    said = [(k // 400, k, "user", f"a b c d {k} f") for k in range(800)]  # two conversations
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    name, had = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(name, "false")  # so few rows would be put together
    try:
        got = speech_queries.word_errors(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).toPandas()
        rates = speech_queries.error_rates(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(name, had)
    assert len(got) == 800 and got["task"].value_counts().max() < 400
    assert set(zip(got["substitutions"], got["insertions"], got["deletions"])) == {(2, 0, 0)} and [tuple(r)[:4] for r in rates] == [("user", 800, 1600, 4800)]
