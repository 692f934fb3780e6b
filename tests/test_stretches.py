"""Folds in stretches give the rows of one fold over the whole recording, wherever it is cut."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import intervals, segment

LINE = "rec_id string, idx int, start_ms long, end_ms long, text string, speaker string"


def items(seed: int) -> list[tuple]:
    """Words with and without signs, silences, items that reach far over others, recordings without a single sign, short and empty ones."""
    r, out = random.Random(seed), []
    for k in range(40):
        at, words = 0, [["one ", "two, ", "three. ", "wait", "", "好。", "x"], ["la ", "lo "], ["a" * 30 + " ", "b, ", "c. "]][k % 3]
        for pos in range(r.choice([0, 1, 3, 40, 300])):
            at += r.choice([0, 0, 100, 400, 1201, 2500] if k % 4 else [0, 100])
            out.append((f"r{k}", pos, at, at + r.choice([-50, 50, 300, 900, 1500] + [9000] * (k % 5 == 0)), r.choice(words)))
    return out


def rows(seed: int) -> list[tuple]:
    r, out = random.Random(seed), []
    for k in range(40):
        at = 0
        for idx in range(1, r.choice([1, 2, 5, 60, 200]) + 1):
            at += r.choice([0, 0, 300, 2000])
            end = at + r.choice([100, 400, 900, 1100, 3000])
            out.append((f"r{k}", idx, at, end, r.choice(["Hi.", "well, then", "so", "yes!", "a" * 30, "[spk1] tagged", "[spk2] other.", "x" * (k % 3)]), r.choice(["", "a", "b"] if k % 2 else ["a"])))
            at = end if r.random() < 0.8 else at
    return out


def whole(rows_: list[tuple], run) -> list[tuple]:
    out = []
    for rec in sorted({x[0] for x in rows_}):
        out += [(rec, i, *y) for i, y in enumerate(run([x[2:] for x in rows_ if x[0] == rec]), 1)]
    return sorted(out)


def got(df) -> list[tuple]:
    return sorted(tuple(x) for x in df.collect())


@pytest.mark.parametrize("stretch_ms", [1, 700, 5000, 10**9])
def test_items(spark, monkeypatch, stretch_ms):
    monkeypatch.setattr(segment, "STRETCH_MS", stretch_ms)
    own = items(stretch_ms)
    d = spark.createDataFrame(own, "rec_id string, pos long, start_ms long, end_ms long, text string").repartition(5)
    ordered = sorted(own, key=lambda x: (x[2], x[1]))
    assert got(segment.split_into_clauses(d)) == whole([(x[0], *x[1:]) for x in ordered], segment.clauses)
    lines = whole(ordered, lambda x: [y for _, y in segment.lines_from(x)])
    assert got(segment.build_subtitles(d)) == lines
    plain = whole(ordered, lambda x: segment.on_timeline(segment.merge_short(segment.pack([(*c, "") for c in segment.clauses(x)]), most_chars=67)))
    assert lines == plain


@pytest.mark.parametrize("stretch", [1, 3, 20, 10**6])
def test_numbered_rows(spark, monkeypatch, stretch):
    monkeypatch.setattr(segment, "STRETCH", stretch)
    own = rows(stretch)
    d = spark.createDataFrame(own, LINE).repartition(5)
    assert got(segment.pack_lines(d)) == whole(own, segment.pack)
    assert got(segment.merge_short_lines(d)) == whole(own, segment.merge_short)
    assert got(segment._finished(d, True)) == whole(own, lambda x: [y for _, y in segment.finish_from(x)])
    units = [(x[0], *(tuple(v) if isinstance(v, list) else v for v in x[1:-1])) for x in segment.translation_units(d).collect()]
    assert sorted(units) == sorted((*u[:-1], tuple(u[-1])) for u in whole(own, segment.units))


def test_long_recordings_are_dealt(spark, monkeypatch):
    """Of a recording of 20,000 items, few are left for the second pass."""
    monkeypatch.setattr(segment, "STRETCH_MS", 60_000)
    r = random.Random(2)
    own = [("x", i, 400 * i, 400 * i + 350, r.choice(["word ", "more ", "sign, ", "end. "])) for i in range(20_000)]
    d = spark.createDataFrame(own, "rec_id string, pos long, start_ms long, end_ms long, text string").repartition(5)
    out = segment.build_subtitles(d)
    assert got(out) == whole(own, lambda x: [y for _, y in segment.lines_from(x)])
    cut = [segment.lines_certain([x[2:] for x in own[a : a + 150]], None) for a in range(0, 20_000, 150)]
    assert cut.count(None) == 0 and sum(cut) < 50 * len(cut)


def test_labels_of_clauses(spark):
    """Against counting each clause's shares one by one."""
    r = random.Random(4)
    turns = [(k % 3, n, s := r.randrange(3_000_000), s + r.choice([0, 500, 40_000, 1_500_000]), f"s{r.randrange(4)}") for n, k in enumerate(range(120))]
    clauses = [(r.randrange(4), n, s := r.randrange(3_000_000), s + r.choice([0, -5, 300, 60_000, 900_000]), "t") for n in range(200)]
    t = spark.createDataFrame(turns, "rec_id int, seq long, start_ms long, end_ms long, label string")
    c = spark.createDataFrame(clauses, "rec_id int, idx int, start_ms long, end_ms long, text string").repartition(3)
    found = {(x["rec_id"], x["idx"]): x for x in intervals.dominant_speaker(c, t, ["rec_id", "idx"]).collect()}
    assert len(found) == len(clauses)
    for rec, idx, s, e, _ in clauses:
        own = [x for x in turns if x[0] == rec]
        if e > s:
            shares: dict = {}
            for _, seq, a, b, label in own:
                if max(a, s) < min(b, e):
                    ms, low = shares.get(label, (0, seq))
                    shares[label] = ms + min(b, e) - max(a, s), min(low, seq)
            want = min(((-ms, low, label) for label, (ms, low) in shares.items()), default=(None, None, None))
            want = (want[2], None if want[0] is None else -want[0])
        else:
            at = min(((a, seq, label) for _, seq, a, b, label in own if a <= s < b), default=None)
            want = (at[2], 0) if at else (None, None)
        x = found[rec, idx]
        assert (x["label"], x["overlap_ms"]) == want and (x["start_ms"], x["end_ms"], x["text"]) == (s, e, "t")
