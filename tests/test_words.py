"""Learned word splitting against counting and trying all cuts."""

from __future__ import annotations

import itertools
import random

import pytest

from cuelake.operators import words

TEXTS = ["학교에서 학교는 학교를 공부는 공부를", "공부에서 학교에서", None, "", "a ab abc  abd", "東京都に住む 東京で 東京都"]


def counts(strings) -> dict:
    out: dict = {}
    for s, n in strings:
        out[s] = out.get(s, 0) + n
    return out


def cohesion(c: dict, s: str) -> float:
    return round((c[s] / c[s[0]]) ** (1 / (len(s) - 1)), 12) if len(s) > 1 else 0.0


def test_left_parts(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS * 2], "text string").repartition(3)
    tokens = words.distinct_tokens(d)
    own = counts((w, 1) for t in TEXTS * 2 for w in (t or "").split())
    assert {r["token"]: r["n"] for r in tokens.collect()} == own
    c = counts((w[:k], n) for w, n in own.items() for k in range(1, min(len(w), 4) + 1))
    scores = words.prefix_scores(tokens, 4)
    assert {r["string"]: (r["n"], pytest.approx(r["score"])) for r in scores.collect()} == {s: (n, cohesion(c, s)) for s, n in c.items()}
    got = {r["token"]: (r["left"], r["right"]) for r in words.left_parts(tokens, scores, 4).collect()}
    for w in own:
        _, k = max((cohesion(c, w[:k]), k) for k in range(1, min(len(w), 4) + 1))
        assert got[w] == (w[:k], w[k:])
    assert got["학교는"] == ("학교", "는") and set(got) == set(own)


def test_pieces_are_the_best_of_all_cuts():
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 7)
        edges = [(i, k, r.choice([0.0, 0.25, 0.5, 1.0])) for i in range(n) for k in range(1, n - i + 1) if k == 1 or r.random() < 0.7]
        score = {(i, k): s for i, k, s in edges}
        ways = []
        for cuts in itertools.product([0, 1], repeat=n - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [n]
            pieces = [(a, b - a) for a, b in zip([0, *ends], ends)]
            if all(p in score for p in pieces):
                ways.append((round(sum(score[p] * p[1] for p in pieces), 9), -len(pieces), tuple(k for _, k in pieces)))
        got = words.best_pieces(n, edges)
        assert (round(sum(score[p] * p[1] for p in got), 9), -len(got), tuple(k for _, k in got)) == max(ways)


def test_lattice_over_texts(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string").repartition(3)
    tokens = words.distinct_tokens(d)
    own = counts((w, 1) for t in TEXTS for w in (t or "").split())
    c = counts((w[i : i + k], n) for w, n in own.items() for i in range(len(w)) for k in range(1, min(4, len(w) - i) + 1))
    scores = words.substring_scores(tokens, 4)
    assert {r["string"]: r["n"] for r in scores.collect()} == c
    splits = words.lattice(tokens, scores, 4)
    want = {w: [w[a : a + n] for a, n in words.best_pieces(len(w), [(i, k, cohesion(c, w[i : i + k])) for i in range(len(w)) for k in range(1, min(4, len(w) - i) + 1)])] for w in own}
    assert {r["token"]: r["pieces"] for r in splits.collect()} == want
    got = {r["id"]: r["tokens"] for r in words.split_texts(d, "id", splits).collect()}
    assert got == {i: [p for w in t.split() for p in want[w]] for i, t in enumerate(TEXTS) if t}


def test_single_characters_need_no_scores(spark):
    d = spark.createDataFrame([("ab abc a b",), ("bc abc 東京 東",)], "text string")
    tokens = words.distinct_tokens(d)
    scores = words.substring_scores(tokens, 3)
    whole = {r["token"]: r["pieces"] for r in words.lattice(tokens, scores, 3).collect()}
    longer = {r["token"]: r["pieces"] for r in words.lattice(tokens, scores.where("length > 1"), 3).collect()}
    assert whole == longer and set(whole) == {"ab", "abc", "a", "b", "bc", "東京", "東"} and all("".join(p) == t for t, p in whole.items())
