"""The token index against reading on from each start, and linkage in little memory against working all distances out anew."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.operators import align, cluster


def slow(text: str, token: str, start: int):
    """Every start in turn, every character in turn."""
    for first in range(start, len(text)):
        i, at = 0, first
        while at < len(text) and i < len(token):
            if text[at] == token[i]:
                i += 1
            elif i == 0 or align.kept(text[at]):
                break
            at += 1
        if token and i == len(token):
            return first, at
    return None


@settings(max_examples=500, deadline=None)
@given(st.text("ab-' .é你", max_size=40), st.lists(st.text("ab-'é你", max_size=5), max_size=12))
def test_tokens_are_found_where_reading_on_finds_them(text, tokens):
    places, at = align.Places(text), 0
    for t in tokens:
        want = slow(text, t, at)
        assert places.find(t, at) == want == align.locate(text, t, at)
        at = want[1] if want else at


def test_a_million_characters():
    """Tokens that are there, that are not, and that nearly are."""
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghij", k=r.randint(1, 9))) for _ in range(190_000)]
    text = " ".join(w if r.random() < 0.9 else f"{w[:1]}-{w[1:]}," for w in words)
    asked = [(w if r.random() < 0.7 else w + "q" if r.random() < 0.5 else w[:-1] + "jjaj", 10 * i, 10 * i + 10) for i, w in enumerate(words)]
    assert len(text) > 1_000_000
    start = time.time()
    out = align.reconcile(text, asked)
    assert time.time() - start < 60
    absent = {t for t, *_ in asked if t.endswith("q")}
    assert "".join(x for x, a, b in out if x not in absent and (x in text)).count("") > 1_000_000 // 2 and len(absent) > 10_000


def test_reconciled_items_hold_the_text():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choices("ab c,.'-", k=r.randrange(40)))
        tokens = ["".join(c for c in w if align.kept(c)) for w in text.split()]
        items = [(t, i, i + 1) for i, t in enumerate(tokens) if t]
        assert "".join(x for x, *_ in align.reconcile(text, items)) == text


def brute_linkage(x: np.ndarray) -> list[tuple]:
    """(distance, first members) of all merges; of equal pairs that with the lowest numbers."""
    groups, out = {i: [i] for i in range(len(x))}, []
    while len(groups) > 1:
        centers = {i: sum(x[k] for k in g) / len(g) for i, g in groups.items()}
        d, i, j = min((float(((centers[i] - centers[j]) ** 2).sum()), i, j) for i in groups for j in groups if i < j)
        out.append((d**0.5, i, j))
        groups[i] += groups.pop(j)
    return out


def test_linkage_with_ties_is_brute_force():
    for seed in range(12):
        r = np.random.default_rng(seed)
        x = r.integers(0, 4, (30, 2)).astype(float) if seed % 2 else r.normal(size=(30, 3))
        merges, d = cluster.linkage(x)
        want = brute_linkage(x)
        assert [tuple(m[:2]) for m in merges.tolist()] == [w[1:] for w in want] and np.allclose(d, [w[0] for w in want])


def test_linkage_holds_no_matrix():
    x = np.random.default_rng(1).normal(size=(4000, 16))
    tracemalloc.start()
    merges, _ = cluster.linkage(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000 and merges[-1, 2] == 4000  # a matrix takes 128 MB


def test_linkage_of_few():
    assert cluster.linkage(np.zeros((0, 3)))[0].shape == (0, 3) and cluster.linkage(np.ones((1, 3)))[0].shape == (0, 3)
    assert cluster.linkage(np.ones((3, 2)))[0].tolist() == [[0, 1, 2], [0, 2, 3]]
