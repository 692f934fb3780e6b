from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.functions.itn import normalize
from cuelake.operators import align, segment
from cuelake.sources.subtitles import decode


def test_clauses_break_at_signs_silence_and_length():
    items = [(0, 500, "你好"), (500, 600, "。"), (600, 900, "a "), (3000, 3200, "b"), (3200, 9500, "c"), (9500, 9600, "3.14"), (9600, 9700, ".")]
    assert segment.clauses(items) == [(0, 600, "你好。"), (600, 900, "a"), (3000, 3200, "b"), (3200, 9500, "c"), (9500, 9700, "3.14.")]


def test_pack_and_merge():
    rows = [(0, 400, "好的。", "a"), (400, 800, "嗯。", "a"), (800, 3000, "我明白了，", "a"), (3000, 4000, "走吧。", "b")]
    assert segment.pack(rows) == [(0, 3000, "好的。嗯。我明白了，", "a"), (3000, 4000, "走吧。", "b")]
    assert segment.merge_short([(0, 300, "Hi.", ""), (300, 2000, "There you are.", "")]) == [(0, 2000, "Hi. There you are.", "")]


def test_units_close_at_sentences_and_speakers():
    rows = [(0, 2500, "Hello, I want to", "spk0"), (2500, 5000, "ask you something.", "spk0"), (5000, 8000, "Sure, go ahead.", "spk0")]
    assert [u[3] for u in segment.units(rows)] == ["Hello, I want to ask you something.", "Sure, go ahead."]
    assert len(segment.units([(0, 1, "[spk0] I was", ""), (1, 2, "[spk1] thinking.", "")])) == 2
    assert segment.units([(0, 2000, "a", ""), (4000, 5500, "b.", "")])[0][2] == 3500


def test_split_translation():
    got = segment.split_translation("你好，我是第一个。第二句在这里。", 2000, 10_000)
    assert [x[2] for x in got] == ["你好，我是第一个。", "第二句在这里。"] and got[0][0] == 2000 and got[-1][1] == 12_000
    assert len(segment.split_translation("好的，请说。", 0, 3000)) == 1
    assert segment.split_translation("", 0, 10) == []


@given(st.lists(st.integers(0, 60), max_size=40))
@settings(max_examples=60, deadline=None)
def test_fixed_timestamps_never_fall_and_keep_sorted_input(values):
    fixed = align.fix_timestamps(values)
    assert fixed == sorted(fixed) and len(fixed) == len(values)
    assert align.fix_timestamps(sorted(values)) == sorted(values)


def test_fix_timestamps_snaps():
    assert align.fix_timestamps([1, 2, 9, 3, 4]) == [1, 2, 2, 3, 4]


@given(st.text("ab,. '", max_size=30))
@settings(max_examples=60, deadline=None)
def test_reconcile_gives_the_text_again(text):
    tokens = [("".join(c for c in w if align.kept(c)), i, i + 1) for i, w in enumerate(text.split())]
    tokens = [t for t in tokens if t[0]]
    assert "".join(x[0] for x in align.reconcile(text, tokens)) == text


@pytest.mark.parametrize(("raw", "want"), [("三五百人", "300~500人"), ("八点三十分二十秒", "08:30:20"), ("二十三点五", "23.5"), ("一", "一"), ("好几百", "好几百"), ("他有三百五十六个", "他有356个"), ("", ""), (None, None)])
def test_numerals(raw, want):
    assert normalize(raw) == want


def test_decode():
    for name in ("utf-8", "utf-8-sig", "gb18030"):
        assert decode("你好，字幕".encode(name)) == "你好，字幕"


def test_split_oversize():
    r = random.Random(1)
    for _ in range(50):
        text = " ".join("x" * r.randint(1, 9) for _ in range(r.randint(1, 20)))
        assert " ".join(segment.split_oversize(text, 12)) == text
    assert segment.split_oversize("abcdef", 4) == ["abcd", "ef"]
