"""Queries over small tables made here, against brute force: nothing of a row is left out."""

from __future__ import annotations

import random
import unicodedata
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from test_errors import brute_cost
from cuelake.plans import registry


@pytest.fixture
def run(spark, tmp_path):
    """The rows of a query over one table of the given rows."""

    def of(query: str, name: str, schema: str, rows: list[tuple]) -> list:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return registry.queries()[query](spark, str(tmp_path)).collect()

    return of


def test_clean_token_keeps_the_whole_text(run):
    texts = ["it's é 你好, 1½! " * 90, "x" * 199 + "-y", "", None]
    got = {r["doc_id"]: r["cleaned"] for r in run("clean_token", "documents", "doc_id long, text string", list(enumerate(texts)))}
    assert got == {i: t and "".join(c for c in t if unicodedata.category(c)[0] in "LN" or c == "'") for i, t in enumerate(texts)}


def test_character_errors_of_whole_texts(run):
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abé你𝄞ñ.") for _ in range(r.randint(1, 6))) for _ in range(n)) for n in (1, 11, 90)] + ["", None]
    got = run("character_errors", "conversations", "conv_id long, turn int, role string, text string", [(1, i, "a", t) for i, t in enumerate(texts)])
    edits = chars = 0
    for t in texts:
        words = (t or "").split()
        heard = "".join("" if k % 11 == 3 else w * 2 if k % 11 == 5 else w[::-1] if k % 11 == 8 else w for k, w in enumerate(words))
        edits, chars = edits + brute_cost("".join(words), heard)[0], chars + len("".join(words))
    assert [(x["rec_id"], x["edits"], x["chars"]) for x in got] == [(1, edits, chars)]


def test_top_count_reconstruct_keeps_the_counted_speakers(run):
    minute = lambda m: datetime(2024, 1, 1, m // 60, m % 60)
    r = random.Random(2)
    rows = [(i, minute(r.randrange(60)), r.randrange(12), r.choice([10.0, 60.5, 80.25, 99.0])) for i in range(150)] + [(150, minute(59), 3, None), (151, minute(90), 4, 60.5), (152, minute(91), 5, 99.0)]
    active: dict = {}
    for _, ts, user, value in rows:
        for frame in range(int(ts.replace(tzinfo=UTC).timestamp()) // 60, int(ts.replace(tzinfo=UTC).timestamp()) // 60 + 10):
            users = active.setdefault(frame, {})
            users[user] = max((v for v in (users.get(user), None if value is None else round(value * 1000)) if v is not None), default=None)
    counts = {f: round(sum(v is not None and v > 50_000 for v in users.values()) / 2) for f, users in active.items()}
    assert {0, 1, 3} <= set(counts.values())
    want = []
    for f, users in active.items():
        ordered = sorted(users, key=lambda u: (users[u] is None, -(users[u] or 0), u))
        want += [(f, u, users[u], k + 1) for k, u in enumerate(ordered[: counts[f]])]
    got = run("top_count_reconstruct", "events", "event_id long, ts timestamp_ntz, user_id int, value double", rows)
    assert sorted((x["frame"], x["user_id"], x["v"], x["place"]) for x in got) == sorted(want)


def test_merge_languages_drops_only_blanks(run):
    langs = ["fr", "en", "en", None, "en", "de", " ", "de", "", "fr"] + ["es", "it"] * 5
    got = run("merge_languages", "documents", "doc_id long, lang string", list(enumerate(langs)))
    assert {x["rec_id"]: x["languages"] for x in got} == {0: "fr,en,de,fr", 1: ",".join(["es", "it"] * 5)}


def fixed(s: str) -> str:
    """Repetitions fixed character by character: over 20 of one, then patterns of up to 20 that come 20 times or more."""
    out, i = "", 0
    while i < len(s):
        n = next((k for k in range(i, len(s)) if s[k] != s[i]), len(s)) - i
        out, i = out + (s[i] if n > 20 else s[i : i + n]), i + n
    s, out, i = out, "", 0
    while i < len(s):
        for k in range(1, 21):
            if len(s) - i >= max(40, 20 * k) and s[i : i + 20 * k] == s[i : i + k] * 20:
                out, end = out + s[i : i + k], i + 20 * k
                while s[end : end + k] == s[i : i + k]:
                    end += k
                i = end
                break
        else:
            out, i = out + s[i], i + 1
    return out


def test_repeated_patterns_are_fixed(spark, run):
    r = random.Random(3)
    texts = ["ab" * 30, "x" + "ab" * 19, "a" * 20, "a" * 20 + "b" * 19, "a" * 20 + "bc" * 10, "a" * 21 + "é", "你好𝄞\n" * 25 + "end", "abcdefghijklmnopqrst" * 21, "abcdefghijklmnopqrstu" * 25, "ab" * 50_000, ""]
    for _ in range(150):
        texts.append("".join("".join(r.choice("ab") for _ in range(r.randint(1, 22))) * r.choice([1, 1, 18, 19, 20, 21, 40]) for _ in range(r.randint(1, 5))))
    got = {x["doc_id"]: x["n_chars"] for x in run("collapse_char_runs", "documents", "doc_id long, text string", list(enumerate(texts)))}
    assert got == {i: len(fixed(t)) for i, t in enumerate(texts)}
    language, text = T.parse_transcript(F.col("raw"))
    raws = spark.createDataFrame([(i, f"language german<asr_text>{t}.") for i, t in enumerate(texts)], "i int, raw string").select("i", language.alias("l"), text.alias("t")).collect()
    assert {x["i"]: (x["l"], x["t"]) for x in raws} == {i: ("German", fixed(f"language german<asr_text>{t}.").removeprefix("language german<asr_text>")) for i, t in enumerate(texts)}


def test_split_oversize_of_every_row(run):
    def lines(t: str) -> list[str]:
        """The reference's way."""
        out, line = [], ""
        for w in t.split(" "):
            longer = f"{line} {w}" if line else w
            if len(longer) > 48 and line:
                out, line = [*out, line], w
            else:
                line = longer
        return [*out, line] if line else out or [t]

    r = random.Random(4)
    texts = [None, "", "a  b", "a\n\nb", " " * 60, "x" * 100, "w" * 60 + "  y", *("".join(r.choice(["ab", "c" * 9, " ", " ", "\n", "d" * 50]) for _ in range(60)) for _ in range(80))]
    want = {0: (None, None), 1: ("", []), 5: ("x" * 48 + " " + "x" * 48 + " " + "x" * 4, ["x" * 48, "x" * 48, "x" * 4])}
    for i, t in enumerate(texts):
        if i not in want:
            one = lines(t.replace("\n", " "))
            want[i] = (" ".join(one), one)
    got = {x["item_id"]: (x["text"], x["lines"]) for x in run("split_oversize", "benchmark", "item_id long, text string", list(enumerate(texts)))}
    assert got == want
