"""Subtitles end to end: the documented cases, and brute force over recordings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import segment
from cuelake.plans import adapters, registry
from cuelake.sources import subtitles

SF = "/root/testdata/sf0.001"


def characters(text: str, ms: int = 300, start: int = 0) -> list[tuple]:
    return [(start + i * ms, start + (i + 1) * ms, c) for i, c in enumerate(text)]


def lines(spark, items: list[tuple], turns: list[tuple] | None = None, **options) -> list[tuple]:
    rows = spark.createDataFrame([("r", i, *x) for i, x in enumerate(items)], "rec_id string, pos int, start_ms long, end_ms long, text string")
    of = spark.createDataFrame([("r", i, *x) for i, x in enumerate(turns)], "rec_id string, seq int, start_ms long, end_ms long, label string") if turns else None
    return [tuple(x)[2:] for x in segment.build_subtitles(rows, of, **options).orderBy("idx").collect()]


def test_lines_without_signs_are_cut_by_time(spark):
    text = "今天天气很好我们去公园散步然后吃饭" * 4
    got = lines(spark, characters(text[:66], 500))
    assert len(got) > 3 and all(b - a <= 6000 for a, b, _, _ in got) and "".join(t for *_, t, _ in got) == text[:66]


def test_lines_end_in_signs_and_have_speakers(spark):
    text = "你好。今天天气不错，我们出去走走吧，顺便买点东西。好的，马上来。"
    got = lines(spark, characters(text), [(0, 6000, "spk0"), (6000, 99_000, "spk1")])
    assert all(t[-1] in "。，" for *_, t, _ in got) and got[0][3] == "spk0" and got[-1][3] == "spk1"
    assert {s for *_, s in lines(spark, characters(text), [(0, 6000, "spk0"), (6000, 99_000, "spk1")], with_speaker=False)} == {""}


def test_short_sentences_are_joined(spark):
    got = lines(spark, characters("好的。嗯。我明白了，我们走吧。", 200))
    assert all(b - a >= 300 for a, b, _, _ in got)


def test_words_keep_their_spaces(spark):
    pieces = ["Hello", ". ", "Hello", ". ", "I", " ", "didn't", " ", "know", " ", "you", " ", "were", " ", "there", "."]
    text = " | ".join(x[2] for x in lines(spark, [(300 * i, 300 * i + 300, p) for i, p in enumerate(pieces)]))
    assert "Hello. Hello." in text and "didn't know you were there" in text and "  " not in text and not text.startswith(" ")
    assert "3个" in lines(spark, characters("第3个苹果，第2天又买了5个。"))[0][2]


def test_numerals_are_written_before_lines_are_measured(spark):
    got = lines(spark, characters("一共三百五十六个苹果。", 50))
    assert got == [(0, 600, "一共356个苹果。", "")]


@pytest.mark.parametrize(("rows", "want"), [
    ([(0, 200), (1000, 3000)], [(0, 600), (1000, 3000)]),  # room for the least
    ([(0, 200), (300, 2000)], [(0, 280), (300, 2000)]),  # up to 20 ms before the next
    ([(0, 0), (50, 2000)], [(0, 50), (50, 2000)]),  # hardly any room
    ([(0, 5000), (4000, 4700)], [(0, 3980), (4000, 4700)]),
    ([(700, 600)], [(700, 1300)]),
])
def test_timeline(rows, want):
    assert [x[:2] for x in segment.on_timeline([(a, b, "t", "") for a, b in rows])] == want


def test_text_without_times(spark):
    text = "The quick brown fox jumps over the lazy dog, and then it rests. Nobody saw it leave the yard that day! Where did it go, and why did it never come back home again?"
    rows = spark.createDataFrame([("r", text, 40_000), ("s", " ", 5000), ("t", None, 5000)], "rec_id string, text string, total_ms long")
    got = segment.build_subtitles_from_text(rows).orderBy("idx").collect()
    assert {r["rec_id"] for r in got} == {"r"} and len(got) >= 2 and all(r["end_ms"] - r["start_ms"] <= 6000 for r in got)
    assert " ".join(r["text"] for r in got).split() == text.split() and got[-1]["end_ms"] == 40_000
    turns = spark.createDataFrame([("r", 0, 0, 20_000, "a"), ("r", 1, 20_000, 40_000, "b")], "rec_id string, seq int, start_ms long, end_ms long, label string")
    assert [r["speaker"] for r in segment.build_subtitles_from_text(rows, turns).orderBy("idx").collect()][:: len(got) - 1 or 1][0] == "a"


def test_one_pass_gives_what_the_steps_give(spark):
    items = registry.text_queries._items(spark, SF)
    packed = segment.pack_lines(segment.split_into_clauses(items).withColumn("speaker", F.lit("")))

    def by(rows) -> dict:
        out: dict = {}
        for r in sorted(rows.collect(), key=lambda r: (r["rec_id"], r["idx"])):
            out.setdefault(r["rec_id"], []).append((r["start_ms"], r["end_ms"], r["text"], r["speaker"]))
        return out

    want = {k: segment.on_timeline(segment.merge_short(rows, most_chars=67)) for k, rows in by(packed).items()}
    assert by(segment.build_subtitles(items)) == want


def test_units_and_their_translations(spark):
    rows = [("r", 1, 0, 2500, "Hello, I want to", "spk0"), ("r", 2, 2500, 5000, "ask you something.", "spk0"), ("r", 3, 5000, 8000, "[spk1] Sure, go ahead.", ""), ("r", 4, 8000, 8000, "  ", ""), ("r", 5, 8000, 8010, "[spk1]Yes.", "")]
    d = spark.createDataFrame(rows, "rec_id string, idx int, start_ms long, end_ms long, text string, speaker string")
    units = segment.translation_units(d)
    got = [tuple(u) for u in units.orderBy("idx").collect()]
    assert [(u[5], u[6], u[7], u[9]) for u in got] == [("Hello, I want to ask you something.", "spk0", True, [1, 2]), ("Sure, go ahead.", "spk1", True, [3]), ("Yes.", "spk1", True, [5])]
    translated = units.withColumn("translation", F.when(F.col("idx") == 2, "好的，请说。你先说吧。").otherwise(F.when(F.col("idx") == 3, " ")))
    out = [tuple(x) for x in segment.translated_rows(translated, d).orderBy("idx").collect()]
    assert out == [
        ("r", 1, 0, 2500, "Hello, I want to", "spk0"), ("r", 2, 2500, 5000, "ask you something.", "spk0"), ("r", 3, 5000, 6636, "好的，请说。", "spk1"),
        ("r", 4, 6636, 8000, "你先说吧。", "spk1"), ("r", 5, 8000, 8050, "Yes.", "spk1"),
    ]
    assert segment.translated_rows(translated).count() == 2
    assert {x["speaker"] for x in segment.translated_rows(translated, d, with_speaker=False).collect()} == {""}


def test_every_source_row_or_its_translation_is_there(spark):
    rows, units, out = (registry.queries()[q](spark, SF).collect() for q in ("translation_backfill", "translation_units", "translated_segments"))
    assert len(out) >= len(units) and rows
    kept = [u for u in units if u["idx"] % 4 in (0, 2)]
    source = {(r["rec_id"], r["start_ms"]) for r in out}
    assert kept and all((u["rec_id"], u["start_ms"]) in source for u in kept)


def brute_pack(rows: list[tuple]) -> list[list[int]]:
    """Numbers of the clauses of each line, by the rules one after the other."""
    out: list[list[int]] = []
    line: list[int] = []
    for i, (start, end, text, who) in enumerate(rows):
        if line:
            first, chars, reach = rows[line[0]], sum(len(rows[k][2]) for k in line), max(rows[k][1] for k in line)
            if end - first[0] > 6000 or chars + len(text) > 48 or start - reach > 1200 or (who and who != first[3]):
                out, line = [*out, line], []
        line = [*line, i]
        if segment.ends_sentence(text):
            first, chars, reach = rows[line[0]], sum(len(rows[k][2]) for k in line), max(rows[k][1] for k in line)
            nxt = rows[i + 1] if i + 1 < len(rows) else None
            if nxt is None or reach - first[0] >= 1000 or nxt[3] != first[3] or nxt[1] - first[0] > 6000 or chars + len(nxt[2]) > 48 or nxt[0] - reach > 1200:
                out, line = [*out, line], []
    return [*out, line] if line else out


def test_pack_is_brute_force():
    r = random.Random(3)
    for _ in range(300):
        at, rows = 0, []
        for _ in range(r.randint(0, 25)):
            at += r.choice([0, 0, 0, 300, 2000])
            rows.append((at, at + r.choice([100, 400, 900, 3000]), r.choice(["Hi.", "well, then", "so", "yes!", "a" * 30]), r.choice(["", "a", "a", "b"])))
            at = rows[-1][1]
        got = segment.pack(rows, written=lambda t: t)
        want = [(rows[k[0]][0], max(rows[i][1] for i in k), segment.join_pieces([rows[i][2] for i in k]), rows[k[0]][3]) for k in brute_pack(rows)]
        assert got == want


def test_numbered_replies(spark):
    cases = [
        ("1. 你好\n2. 世界\n3. 再见", 3, ["你好", "世界", "再见"]), ("1. 你好\n2. 世界", 3, None), ("1. 第一行\n续写内容\n2. 第二行", 2, ["第一行续写内容", "第二行"]),
        ("好的，这是译文", 1, ["好的，这是译文"]), ("2) b\n\n 第1条：a", 2, ["a", "b"]), ("3. c", 2, None), ("", 1, None), (None, 1, None), ("1. a", 0, None), ("1. a", None, None),
        ("1. one\n7. stray\n2. two", 2, ["one 7. stray", "two"]), ("0. before\n1. one\r\n99999999999. far", 1, ["one 99999999999. far"]), ("１、 Zahl\x85２．zwei", 2, ["Zahl", "zwei"]),
        ("1.\n2. b", 2, None), ("1.\nlate\n2. b\n1. more", 2, ["late more", "b"]), ("plain\ntext", 1, ["plain text"]),
    ]
    got = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, reply string, n int").select("i", T.numbered_translations(F.col("reply"), F.col("n")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in got} == {i: c[2] for i, c in enumerate(cases)}


def test_cjk_tokens_prompts_and_languages(spark):
    d = spark.createDataFrame([("你好world's, 3D-世界", "zh"), ("日本 go", "Japanese"), ("", None)], "text string, lang string")
    got = d.select(T.mixed_tokens(F.col("text")).alias("m"), T.tokens_of(F.col("text"), F.col("lang")).alias("t"), T.split_by_signs(F.col("text")).alias("s")).collect()
    assert got[0]["m"] == ["你", "好", "world's", "3D", "世", "界"] and got[0]["t"] == ["你", "好", "world's", "3D", "世", "界"] and got[0]["s"] == ["你好world's,", "3D-世界"]
    assert got[1]["t"] == list("日本 go") and got[2]["m"] == got[2]["t"] == got[2]["s"] == []
    system, user = T.translation_prompt(F.array(F.lit("A"), F.lit("B"), F.lit("C")), "规则\n{text}", "共 {count} 段")
    one = spark.range(1).select(system.alias("s"), user.alias("u")).first()
    assert one["u"].startswith("1. A") and "3. C" in one["u"] and "3 段" in one["s"]
    assert spark.range(1).select(T.validated_language(F.lit(" chinese"))).first()[0] == "Chinese"
    with pytest.raises(Exception, match="unsupported language"):
        spark.range(1).select(T.validated_language(F.lit("Klingon"))).collect()


def test_files(spark, tmp_path):
    srt = "1\n00:00:06,720 --> 00:00:08,480\n[spk1] 我觉得\n可以。\n\n2\n00:00:08,500 --> 00:00:09,900\n[spk0] 好。\n\n3\n00:00:09,920 --> 00:00:09,920\n[spk0] 走吧。\n"
    for name, raw in (("a", srt.encode()), ("b", srt.encode("gb18030")), ("c", srt.replace("[spk0] ", "").replace("[spk1] ", "").encode())):
        (tmp_path / f"{name}.srt").write_bytes(raw)
    files = subtitles.read_files(spark, str(tmp_path)).withColumnRenamed("path", "rec_id")
    rows = [tuple(x) for x in subtitles.with_flag(subtitles.parse(files)).orderBy("rec_id", "idx").collect()]
    assert [x[5] for x in rows] == ["spk1", "spk0", "spk0"] * 2 + [""] * 3 and [x[6] for x in rows] == [True] * 6 + [False] * 3
    assert rows[0][2:5] == (6720, 8480, "我觉得 可以。") and rows[2][2:4] == (9920, 9970)


def test_adapters_lay_utterances_end_to_end(spark):
    by: dict = {}
    for u in sorted(adapters.utterances(spark, SF).collect(), key=lambda u: (u["rec_id"], u["pos"])):
        assert u["start_ms"] == by.get(u["rec_id"], 0)
        by[u["rec_id"]] = u["end_ms"]


def test_texts_are_sent_once(spark, monkeypatch):
    from cuelake.operators import rows as made

    monkeypatch.setattr(made, "BATCH", 2)
    texts = [(1, "One two, three. " * 40, 90_000), (1, "Later words. And more", 95_000), (2, "", 10), (2, None, 5), (3, "x", 400)]
    d = spark.createDataFrame(texts, "rec_id int, text string, total_ms long")
    seen = {}
    for rec, text, total in sorted(texts, key=lambda t: (t[0], t[2])):
        seen.setdefault(rec, []).extend((*c, "") for c in segment.text_clauses(text, total))
    want = {(rec, k): line for rec, c in seen.items() for k, (_, line) in enumerate(segment.finish_from(c), 1)}
    lines = segment.build_subtitles_from_text(d)
    assert {(r["rec_id"], r["idx"]): (r["start_ms"], r["end_ms"], r["text"], r["speaker"]) for r in lines.collect()} == want
    assert "whole" not in lines._jdf.queryExecution().analyzed().toString()
