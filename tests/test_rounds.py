"""Models that fail by a rule: who is asked how often, and what comes out."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import rounds


def noting(folder: str, answer):
    """A model that notes each input that it is asked for, in a file of its own."""
    def load():
        import uuid

        def model(rows: list) -> list:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                json.dump([list(r) if isinstance(r, tuple) else r for r in rows], f)
            return [answer(r) for r in rows]

        return model

    return load


def noted(folder) -> list:
    return sorted((r for f in folder.iterdir() for r in json.loads(f.read_text())), key=str)


def test_only_what_failed_is_asked_again(spark, tmp_path):
    """Input k fails k times."""
    d = spark.createDataFrame([(k, f"in{k}") for k in range(6)] * 2 + [(0, None)], "k int, x string").repartition(3)
    notes = tmp_path / "notes"
    notes.mkdir()
    model = noting(str(notes), lambda r: (f"{r[0]}@{r[1]:.1f}", r[0] is not None and int(r[0][2:]) > round(r[1] / 0.3)))
    job = rounds.Rounds(spark, f"file://{tmp_path}/rounds")
    out = rounds.ask_again(d, "x", model, job, tries=4, warmer=0.3, mark="!", batch=2)
    got = sorted((r["k"], r["x"] or "", r["text"], r["tries"]) for r in out.collect())
    want = [(k, f"in{k}", f"in{k}@{0.3 * min(k, 3):.1f}" + "!" * (k > 3), min(k, 3) + 1) for k in range(6)] * 2
    assert got == sorted([*want, (0, "", "None@0.0", 1)])
    asked = noted(notes)
    assert len(asked) == 2 * sum(min(k, 3) + 1 for k in range(6)) + 1
    out.collect()
    assert noted(notes) == asked  # rounds are written: reading the result asks nobody
    job.drop()
    assert not (tmp_path / "rounds").exists() or not list((tmp_path / "rounds").iterdir())


def test_nothing_to_ask(spark, tmp_path):
    job = rounds.Rounds(spark, f"file://{tmp_path}")
    empty = spark.createDataFrame([], "k int, x string")
    assert rounds.ask_again(empty, "x", lambda: lambda rows: [], job).columns == ["k", "x", "text", "tries"]
    assert rounds.in_order(spark.createDataFrame([], "rec_id int, chunk int, x string"), "x", lambda: lambda rows: [], job).count() == 0


def test_batches_fall_back_to_single_texts(spark, tmp_path):
    units = spark.createDataFrame([("a", i, f"t{i}") for i in range(7)] + [("b", 0, "bad"), ("b", 1, "u1"), ("b", 2, "none"), ("c", 5, "alone")], "rec_id string, idx int, text string").repartition(3)
    notes = tmp_path / "notes"
    notes.mkdir()

    def answer(texts):
        if len(texts) == 1:
            return "" if texts == ["none"] else texts[0].upper()
        return "no numbers here" if "bad" in texts else "\n".join(f"{i}. {t.upper()}" for i, t in enumerate(texts, 1))

    job = rounds.Rounds(spark, f"file://{tmp_path}/rounds")
    out = rounds.translated(units, ["rec_id"], "idx", "text", noting(str(notes), answer), T.numbered_translations, job, together=3)
    got = {(r["rec_id"], r["idx"]): r["translation"] for r in out.collect()}
    assert got == {**{("a", i): f"T{i}" for i in range(7)}, ("b", 0): "BAD", ("b", 1): "U1", ("b", 2): "none", ("c", 5): "ALONE"}
    assert noted(notes) == sorted([["t0", "t1", "t2"], ["t3", "t4", "t5"], ["t6"], ["bad", "u1", "none"], ["alone"], ["bad"], ["u1"], ["none"]], key=str)


@pytest.mark.parametrize("memory", [0, 1, 2])
def test_chunks_know_the_texts_before(spark, tmp_path, memory):
    chunks = spark.createDataFrame([("a", k, f"a{k}") for k in range(5)] + [("b", 0, "b0")], "rec_id string, chunk int, x string").repartition(3)
    model = lambda: lambda rows: [f"{x}({','.join(t.split('(')[0] for t in before)})" for x, before in rows]
    out = rounds.in_order(chunks, "x", model, rounds.Rounds(spark, f"file://{tmp_path}"), memory)
    got = {(r["rec_id"], r["chunk"]): r["text"] for r in out.collect()}
    want = {("a", k): f"a{k}({','.join(f'a{i}' for i in range(max(0, k - memory), k))})" for k in range(5)}
    assert got == want | {("b", 0): "b0()"}


def test_rounds_need_a_shared_folder(spark):
    class Bare:
        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        rounds.Rounds(Bare)
    assert rounds.Rounds(spark).root.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert spark.range(1).select(F.lit(1)).count() == 1
