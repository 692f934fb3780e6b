from __future__ import annotations

import os

import pytest

import oracle
from cuelake.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), queries.queries()[name], queries.oracle_sql()[name], SF) == ""


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    scored = [(r["predicted"], labels[r["doc_id"]]) for r in queries.queries()["op5_quality_classifier"](spark, SF).where("held_out").collect() if r["doc_id"] in labels]
    assert sum(a == b for a, b in scored) >= 0.9 * len(scored)
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    found = [(r["lang_pred"], langs[r["doc_id"]]) for r in queries.queries()["op7_language_id"](spark, SF).where("held_out").collect()]
    assert sum(a == b for a, b in found) >= 0.95 * len(found)
