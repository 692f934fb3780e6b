"""Names for SQL: functions and table functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import align, segment
from . import itn


class Clauses:
    """clauses(text, total_ms): start_ms, end_ms, text of the clauses of a text without times."""

    def eval(self, text: str, total_ms: int) -> Iterator[tuple]:
        yield from segment.text_clauses(text, total_ms or 0)


class TranslatedRows:
    """translated_rows(text, start_ms, duration_ms): start_ms, end_ms, text of a translation cut at its signs."""

    def eval(self, text: str, start_ms: int, duration_ms: int) -> Iterator[tuple]:
        yield from segment.split_translation(text, start_ms or 0, duration_ms or 0)


class Reconciled:
    """reconciled(text, tokens): n, text, token of a text's tokens with what stands between them (token: null)."""

    def eval(self, text: str, tokens: list) -> Iterator[tuple]:
        items = align.reconcile(text or "", [(t, i, i + 1) for i, t in enumerate(tokens or [])])
        for n, (piece, a, b) in enumerate(items):
            yield n, piece, a if b > a else None


_SPAN = "start_ms bigint, end_ms bigint, text string"
TABLES = {"clauses": (Clauses, _SPAN), "translated_rows": (TranslatedRows, _SPAN), "reconciled": (Reconciled, "n int, text string, token int")}


def _batched(f, kind: str):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(f)

    return run


#: Name: function of one value in Arrow batches.
SCALARS = {
    "itn": (itn.normalize, "string"),
    "ends_sentence": (lambda t: t is not None and segment.ends_sentence(t), "boolean"),
    "fix_timestamps": (lambda v: None if v is None else align.fix_timestamps(list(v)), "array<int>"),
    "wrapped_lines": (lambda t: None if t is None else segment.split_oversize(t, 48), "array<string>"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes all of them known to the session; gives their names."""
    for name, (f, kind) in SCALARS.items():
        spark.udf.register(name, _batched(f, kind))
    for name, (f, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(f, returnType=schema))
    return [*SCALARS, *TABLES]
