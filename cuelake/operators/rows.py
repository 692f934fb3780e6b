"""Rows made one by one, handed on as Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Outputs that a task hands on at a time.
BATCH = 5000


def batches_of(rows: Iterator[tuple], schema: StructType) -> Iterator[pa.RecordBatch]:
    kinds, held = to_arrow_schema(schema), []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], names=kinds.names)

    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield made()
            held = []
    if held:
        yield made()
