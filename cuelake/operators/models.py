"""Where models plug in: batch functions over Arrow batches, one model for each worker. No model comes with this package. ``rounds``
asks models again, in batches, and chunk after chunk."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type


class NoModel(RuntimeError):
    pass


def missing(*_):
    raise NoModel("no model is configured; pass a callable")


_loaded: dict[str, Callable] = {}


def loaded(name: str, load: Callable[[], Callable]) -> Callable:
    """The model of this name, loaded once in each worker process."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def apply_model(df: DataFrame, column: str, out: str, load: Callable[[], Callable[[list], list]] = lambda: missing, name: str | None = None, kind: pa.DataType | None = None, batch: int = 32) -> DataFrame:
    """``df`` with ``out``, what the model gives for ``column``, ``batch`` inputs at a time. ``load`` returns ``inputs -> outputs`` and runs once in each worker process for
    a ``name``; without one, once in each task. ``kind``: the outputs' type (string)."""
    kind = kind or pa.string()
    names, at = [*df.columns, out], df.columns.index(column)
    schema = df.withColumn(out, F.lit(None).cast(from_arrow_type(kind))).schema

    def run(batches):
        model = loaded(name, load) if name else load()
        for b in batches:
            inputs = b.column(at).to_pylist()
            outputs = [y for i in range(0, len(inputs), batch) for y in model(inputs[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(outputs, kind)], names=names)

    return df.mapInArrow(run, schema)


def identity():
    """A stand-in translator."""
    return lambda texts: list(texts)
