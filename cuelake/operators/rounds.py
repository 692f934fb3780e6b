"""Models asked in rounds over a table: again for what failed, in batches and one by one, and chunk after chunk.

Each round asks about the rows that are left, all at once, and is written to the shared folder before the next begins. A lost executor costs the tasks that it
had in the round at work; what earlier rounds have got is read, and no model is asked twice for it. The number of rounds has a bound that doesn't hang on the rows, but for ``in_order``, which
has one for each place of a recording's chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

#: What a model returns: inputs of a batch -> outputs, one each.
Model = Callable[[list], list]


class Rounds:
    """Written tables of the rounds of one job, in the folder of ``spark.checkpoint.dir`` (or ``folder``)."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        where = folder or spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        self.spark, self.root, self.n = spark, f"{where.rstrip('/')}/rounds-{uuid.uuid4().hex[:12]}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(path := f"{self.root}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Removes all of them; what was made of them can't be read afterwards."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def asked(df: DataFrame, inputs: list[str], out: str, kind: str, load: Callable[[], Model], batch: int = 32) -> DataFrame:
    """``df`` with ``out`` of type ``kind``: what the model gives for the values of ``inputs`` (a tuple of them for each row, or the value if it is one)."""
    found = StructType.fromDDL(f"x {kind}").fields[0].dataType
    arrow, at, names = to_arrow_type(found), [df.columns.index(c) for c in inputs], [*df.columns, out]

    def run(batches):
        model = load()
        for b in batches:
            columns = [b.column(i).to_pylist() for i in at]
            rows = list(zip(*columns)) if len(columns) > 1 else columns[0]
            outputs = [y for i in range(0, len(rows), batch) for y in model(rows[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(outputs, arrow)], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, found)]))


def ask_again(df: DataFrame, column: str, load: Callable[[], Model], rounds: Rounds, tries: int = 4, warmer: float = 0.3, mark: str = " [broken off]", batch: int = 32) -> DataFrame:
    """``df`` with ``text`` and ``tries`` (how often the model was asked). The model is given (input, temperature) and gives (text, whether it was broken off); what was is asked again
    in the next round, ``warmer``. A text that the last try broke off ends in ``mark``."""
    left, done = df.withColumn("tries", F.lit(0)), None
    for k in range(tries):
        warm = left.withColumn("tries", F.col("tries") + 1).withColumn("temperature", F.lit(k * warmer))
        found = rounds.save(asked(warm, [column, "temperature"], "answer", "struct<text: string, broken: boolean>", lambda: _pairs(load()), batch).drop("temperature"))
        last = k == tries - 1
        text = F.when(F.col("answer.broken"), F.concat("answer.text", F.lit(mark))).otherwise(F.col("answer.text"))
        settled = (found if last else found.where("not answer.broken")).withColumn("text", text).drop("answer")
        done = settled if done is None else done.unionByName(settled)
        left = found.where("answer.broken").drop("answer")
        if last or not left.take(1):
            break
    return done.select(*df.columns, "text", "tries")


def _pairs(model: Model) -> Model:
    return lambda rows: [{"text": text, "broken": broken} for text, broken in model(rows)]


def translated(units: DataFrame, keys: list[str], order: str, column: str, load: Callable[[], Model], parse: Callable, rounds: Rounds, together: int = 1, batch: int = 32) -> DataFrame:
    """``units`` with ``translation``: what the model says, or the text itself if it says nothing.

    Units of the same ``keys`` are asked for ``together`` at a time, by their ``order``; ``parse(reply, number)`` is a column of the reply's parts, null if it can't be taken apart. In
    a second round the units of such replies are asked for one by one. The model is given a list of texts for each request and gives a reply each."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    numbered = units.withColumn("__group", F.floor(place / together)).withColumn("__at", place % together)
    one = F.struct("__at", column)
    groups = numbered.groupBy(*keys, "__group").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x[column]).alias("texts"))
    replies = rounds.save(asked(groups, ["texts"], "reply", "string", load, batch).withColumn("parts", F.when(F.size("texts") > 1, parse(F.col("reply"), F.size("texts"))).otherwise(F.array("reply"))))
    first = numbered.join(replies.select(*keys, "__group", "parts"), [*keys, "__group"], "left").withColumn("__said", F.get("parts", F.col("__at")))
    first = rounds.save(first.withColumn("__again", F.col("parts").isNull()).drop("parts", "__group", "__at"))
    again = first.where("__again").withColumn("__texts", F.array(column))
    again = rounds.save(asked(again, ["__texts"], "__reply", "string", load, batch).withColumn("__said", F.col("__reply")).drop("__texts", "__reply"))
    both = first.where("not __again").unionByName(again)
    return both.withColumn("translation", F.coalesce(F.nullif(F.trim("__said"), F.lit("")), F.col(column))).select(*units.columns, "translation")


def in_order(chunks: DataFrame, column: str, load: Callable[[], Model], rounds: Rounds, memory: int = 2, batch: int = 32) -> DataFrame:
    """rec_id, chunk, text of chunks (rec_id, chunk from 0, ``column``): the model is given (input, texts of up to ``memory`` chunks before) and gives a text. Each round asks for one
    chunk of every recording that has so many."""
    chunks = chunks.select("rec_id", "chunk", column)
    most = chunks.agg(F.max("chunk")).first()[0]
    done, before = None, chunks.select("rec_id").distinct().withColumn("texts", F.array().cast("array<string>"))
    for k in range(-1 if most is None else int(most) + 1):
        found = asked(chunks.where(F.col("chunk") == k).join(before, "rec_id", "left"), [column, "texts"], "text", "string", load, batch)
        found = rounds.save(found)
        done = found if done is None else done.unionByName(found)
        kept = F.concat("texts", F.array("text"))
        before = found.select("rec_id", F.slice(kept, F.greatest(F.size(kept) - memory + 1, F.lit(1)), memory).alias("texts") if memory else F.array().cast("array<string>").alias("texts"))
    if done is None:
        return chunks.select("rec_id", "chunk", F.lit(None).cast("string").alias("text"))
    return done.select("rec_id", "chunk", "text")
