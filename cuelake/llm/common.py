"""What the corpus operators share: reading tables, written intermediate tables, safe column names."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of all contracts: runs of anything but space and the five ASCII control blanks.
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, so that one machine is all there is, a temporary folder takes its place.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='cuelake-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Bytes of the batches in which rows go to Python: a task holds one on either side, and the values that it makes of it.
BATCH_BYTES, _BATCHES = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as rows, in a session that hasn't chosen a bound of its own: rows here are whole texts."""
    if spark.conf.get(_BATCHES, "64m").lower() in ("64m", "64mb", "67108864", "67108864b"):
        spark.conf.set(_BATCHES, BATCH_BYTES)


class Scratch:
    """Written tables of one run in the shared folder. They cut lineage: a lost executor costs only a
    reread. ``drop`` removes one early; the rest go when the driver ends, as results may be read late."""

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        if self.spark.sparkContext._jsc is None:  # the session is over; then its folder is the cluster's to clean
            return
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(conf).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column begins with it, whatever the case."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name += "_"
    return name


def scalar(df: DataFrame):
    """The only row of an aggregate."""
    return df.first()


def words(text) -> F.Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text column; null: empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


_cache: list = ["", lambda: None]


def only_cache(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """Called where an operator's task begins: a worker process is used by many operators in turn, and keeps the cache of the one at work only."""
    if _cache[0] != name:
        _cache[1]()
        _cache[:] = [name, clear]


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
