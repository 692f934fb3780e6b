"""Queries over recordings in blocks: the embeddings laid end to end, 200 vectors a recording, 64 samples a block, at 800 samples a second. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import blocks
from .adapters import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Vectors of a recording, samples of a block, rate.
VECTORS, SIZE, RATE = 200, 64, 800


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _blocks(spark, d):
    place = F.row_number().over(Window.partitionBy("rec_id").orderBy("vec_id")) - 1
    return table(spark, d, "embeddings").where("embedding is not null").select(F.expr(f"vec_id div {VECTORS}").alias("rec_id"), "vec_id", F.col("embedding").alias("samples")).withColumn("block", place).select("rec_id", "block", "samples")


_SAMPLES = f"""s AS MATERIALIZED (SELECT rec_id, {SIZE} * b + k - 1 AS i, x FROM (SELECT vec_id // {VECTORS} AS rec_id, row_number() OVER (PARTITION BY vec_id // {VECTORS} ORDER BY vec_id) - 1 AS b, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE embedding IS NOT NULL)),
  total AS MATERIALIZED (SELECT rec_id, count(*) AS n FROM s GROUP BY rec_id)"""

# chunks of 3 s, cut within a second of that, by windows of a tenth
_QUIET = f"""WITH RECURSIVE {_SAMPLES},
  q AS (SELECT rec_id, i, CAST(round_even(abs(CAST(x AS DOUBLE)) * 16777216, 0) AS BIGINT) AS q FROM s),
  w AS MATERIALIZED (SELECT rec_id, i, level * 1048576 + i AS key, least % 1048576 AS cut FROM (SELECT rec_id, i, sum(q) OVER v AS level, min(q * 1048576 + i) OVER v AS least, count(*) OVER v AS c FROM q WINDOW v AS (PARTITION BY rec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {RATE // 10 - 1} FOLLOWING)) WHERE c = {RATE // 10}),
  chain AS (SELECT rec_id, 0 AS chunk, CAST(0 AS BIGINT) AS start, n FROM total
    UNION ALL SELECT c.rec_id, c.chunk + 1, greatest(arg_min(w.cut, w.key), c.start + 1), c.n FROM chain c JOIN w ON w.rec_id = c.rec_id AND w.i BETWEEN c.start + {2 * RATE} AND least(c.n, c.start + {4 * RATE}) - {RATE // 10} WHERE c.n - c.start > {3 * RATE} GROUP BY c.rec_id, c.chunk, c.start, c.n),
  ends AS (SELECT rec_id, chunk, start, coalesce(lead(start) OVER (PARTITION BY rec_id ORDER BY chunk), n) AS "end" FROM chain)"""


@query("quiet_splits", f'{_QUIET} SELECT rec_id, chunk, start, "end", greatest("end" - start, {RATE // 2}) AS length FROM ends')
def quiet_splits(spark, d):
    return blocks.quiet_splits(_blocks(spark, d), SIZE, RATE, 3.0, 1.0, 0.1)


@query("chunk_samples", f'{_QUIET} SELECT e.rec_id, chunk, count(*) AS n, CAST(sum(CAST(round(CAST(x AS DOUBLE) * 1024) AS BIGINT) * (i - start)) AS BIGINT) AS weighted FROM ends e JOIN s ON s.rec_id = e.rec_id AND s.i >= start AND s.i < "end" GROUP BY ALL')
def chunk_samples(spark, d):
    """Samples of each chunk, and a sum of them that hangs on their order."""
    b = _blocks(spark, d)
    parts = blocks.chunk_samples(b, blocks.quiet_splits(b, SIZE, RATE, 3.0, 1.0, 0.1), SIZE)
    joined = parts.groupBy("rec_id", "chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "samples"))), lambda p: p["samples"])).alias("x"))
    weighted = F.aggregate(F.transform("x", lambda v, i: F.round(v.cast("double") * 1024).cast("long") * i), F.lit(0).cast("long"), lambda a, v: a + v)
    return joined.select("rec_id", "chunk", F.size("x").cast("long").alias("n"), weighted.alias("weighted"))


def _by_filter(spectra, n_mels: int):
    """rec_id, frame, mel, value of spectra."""
    e = spectra.select("rec_id", "first_frame", F.posexplode("energies").alias("at", "v"))
    return e.select("rec_id", (F.col("first_frame") + F.floor(F.col("at") / n_mels)).alias("frame"), (F.col("at") % n_mels).alias("mel"), F.coalesce(F.nullif(F.round(F.col("v").cast("double"), 3), F.lit(0.0)), F.lit(0.0)).alias("value"))  # no -0


_POWER = "p AS (SELECT rec_id, f, k, pow(sum(v * cos(2 * pi() * j * k / 64)), 2) + pow(sum(v * sin(2 * pi() * j * k / 64)), 2) AS power FROM x, range(0, 33) AS r(k) GROUP BY ALL)"
_KALDI = f"""WITH {_SAMPLES},
  f AS (SELECT rec_id, unnest(range(0, (n - 50) // 20 + 1)) AS f FROM total WHERE n >= 50),
  raw AS (SELECT f.rec_id, f, j, CAST(x AS DOUBLE) * 32768 AS v FROM f, range(0, 50) AS r(j) JOIN s ON s.rec_id = f.rec_id AND s.i = f * 20 + j),
  c AS (SELECT rec_id, f, j, v - avg(v) OVER (PARTITION BY rec_id, f) AS v FROM raw),
  x AS (SELECT rec_id, f, j, (v - 0.97 * coalesce(lag(v) OVER (PARTITION BY rec_id, f ORDER BY j), v)) * (0.54 - 0.46 * cos(2 * pi() * j / 49)) AS v FROM c),
  {_POWER},
  e AS (SELECT i, 1127 * ln(1 + 20 / CAST(700 AS DOUBLE)) + i * (1127 * ln(1 + 400 / CAST(700 AS DOUBLE)) - 1127 * ln(1 + 20 / CAST(700 AS DOUBLE))) / 13 AS m FROM range(0, 14) AS r(i)),
  w AS (SELECT a.i AS mel, k, greatest(0, least((b - a.m) / (m.m - a.m), (c.m - b) / (c.m - m.m))) AS w FROM e a JOIN e m ON m.i = a.i + 1 JOIN e c ON c.i = a.i + 2, (SELECT k, 1127 * ln(1 + k * 800 / CAST(64 AS DOUBLE) / 700) AS b FROM range(0, 33) AS r(k))),
  l AS (SELECT rec_id, f, mel, ln(greatest(sum(power * w), pow(2, -23))) AS v FROM p JOIN w USING (k) GROUP BY ALL)
SELECT rec_id, f AS frame, mel, coalesce(nullif(round(v - avg(v) OVER (PARTITION BY rec_id, mel), 3), 0), 0) AS value FROM l"""


@query("filter_bank_blocks", _KALDI)
def filter_bank_blocks(spark, d):
    bank = blocks.log_filter_bank(_blocks(spark, d), SIZE, RATE, n_mels=12, width=50, step=20, n_fft=64)
    return _by_filter(blocks.centred(bank), 12)


_MEL = f"""WITH {_SAMPLES},
  f AS (SELECT rec_id, n, unnest(range(0, n // 16 + 1)) AS f FROM total),
  a AS (SELECT rec_id, f, j, n, abs(f * 16 - 32 + j) AS i FROM f, range(0, 64) AS r(j)),
  x AS (SELECT a.rec_id, f, j, CAST(x AS DOUBLE) * (0.5 - 0.5 * cos(2 * pi() * j / 64)) AS v FROM a JOIN s ON s.rec_id = a.rec_id AND s.i = CASE WHEN a.i >= n THEN 2 * (n - 1) - a.i ELSE a.i END),
  {_POWER},
  e AS (SELECT i, 200 * (i * 6 / CAST(11 AS DOUBLE)) / 3 AS h FROM range(0, 12) AS r(i)),
  w AS (SELECT a.i AS mel, k, greatest(0, least((b - a.h) / (m.h - a.h), (c.h - b) / (c.h - m.h))) * 2 / (c.h - a.h) AS w FROM e a JOIN e m ON m.i = a.i + 1 JOIN e c ON c.i = a.i + 2, (SELECT k, 400 * k / CAST(32 AS DOUBLE) AS b FROM range(0, 33) AS r(k))),
  l AS (SELECT rec_id, f, mel, log10(greatest(sum(power * w), 1e-10)) AS v FROM p JOIN w USING (k) GROUP BY ALL),
  y AS (SELECT *, max(v) OVER (PARTITION BY rec_id) - 8 AS low FROM l)
SELECT rec_id, f AS frame, mel, coalesce(nullif(round((greatest(v, low) + 4) / 4, 3), 0), 0) AS value FROM y JOIN total USING (rec_id) WHERE f < n // 16"""


@query("log_mel_blocks", _MEL)
def log_mel_blocks(spark, d):
    """Up to 400 Hz the mel scale is linear: ten triangles over six mel."""
    return _by_filter(blocks.floored(blocks.log_mel_power(_blocks(spark, d), SIZE, RATE, n_mels=10, n_fft=64, step=16)), 10)
