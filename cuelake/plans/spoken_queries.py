"""Queries over what was said and how it is written: numbers spoken in Chinese made of the orders, model outputs made of the conversations. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import itn as N
from ..functions import text as T
from .adapters import UTTERANCES_SQL, table, utterances

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIGITS = "零一二三四五六七八九"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _digit(n: Column) -> Column:
    return F.substring(F.lit(DIGITS), (n + 1).cast("int"), F.lit(1))


def _spoken(n: Column) -> Column:
    """A whole number from 1 to 9999 in words."""
    place = lambda k: F.floor(n / k) % 10
    thousands, hundreds, tens, ones = (place(k) for k in (1000, 100, 10, 1))
    word = lambda d, unit: F.when(d > 0, F.concat(_digit(d), F.lit(unit))).otherwise("")
    gap = F.when((thousands > 0) & (hundreds == 0) & (n % 100 > 0), "零").otherwise("")
    last_gap = F.when((hundreds > 0) & (tens == 0) & (ones > 0), "零").otherwise("")
    ten = F.when((n < 20) & (tens == 1), "十").otherwise(word(tens, "十"))
    return F.concat(word(thousands, "千"), gap, word(hundreds, "百"), last_gap, ten, F.when(ones > 0, _digit(ones)).otherwise(""))


@query("spoken_numbers", "SELECT o_orderkey, '共' || (o_orderkey % 9000 + 100) || '次' AS number, '占' || (o_custkey % 90 + 10) || '%' AS share, extract(year FROM o_orderdate) || '年' || extract(month FROM o_orderdate) || '月' || extract(day FROM o_orderdate) || '日' AS day, (o_orderkey % 80 + 11) || 'g' AS weight, (o_orderkey % 7 + 2) || '/' || (o_custkey % 9 + 11) AS fraction FROM orders")
def spoken_numbers(spark, d):
    """Numbers, shares, days, weights and fractions, spoken and written again."""
    o = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    year = F.concat(*(_digit(F.floor(F.year("day") / k) % 10) for k in (1000, 100, 10, 1)))
    said = {
        "number": F.concat(F.lit("共"), _spoken(F.col("o_orderkey") % 9000 + 100), F.lit("次")), "share": F.concat(F.lit("占百分之"), _spoken(F.col("o_custkey") % 90 + 10)),
        "day": F.concat(year, F.lit("年"), _spoken(F.month("day")), F.lit("月"), _spoken(F.dayofmonth("day")), F.lit("日")),
        "weight": F.concat(_spoken(F.col("o_orderkey") % 80 + 11), F.lit("克")), "fraction": F.concat(_spoken(F.col("o_custkey") % 9 + 11), F.lit("分之"), _spoken(F.col("o_orderkey") % 7 + 2)),
    }
    return o.select("o_orderkey", *(N.itn(x).alias(name) for name, x in said.items()))


@query("transcripts", f"WITH {UTTERANCES_SQL} SELECT rec_id, pos, CASE WHEN pos % 5 IN (0, 4) THEN 'German' ELSE '' END AS language, CASE WHEN pos % 5 = 1 THEN '' WHEN pos % 5 = 2 AND trim(text) <> '' THEN trim(text) || ' ' || repeat('ha', 1) ELSE trim(text) END AS text FROM utterances")
def transcripts(spark, d):
    """Outputs of a model: with a language, with none for silence, without a tag and with a loop at the end, with a tag alone, with a language that is overruled."""
    kind, text = F.col("pos") % 5, F.col("text")
    raw = F.when(kind == 0, F.concat(F.lit("language GERMAN<asr_text>"), text)).when(kind == 1, "language None<asr_text>").when((kind == 2) & (F.trim("text") != ""), F.concat(F.trim("text"), F.lit(" "), F.repeat(F.lit("ha"), F.lit(30))))
    raw = raw.when(kind == 3, F.concat(F.lit("<asr_text> "), text)).when(kind == 4, F.concat(F.lit("language french<asr_text>"), text)).otherwise(text)
    language, words = T.parse_transcript(raw, F.when(kind == 4, "german"))
    return utterances(spark, d).select("rec_id", "pos", language.alias("language"), words.alias("text"))
