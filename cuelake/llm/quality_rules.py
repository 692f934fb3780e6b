"""Quality rules under weak supervision, in DataFrame functions only.

Each rule votes 1 (good), -1 (bad) or 0 (abstains). The votes of a row form a pattern; there are at most
``3 ** len(RULES)`` of them whatever the input, and their counts over all rows are all that estimation needs.
Expectation-maximisation estimates the share of good rows and, for each rule, how often its vote is right on good
and on bad rows; it is one SQL expression over the pattern counts, evaluated in the JVM. A row is kept if its posterior probability of being good
is at least 0.5. No rule can reject a row by itself: a vote counts as much as the rule's accuracy warrants.

Null text has no words and no lines. Rows are judged one by one, so nulls in other columns, repeated rows and
extra columns of any name pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, fresh, read, scalar

#: Letters that count as capitals.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒŸ"
WINDOW = 8

#: Rule: (name, SQL condition for bad, SQL condition for good); bad goes first, neither: it abstains. Most rules look for
#: one kind of junk and have no say on good text.
RULES = [
    ("odd_characters", "4 * n_odd > n_words", "20 * n_odd < n_words"),
    ("variety", "n_words >= 10 AND 10 * n_twins > n_words", "n_words >= 10 AND 50 * n_twins <= n_words"),
    ("line_ends", "5 * n_ended_lines < n_lines", "n_lines > 0 AND 2 * n_ended_lines >= n_lines"),
    ("length", "n_words = 0", "n_words >= 50"),
    ("word_length", "word_chars > 14 * n_words OR word_chars < 2 * n_words", "FALSE"),
    ("symbols", "10 * n_symbols > n_words", "FALSE"),
    ("duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 4 * n_lines", "FALSE"),
    ("repeated_words", "10 * n_repeat_words > 3 * n_words", "FALSE"),
    ("capitals", "2 * n_capitals > word_chars", "FALSE"),
    ("exclamation", "5 * n_exclamations > n_words", "FALSE"),
]
#: Estimation: rounds, and the weight (in rows) of the start. The start: share of good rows; the chances of a vote for good and a
#: vote for bad on good and on bad rows. A vote for bad stays at least TRUST times as likely on bad rows as on good ones, so
#: that the two classes can't change places.
ROUNDS, PRIOR, SHARE, ON_GOOD, ON_BAD, TRUST = 25, 20, 0.8, (0.6, 0.03), (0.4, 0.3), 2

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclamations", "n_ended_lines", "n_odd", "n_twins"]


def stats(docs: DataFrame, text: str = "text", prefix: str = "__q_") -> DataFrame:
    """``docs`` with the counts that the rules look at, as long columns named with ``prefix``."""
    p = prefix
    blank = r" \t\n\u000B\u000C\r"
    count = lambda chars: f"cast(length({p}t) - length(translate({p}t, '{chars}', '')) as bigint)"
    out = docs.withColumn(f"{p}t", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    out = out.withColumn(f"{p}w", F.expr(f"trim(BOTH '{blank}' FROM {p}t)"))
    out = out.withColumn(f"{p}w", F.when(F.col(f"{p}w") == "", F.array().cast("array<string>")).otherwise(F.split(f"{p}w", BLANKS)))
    out = out.withColumn(f"{p}lines", F.filter(F.split(f"{p}t", "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != ""))
    out = out.withColumn(f"{p}h", F.expr(f"transform({p}w, x -> xxhash64(x))"))
    out = out.withColumn(f"{p}n_twins", F.expr(f"cast(size(filter({p}h, (x, i) -> x = get({p}h, i + 1))) as bigint)"))
    out = out.withColumn(
        f"{p}h",
        F.expr(f"CASE WHEN size({p}h) >= {WINDOW} THEN transform(sequence(0, size({p}h) - {WINDOW}), i -> xxhash64({', '.join(f'get({p}h, i + {k})' for k in range(WINDOW))})) ELSE array() END"),
    )
    # most texts repeat no window, and need no sorting
    out = out.withColumn(
        f"{p}h",
        F.expr(f"CASE WHEN size(array_distinct({p}h)) < size({p}h) THEN sort_array(transform({p}h, (h, i) -> struct(h, i))) ELSE array() END"),
    )
    out = out.withColumn(
        f"{p}h",
        F.expr(f"sort_array(transform(filter({p}h, (x, k) -> x.h = get({p}h, k - 1).h OR x.h = get({p}h, k + 1).h), x -> x.i))"),
    )
    counts = {
        "n_words": f"cast(size({p}w) as bigint)",
        "word_chars": f"cast(length(translate({p}t, '{blank}', '')) as bigint)",
        "n_symbols": count("#*$%&|<>"),
        "n_dup_lines": f"cast(size({p}lines) - size(array_distinct({p}lines)) as bigint)",
        "n_repeat_words": f"cast(aggregate({p}h, struct(0 as c, -{WINDOW} as at), (a, i) -> struct(a.c + least({WINDOW}, i - a.at) as c, i as at), a -> a.c) as bigint)",
        "n_lines": f"cast(size({p}lines) as bigint)",
        "n_capitals": count(CAPITALS),
        "n_exclamations": count("!"),
        "n_odd": f"cast(regexp_count({p}t, r'[^\\p{{L}}\\p{{N}}\\s.,;:?\\x27-]') as bigint)",
        "n_ended_lines": rf"cast(size(filter({p}lines, x -> rtrim('{blank}', x) rlike '[.!?…]$')) as bigint)",
    }
    out = out.withColumns({f"{p}{k}": F.expr(v) for k, v in counts.items()})
    return out.drop(*(f"{p}{x}" for x in ("t", "w", "lines", "h")))


def votes(prefix: str = "__q_"):
    """Array of the rules' votes from columns of ``stats``."""
    named = lambda sql: re.sub(r"\b(" + "|".join(STATS) + r")\b", rf"{prefix}\1", sql)
    return F.array(*(F.expr(f"CASE WHEN {named(bad)} THEN -1 WHEN {named(good)} THEN 1 ELSE 0 END") for _, bad, good in RULES))


def estimate_sql(patterns: str, n_rules: int = len(RULES)) -> str:
    """SQL expression: struct(p, t) fitted to the array ``patterns`` of struct(v array<int>, n bigint).

    p: share of good rows; t: for each rule the chances of the votes 1 and -1 on good rows (gu, gd) and on bad rows (bu, bd)."""
    rules = f"sequence(0, {n_rules - 1})"
    ratio = (
        "CASE get(x.v, r) WHEN 1 THEN ln(get(s.t, r).gu / get(s.t, r).bu) WHEN -1 THEN ln(get(s.t, r).gd / get(s.t, r).bd) "
        "ELSE ln((1D - get(s.t, r).gu - get(s.t, r).gd) / (1D - get(s.t, r).bu - get(s.t, r).bd)) END"
    )
    logit = f"ln(s.p / (1D - s.p)) + aggregate({rules}, 0D, (a, r) -> a + {ratio})"
    scored = f"transform({patterns}, x -> struct(x.v as v, cast(x.n as double) as n, 1D / (1D + exp(-({logit}))) as q))"
    total = lambda what: f"aggregate(y, 0D, (a, x) -> a + ({what}))"

    def chance(vote: int, q: str, start: float) -> str:
        seen = total(f"CASE WHEN get(x.v, r) = {vote} THEN x.n * {q} ELSE 0D END")
        return f"({seen} + {PRIOR * start}D) / ({total(f'x.n * {q}')} + {PRIOR}D)"

    good, bad = "x.q", "(1D - x.q)"
    table = (
        f"transform({rules}, r -> get(transform(array(struct({chance(1, good, ON_GOOD[0])} as gu, {chance(-1, good, ON_GOOD[1])} as gd, {chance(1, bad, ON_BAD[0])} as bu, {chance(-1, bad, ON_BAD[1])} as bd)), "
        f"z -> struct(z.gu as gu, least(z.gd, z.bd / {TRUST}D) as gd, least(z.bu, z.gu) as bu, z.bd as bd)), 0))"
    )
    share = f"({total('x.n * x.q')} + {PRIOR * SHARE}D) / ({total('x.n')} + {PRIOR}D)"
    step = f"get(transform(array({scored}), y -> struct({share} as p, {table} as t)), 0)"
    start = f"struct({ON_GOOD[0]}D as gu, {ON_GOOD[1]}D as gd, {ON_BAD[0]}D as bu, {ON_BAD[1]}D as bd)"
    return f"aggregate(sequence(1, {ROUNDS}), struct({SHARE}D as p, array_repeat({start}, {n_rules}) as t), (s, i) -> {step})"


def estimate(voted: DataFrame, column: str) -> tuple[float, list[dict]]:
    """p and t of ``estimate_sql`` from the votes in ``column`` of all rows of ``voted``."""
    patterns = voted.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("patterns"))  # 3 ** rules at most
    s = scalar(one.select(F.expr(estimate_sql("patterns")).alias("s")))["s"]
    return s["p"], [r.asDict() for r in s["t"]]


def posterior(column, p: float, table: list[dict]):
    """Column: probability that a row with the votes in ``column`` is good."""
    score = F.lit(math.log(p / (1 - p)))
    for r, t in enumerate(table):
        up, down = math.log(t["gu"] / t["bu"]), math.log(t["gd"] / t["bd"])
        none = math.log((1 - t["gu"] - t["gd"]) / (1 - t["bu"] - t["bd"]))
        score = score + F.when(column[r] == 1, up).when(column[r] == -1, down).otherwise(none)
    return 1.0 / (1.0 + F.exp(-score))


def judge(docs: DataFrame, text: str = "text", scratch: Scratch | None = None, prefix: str = "__q_") -> DataFrame:
    """``docs`` with the columns of ``stats`` and ``{prefix}quality``, the posterior probability. The rows with their votes are
    written once, and estimation and scoring read that table."""
    scratch = scratch or Scratch(docs.sparkSession, "quality-rules")
    voted = scratch.save(docs.withColumn(f"{prefix}votes", votes(prefix)), "voted")
    p, table = estimate(voted, f"{prefix}votes")
    return voted.withColumn(f"{prefix}quality", posterior(F.col(f"{prefix}votes"), p, table)).drop(f"{prefix}votes")


def base_failed(prefix: str = "__q_"):
    n, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 20) | (100 * again > 30 * n)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows whose posterior probability is at least 0.5, with the columns of ``docs``."""
    prefix = fresh(docs.columns, "__q_")
    judged = judge(stats(docs, prefix=prefix), prefix=prefix)
    return judged.where(F.col(f"{prefix}quality") >= 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(stats(docs).drop("text"))
    counts = [F.col(f"__q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, base_failed().alias("base_failed"), (~base_failed() & (F.col("__q_quality") >= 0.5)).alias("kept"))
