"""Choosing the next token, and what goes in with tokens.

Logits are an array column, one row for each step and one place for each token, so nothing here shuffles but ``gather``. Candidates are an
array of (negated logit, token), best first; of equal logits the lower token comes first. A null or NaN logit counts as ``NEVER``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a token's logit becomes that may not be chosen.
NEVER = -1e10


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` made once for each row and not once for each place of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def allowed(logits: Column, low: int | None = None, high: int | None = None, allow: tuple[int, ...] = ()) -> Column:
    """``logits`` with all tokens but ``low`` <= token < ``high`` and those of ``allow`` set to ``NEVER``."""
    if low is None and high is None:
        return logits
    inside = lambda i: (i >= F.lit(max(0, low or 0))) & (F.lit(True) if high is None else i < F.lit(high))
    return F.transform(logits, lambda x, i: F.when(inside(i) | i.isin(*allow) if allow else inside(i), x.cast("double")).otherwise(F.lit(NEVER)))


def biased(logits: Column, bias: dict[int, float]) -> Column:
    if not bias:
        return logits
    given = F.create_map(*(F.lit(v) for k, b in bias.items() for v in (int(k), float(b))))
    return F.transform(logits, lambda x, i: x + F.coalesce(F.try_element_at(given, i), F.lit(0.0)))


def penalized(logits: Column, history: Column, last: int = 64, repeat: float = 1.0, frequency: float = 0.0, presence: float = 0.0) -> Column:
    """Tokens among the ``last`` ones of ``history`` lose: a positive logit is divided by ``repeat``, another multiplied; then ``frequency`` for each time and ``presence`` once."""
    if (repeat, frequency, presence) == (1.0, 0.0, 0.0) or last <= 0:
        return logits
    known = F.coalesce(history, F.array().cast("array<int>"))
    tail = F.slice(known, F.greatest(F.lit(1), F.size(known) - last + 1), last)
    counts = lambda t: F.map_from_entries(F.transform(F.array_distinct(t), lambda a: F.struct(a, F.size(F.filter(t, lambda b: b == a)))))

    def less(n: Column) -> Column:
        def one(x, i):
            c = F.try_element_at(n, i)
            y = F.when(x > 0, x / F.lit(repeat)).otherwise(x * F.lit(repeat))
            return F.when(c.isNull(), x.cast("double")).otherwise(y - c * F.lit(frequency) - F.lit(presence))

        return F.transform(logits, one)

    return _let(tail, lambda t: _let(counts(t), less))


def candidates(logits: Column) -> Column:
    """Array of (low: negated logit, token), best first."""
    known = lambda x: F.when(x.isNull() | F.isnan(x), F.lit(NEVER)).otherwise(x.cast("double"))
    return F.array_sort(F.transform(logits, lambda x, i: F.struct((-known(x)).alias("low"), i.alias("token"))))


def top_k(found: Column, k: int) -> Column:
    return F.slice(found, 1, k) if k > 0 else found


def _mass(found: Column, temperature: float = 1.0) -> Column:
    """Of each candidate exp of its distance to the best one."""
    return _let(F.get(found, F.lit(0))["low"], lambda best: F.transform(found, lambda c: F.exp((best - c["low"]) / F.lit(temperature))))


def top_p(found: Column, p: float, keep: int = 1) -> Column:
    """The best candidates up to the one with which their chances reach ``p``; at least ``keep``."""
    if p >= 1:
        return found
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def upto(mass: Column) -> Column:
        def count(total: Column) -> Column:
            step = lambda a, m: F.struct((a["sum"] + m).alias("sum"), (a["n"] + (a["sum"] < F.lit(p) * total).cast("int")).alias("n"))
            return F.aggregate(mass, zero, step, lambda a: a["n"])

        return _let(F.aggregate(mass, F.lit(0.0), lambda a, m: a + m), count)

    return F.slice(found, F.lit(1), F.greatest(F.lit(keep), _let(_mass(found), upto)))


def min_p(found: Column, p: float, keep: int = 1) -> Column:
    """Candidates with a chance of at least ``p`` times the best one's; at least the ``keep`` best."""
    if not 0 < p < 1:
        return found
    reached = _let(F.get(found, F.lit(0))["low"], lambda best: F.size(F.filter(found, lambda c: c["low"] <= best - F.lit(math.log(p)))))
    return F.slice(found, F.lit(1), F.greatest(F.lit(keep), reached))


def greedy(found: Column) -> Column:
    """The best token; null without candidates."""
    return F.get(found, F.lit(0))["token"]


def place_in_unit(step: Column, seed: int) -> Column:
    """A number from 0 up to 1 that the step and the seed decide, so a task that runs again draws the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), step.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def drawn(found: Column, place: Column, temperature: float = 1.0) -> Column:
    """The token in whose part of the chances, laid end to end, ``place`` lies."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def at(mass: Column) -> Column:
        def count(total: Column) -> Column:
            step = lambda a, m: F.struct((a["sum"] + m).alias("sum"), (a["n"] + (a["sum"] + m <= place * total).cast("int")).alias("n"))
            return F.aggregate(mass, zero, step, lambda a: a["n"])

        return _let(F.aggregate(mass, F.lit(0.0), lambda a, m: a + m), count)

    return F.get(found, F.least(_let(_mass(found, temperature), at), F.size(found) - 1))["token"]


def sample(
    logits: Column, step: Column, *, temperature: float = 0.8, k: int = 50, p: float = 1.0, least: float = 0.0, bias: dict[int, float] | None = None, history: Column | None = None,
    last: int = 64, repeat: float = 1.0, frequency: float = 0.0, presence: float = 0.0, low: int | None = None, high: int | None = None, allow: tuple[int, ...] = (), seed: int = 0,
) -> Column:
    """The next token of a step: mask, bias, penalties; then top-k, top-p, min-p, temperature and a draw; the best one if the temperature isn't above 0."""
    x = biased(allowed(logits, low, high, allow), bias or {})
    if history is not None:
        x = penalized(x, history, last, repeat, frequency, presence)
    if temperature <= 0:
        return greedy(candidates(x))
    return _let(min_p(top_p(top_k(candidates(x), k), p), least), lambda c: drawn(c, place_in_unit(step, seed), temperature))


def positions(n_tokens: Column, spans: Column) -> Column:
    """(positions, delta): the places of a prompt's tokens, the same on all three axes, and by how much the last lies beyond their number. ``spans``: (offset, length) of the audio in
    the prompt; places run on through text and audio, to the end of the last span if that lies beyond the tokens."""
    ends = F.coalesce(F.array_max(F.transform(spans, lambda s: s["offset"] + s["length"])), F.lit(0))
    total = F.greatest(n_tokens.cast("long"), ends.cast("long"))
    none = F.array().cast("array<bigint>")
    return F.struct(F.when(total > 0, F.sequence(F.lit(0).cast("long"), total - 1)).otherwise(none).alias("positions"), (total - n_tokens).alias("delta"))


def small_float(bits: Column, exponent: int, mantissa: int) -> Column:
    """The number that the lowest ``1 + exponent + mantissa`` bits say: 5 and 10 for half precision, 8 and 7 for brain floats."""
    sign = F.when(bits.bitwiseAND(1 << (exponent + mantissa)) != 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    e = F.shiftright(bits, mantissa).bitwiseAND((1 << exponent) - 1)
    m = bits.bitwiseAND((1 << mantissa) - 1)
    top, middle = (1 << exponent) - 1, (1 << (exponent - 1)) - 1
    special = F.when(m == 0, F.lit(float("inf")) * sign).otherwise(F.lit(float("nan")))
    small = sign * F.lit(2.0 ** (1 - middle)) * m / F.lit(float(1 << mantissa))
    usual = sign * F.pow(F.lit(2.0), (e - middle).cast("double")) * (m / F.lit(float(1 << mantissa)) + 1)
    return F.when(e == top, special).when(e == 0, small).otherwise(usual)


def gather(df: DataFrame, token: str, rows: DataFrame, row_token: str) -> DataFrame:
    """``df`` with the columns of the row of ``rows`` that its token names; unknown tokens keep nulls. The planner picks the join by the tables' sizes."""
    return df.join(rows.withColumnRenamed(row_token, "__token"), F.col(token) == F.col("__token"), "left").drop("__token")


def tensor_group(name: Column) -> Column:
    """The block that a weight belongs to: ``blk.N``, ``enc.blk.N``, ``dec.blk.N``, else ``enc``, ``dec`` or ``base``."""
    own = F.regexp_extract(name, r"^((?:enc\.|dec\.)?blk\.[^.]*|(?:enc|dec)(?=\.|$))", 1)
    return F.when(F.coalesce(own, F.lit("")) == "", F.lit("base")).otherwise(own)


def tensor_stats(df: DataFrame, name: str, elements: str, size: str) -> DataFrame:
    """tensor_group, elements, bytes, percent (of all elements), bits (of a weight; null without elements)."""
    g = df.groupBy(tensor_group(F.col(name)).alias("tensor_group")).agg(F.sum(elements).alias("elements"), F.sum(size).alias("bytes"))
    total = g.agg(F.sum("elements").alias("__total"))  # one row
    bits = F.when(F.col("elements") > 0, F.col("bytes") * 8 / F.col("elements"))
    return g.join(F.broadcast(total)).select("tensor_group", "elements", "bytes", F.when(F.col("__total") > 0, F.col("elements") / F.col("__total") * 100).alias("percent"), bits.alias("bits"))


def released(path: Column) -> Column:
    """Whether a file goes into a release: not from a cache, editor or version folder; of a model folder only ``.txt`` files."""
    parts = F.split(F.coalesce(path, F.lit("")), "/")
    last = F.element_at(parts, -1)
    hidden = F.arrays_overlap(parts, F.array(*map(F.lit, ("__pycache__", ".vscode", ".git"))))
    return ~hidden & (~F.array_contains(parts, "model") | F.lower(last).rlike(r"[^.].*\.txt$|^\.+[^.].*\.txt$"))


def settings(saved: Column, defaults: dict[str, str]) -> Column:
    """Map of the defaults and what the JSON object ``saved`` says in their place or beside them; anything but an object says nothing."""
    base = F.create_map(*(F.lit(x) for pair in defaults.items() for x in pair))
    own = F.coalesce(F.from_json(F.when(F.trim(saved).startswith("{"), saved), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)
