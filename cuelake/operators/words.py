"""Words of languages whose spaces don't part them, learned from the texts themselves: no dictionary, no tagger.

How well a string of characters holds together is its cohesion: the chance, by the corpus, that its first character goes on to be it, as a mean for each step:
``(count(string) / count(first character)) ** (1 / (length - 1))``. Counts are of all texts, by distinct tokens first, so a frequent token is counted once and weighed.

* ``left_parts``: what blanks part (a Korean word with its particles) is cut in two, after the prefix that holds together best.
* ``lattice``: a run without blanks (Japanese) is cut into the pieces whose cohesion, weighed by their length, adds up to most.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the longest string that is scored.
LONGEST = 8


def distinct_tokens(texts: DataFrame, text: str = "text", pattern: str = r"\S+") -> DataFrame:
    """token, n: what matches ``pattern`` in all texts, and how often it comes. Null texts have none."""
    found = texts.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("token"))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _scored(strings: DataFrame) -> DataFrame:
    """string, length, n, n_first (of its first character), score of strings (string, n) that may come several times. Counts of single characters, of which Unicode has so many and no more, are
    broadcast; the strings aren't dealt by their first characters."""
    counts = strings.groupBy("string").agg(F.sum("n").alias("n")).withColumn("length", F.length("string"))
    first = counts.where("length = 1").select(F.col("string").alias("first"), F.col("n").alias("n_first"))
    own = counts.join(F.broadcast(first), F.substring("string", 1, 1) == F.col("first"))
    score = F.when(F.col("length") > 1, F.round(F.pow(F.col("n") / F.col("n_first"), 1 / (F.col("length") - 1)), 12)).otherwise(F.lit(0.0))
    return own.select("string", "length", "n", "n_first", score.alias("score"))


def prefix_scores(tokens: DataFrame, longest: int = LONGEST) -> DataFrame:
    """string, length, n, n_first, score of all prefixes of tokens (token, n) up to ``longest`` characters."""
    lengths = F.sequence(F.lit(1), F.least(F.length("token"), F.lit(longest)))
    return _scored(tokens.where("token <> ''").select(F.explode(F.transform(lengths, lambda k: F.substring("token", F.lit(1), k))).alias("string"), "n"))


def left_parts(tokens: DataFrame, scores: DataFrame, longest: int = LONGEST) -> DataFrame:
    """token, left, right of each token: cut after the prefix of two characters or more with the highest score, of several the longest; a token of one character is whole."""
    lengths = F.sequence(F.lit(1), F.least(F.length("token"), F.lit(longest)))
    cut = tokens.where("token <> ''").select("token", F.explode(F.transform(lengths, lambda k: F.substring("token", F.lit(1), k))).alias("string"))
    best = cut.join(scores, "string").groupBy("token").agg(F.max(F.struct("score", "length")).alias("best"))
    left = F.expr("substring(token, 1, best.length)")
    return best.select("token", left.alias("left"), F.expr("substring(token, best.length + 1)").alias("right"))


def _substrings(token: Column, longest: int) -> Column:
    """Array of (place, string) of all substrings up to ``longest`` characters."""
    places = F.sequence(F.lit(1), F.length(token))
    return F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(token) - i + 1)), lambda k: F.struct((i - 1).alias("place"), F.substring(token, i, k).alias("string")))))


def substring_scores(tokens: DataFrame, longest: int = LONGEST) -> DataFrame:
    """string, length, n, n_first, score of all substrings of tokens (token, n)."""
    return _scored(tokens.where("token <> ''").select(F.explode(_substrings(F.col("token"), longest)).alias("s"), "n").select("s.string", "n"))


def best_pieces(length: int, edges: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """(place, length) of the pieces from 0 to ``length`` whose scores times lengths add up to most; of equal sums the fewest pieces, then the longest first ones."""
    by_place: dict[int, list] = {}
    for place, n, score in edges:
        by_place.setdefault(place, []).append((n, score))
    best: list[tuple | None] = [None] * length + [(0.0, 0, ())]
    for i in range(length - 1, -1, -1):
        options = [(round(best[i + n][0] + score * n, 9), best[i + n][1] - 1, (n, *best[i + n][2])) for n, score in by_place.get(i, [(1, 0.0)])]
        best[i] = max(options)
    out, at = [], 0
    for n in best[0][2]:
        out.append((at, n))
        at += n
    return out


def lattice(tokens: DataFrame, scores: DataFrame, longest: int = LONGEST) -> DataFrame:
    """token, pieces (array of strings) of each distinct token, which brings the scores of its own substrings along. Single characters score nothing, whatever their counts, and need none."""
    longer = F.filter(_substrings(F.col("token"), longest), lambda s: F.length(s["string"]) > 1)
    cut = tokens.where(F.length("token") > 1).select("token", F.explode(longer).alias("s")).select("token", F.col("s.place").cast("int").alias("place"), "s.string")
    # an edge is two numbers, in lists of the same order, and not a struct: half of the memory of sorts
    at = (F.col("place") * (longest + 1) + F.col("length")).cast("int")
    edges = F.struct(F.collect_list(at).alias("at"), F.collect_list("score").alias("score"))
    given = cut.join(scores.where("length > 1").select("string", "length", "score"), "string").groupBy("token").agg(edges.alias("edges"))

    @F.pandas_udf("array<string>")
    def pieces(token: pd.Series, edges: pd.DataFrame) -> pd.Series:
        def one(t: str, places, scores_) -> list[str]:
            found = [(i, 1, 0.0) for i in range(len(t))]
            found += [(*divmod(k, longest + 1), x) for k, x in zip(places.tolist(), scores_.tolist())]
            return [t[a : a + n] for a, n in best_pieces(len(t), found)]

        return pd.Series([one(*x) for x in zip(token, edges["at"], edges["score"])], dtype=object)

    single = tokens.where(F.length("token") == 1).select("token", F.array("token").alias("pieces"))
    return given.select("token", pieces("token", "edges").alias("pieces")).unionByName(single)


def split_texts(texts: DataFrame, key: str, splits: DataFrame, text: str = "text", pattern: str = r"\S+") -> DataFrame:
    """key, tokens: each text's tokens with their pieces (token, pieces) in their place; a token without pieces is whole."""
    found = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("at", "token")).join(splits, "token", "left")
    one = F.struct("at", F.coalesce("pieces", F.array("token")).alias("pieces"))
    return found.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["pieces"])).alias("tokens"))
