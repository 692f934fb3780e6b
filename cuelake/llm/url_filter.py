"""URL filter: allow and block rules first, then a ratio of two character language models.

A rule is a host and a path prefix. It fits its host and all subdomains, if the url's path starts with its prefix; of
the rules that fit, the longest wins (at equal length, block). The urls that rules accept or reject are the text of two
variable-order Markov models over bytes: the chance of a byte after its last ``k`` bytes is the smoothed count, with
the chance after ``k - 1`` bytes as its prior, and a context is used only if it was seen ``LEAST`` times. A url that
no rule fits is allowed if its length-normalised log-likelihood difference reaches a threshold, which is calibrated on a fifth of the
ruled urls that the counts leave out.

Counts cover all ruled urls and are exact: a table has a row for each distinct run of ``ORDER`` + 1 bytes, which holds the counts
of all orders, as a lower order's are sums over its suffixes. The table grows with the input and is never collected. Only orders 0 and 1, at
most 257 * 256 rows whatever the input, are broadcast; the others are worked out where runs with the same last context bytes meet. Urls
are dealt into blocks of ``BLOCK``, and a block fetches the difference of each run that it has once.

A null url, or one without ``://``, has empty host and path, and no rule fits; it scores 0 if null or empty. Without ruled
urls of both kinds the threshold is 0 and all differences are 0: such urls are allowed. Urls of any length are judged whole. Repeated rows are judged alike; an empty
table gives an empty result. html is left out, columns named like a result are replaced, and all others are kept, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, read

#: Highest order, sightings that a context needs, weight of the lower order.
ORDER, LEAST, SMOOTH = 5, 3, 1.5
#: Bits of a byte in a run (0: before the url's start), orders that are broadcast, urls of a block.
WIDE, LOW, BLOCK = 9, 1, 4096
#: Bins of the calibration histogram, over differences from -SPAN to SPAN nats a byte.
BINS, SPAN = 4000, 4.0

#: The rules of the query, as its contract states them.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    at = rest.find("/", 0, end)
    return (rest[:end].translate(_LOWER), "") if at < 0 else (rest[:at].translate(_LOWER), rest[at:end])


class Rules:
    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_LOWER), []).append((slash + path, verdict, rule))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest that fits."""
        best: tuple[int, bool, str | None, str | None] = (-1, False, None, None)
        labels = host.split(".")
        for i in range(len(labels)):
            for prefix, verdict, rule in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(prefix):
                    best = max(best, (len(rule), verdict == "block", rule, verdict))
        return best[2], best[3]


def _grams(urls: list[str | None]) -> tuple[np.ndarray, list[int], np.ndarray]:
    """For all bytes of the urls: their url's number, and the run of the byte and the ORDER before it. The lengths of the urls are between."""
    raws = [(u or "").encode("utf-8", "replace") for u in urls]
    lengths = [len(r) for r in raws]
    of = np.repeat(np.arange(len(raws)), lengths)
    data = np.frombuffer(b"".join(raws), np.uint8).astype(np.int64) + 1
    at = np.arange(len(data)) - (np.cumsum([0, *lengths])[:-1])[of]
    grams = data.copy()
    for k in range(1, ORDER + 1):
        back = np.zeros(len(data), np.int64)
        back[k:] = data[:-k]
        back[at < k] = 0
        grams |= back << (WIDE * k)
    return of, lengths, grams


def _order(grams, k: int):
    """The runs' last ``k`` + 1 bytes."""
    return grams & ((1 << WIDE * (k + 1)) - 1)


def _sums(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Sums of counts [kind, row] over each wanted key."""
    if not len(keys):
        return np.zeros((2, len(wanted)))
    known, of = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.stack([np.bincount(of, c, len(known))[at] * (known[at] == wanted) for c in counts])


def _chances(p: np.ndarray, wanted: np.ndarray, grams: np.ndarray, counts: np.ndarray, orders: range) -> np.ndarray:
    """P(byte | accepted) and P(byte | rejected) of wanted runs by these orders; ``p`` by the order before."""
    for k in orders:
        n, m = (_sums(_order(grams, k) >> w, counts, _order(wanted, k) >> w) for w in (WIDE, 0))
        p = np.where(n >= LEAST, (m + SMOOTH * p) / (n + SMOOTH), p)
    return p


def _even(n: int) -> np.ndarray:
    return np.full((2, n), 1 / 256)


class Models:
    """Counts [accepted or rejected, row] of runs; all of them, or the last bytes up to order LOW with ``table``, which has all (gram, accepted, rejected)."""

    def __init__(self, grams: np.ndarray | None = None, counts: np.ndarray | None = None, threshold: float = 0.0, table: DataFrame | None = None, scratch: Scratch | None = None):
        self.grams = np.zeros(0, np.int64) if grams is None else grams
        self.counts = np.zeros((2, 0), np.int64) if counts is None else counts
        self.threshold, self.table, self.scratch = threshold, table, scratch

    def add(self, urls: list[str], kinds: list[int]) -> None:
        of, _, grams = _grams(urls)
        kind = np.array(kinds, np.int64)[of] if len(of) else np.zeros(0, np.int64)
        both = np.concatenate([self.counts, np.stack([kind == 0, kind == 1])], axis=1)
        self.grams, at = np.unique(np.concatenate([self.grams, grams]), return_inverse=True)
        self.counts = np.stack([np.bincount(at, c, len(self.grams)).astype(np.int64) for c in both])

    def fitted(self) -> bool:
        return bool(self.counts.any(axis=1).all())

    def differences(self, urls: list[str | None]) -> np.ndarray:
        """Mean of log P(byte | accepted) - log P(byte | rejected) over each url's bytes."""
        of, lengths, grams = _grams(urls)
        if not self.fitted():
            return np.zeros(len(urls))
        log = np.log(_chances(_even(len(grams)), grams, self.grams, self.counts, range(ORDER + 1)))
        return np.bincount(of, log[0] - log[1], minlength=len(urls)) / np.maximum(lengths, 1)


def _scored(rows: DataFrame, models: Models) -> DataFrame:
    """``rows``, whose last column is url, with score, the mean difference over the url's bytes."""
    schema = rows.withColumn("score", F.lit(0.0)).schema
    if not models.fitted():
        return rows.withColumn("score", F.lit(0.0))
    deal = fresh(rows.columns, "__deal")
    dealt = models.scratch.save(rows.withColumn(deal, F.expr(f"monotonically_increasing_id() div {BLOCK}")), f"dealt-{uuid.uuid4().hex[:8]}")
    shared = rows.sparkSession.sparkContext.broadcast((models.grams, models.counts))  # 257 * 256 rows at most

    def used(batches):
        for b in batches:
            of, _, grams = _grams(b.column(1).to_pylist())
            deals = b.column(0).to_numpy()
            for d in np.unique(deals):
                mine = np.unique(grams[(deals == d)[of]])
                yield pa.RecordBatch.from_pydict({"deal": pa.array(np.full(len(mine), d), pa.int64()), "gram": pa.array(mine, pa.int64())})

    def differ(wanted: pa.Table, counted: pa.Table) -> pa.Table:
        grams = wanted["gram"].to_numpy()
        counts = np.stack([counted[c].to_numpy() for c in ("accepted", "rejected")]) if counted.num_rows else np.zeros((2, 0))
        p = _chances(_even(len(grams)), grams, *shared.value, range(LOW + 1))
        log = np.log(_chances(p, grams, counted["gram"].to_numpy() if counted.num_rows else np.zeros(0, np.int64), counts, range(LOW + 1, ORDER + 1)))
        return pa.table({"gram": pa.array(grams, pa.int64()), "difference": pa.array(log[0] - log[1], pa.float64())})

    def score(urls: pa.Table, runs: pa.Table) -> pa.Table:
        if not urls.num_rows:
            return schema_table([[]] * len(schema))
        of, lengths, grams = _grams(urls.column(urls.num_columns - 2).to_pylist())
        total = np.zeros(urls.num_rows)
        if len(grams):
            known, first = np.unique(runs["gram"].to_numpy(), return_index=True)
            total = np.bincount(of, runs["difference"].to_numpy()[first][np.searchsorted(known, grams)], minlength=urls.num_rows)
        return schema_table([*urls.columns[:-1], pa.array(total / np.maximum(lengths, 1), pa.float64())])

    names = schema.names

    def schema_table(columns: list) -> pa.Table:
        return pa.Table.from_arrays(columns, names=names)

    seen = dealt.select(deal, "url").mapInArrow(used, "deal long, gram long")
    last = lambda df: df.groupBy(F.shiftright(F.col("gram"), WIDE).bitwiseAND((1 << WIDE * (LOW + 1)) - 1).alias("last"))
    worth = last(seen.select("gram").distinct()).cogroup(last(models.table)).applyInArrow(differ, "gram long, difference double")
    return dealt.groupBy(deal).cogroup(seen.join(worth, "gram").groupBy("deal")).applyInArrow(score, schema)


def _ruled(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """url, kind (0 accepted, 1 rejected) and calibrates, of every url that a rule fits."""

    def run(batches):
        known = Rules(rules)
        for b in batches:
            urls, kinds = [], []
            for u in b.column(0).to_pylist():
                verdict = known.match(*parts(u))[1]
                if verdict:
                    urls.append(u)
                    kinds.append(int(verdict == "block"))
            yield pa.RecordBatch.from_pydict({"url": pa.array(urls, pa.string()), "kind": pa.array(kinds, pa.int32())})

    found = pages.select(F.col("url").cast("string")).mapInArrow(run, "url string, kind int")
    return found.withColumn("calibrates", F.pmod(F.xxhash64("url"), F.lit(5)) == 0)


def fit(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> Models:
    ruled, scratch = _ruled(pages, rules), Scratch(pages.sparkSession, "url_filter")

    def count(batches):
        for b in batches:
            models = Models()
            models.add(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict({"gram": pa.array(models.grams, pa.int64()), "accepted": pa.array(models.counts[0], pa.int64()), "rejected": pa.array(models.counts[1], pa.int64())})

    def sums(df, gram):
        return df.groupBy(gram.alias("gram")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))

    counted = ruled.where(~F.col("calibrates")).select("url", "kind").mapInArrow(count, "gram long, accepted long, rejected long")
    table = scratch.save(sums(counted, F.col("gram")), "counts")
    low = sums(table, F.col("gram").bitwiseAND((1 << WIDE * (LOW + 1)) - 1)).toArrow()  # 257 * 256 rows at most
    models = Models(low["gram"].to_numpy(), np.stack([low["accepted"].to_numpy(), low["rejected"].to_numpy()]), table=table, scratch=scratch)

    hist = np.zeros((2, BINS), np.int64)
    binned = F.least(F.greatest(F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    for r in _scored(ruled.where("calibrates").select("kind", "url"), models).groupBy(binned.alias("bin"), "kind").agg(F.count(F.lit(1)).alias("n")).collect():
        hist[r["kind"], r["bin"]] = r["n"]
    if hist.sum(axis=1).all():
        # below the threshold: rejected; the sum of both error rates is least
        share = hist / hist.sum(axis=1, keepdims=True)
        wrong = np.concatenate([[0], np.cumsum(share[0])]) + np.concatenate([[1], 1 - np.cumsum(share[1])])
        least = np.flatnonzero(wrong <= wrong.min() + 1e-12)
        models.threshold = float(least[len(least) // 2] / BINS * 2 * SPAN - SPAN)
    return models


def judge(pages: DataFrame, models: Models, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` without html, with host, path, rule, verdict and score (the difference)."""
    threshold = models.threshold
    rest = [c for c in pages.columns if c not in ("html", "url", "host", "path", "rule", "verdict", "score")]
    named = ["url", "host", "path", "rule", "verdict"]
    schema = pages.select(*(F.col(f"`{c}`") for c in rest), *(F.lit(None).cast("string").alias(n) for n in named), F.lit(None).cast("double").alias("score")).schema

    def run(batches):
        known = Rules(rules)
        for b in batches:
            urls, score = b.column(len(rest)).to_pylist(), b.column(len(rest) + 1).to_numpy()
            split = [parts(u) for u in urls]
            found = [known.match(*x) for x in split]
            verdicts = [v or ("allow" if s >= threshold else "block") for (_, v), s in zip(found, score)]
            columns = (urls, [h for h, _ in split], [p for _, p in split], [r for r, _ in found], verdicts)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *(pa.array(c, pa.string()) for c in columns), pa.array(score, pa.float64())], names=[*rest, *named, "score"])

    urls = pages.select(*(F.col(f"`{c}`") for c in rest), F.col("url").cast("string").alias("url"))
    return _scored(urls, models).mapInArrow(run, schema)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(pages)).select("page_id", "host", "path", "rule", "verdict")
