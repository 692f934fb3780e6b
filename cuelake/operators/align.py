"""Repair of aligned timestamps, and the alignment of cleaned tokens with their text."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .rows import batches_of


def fix_timestamps(values: list[int]) -> list[int]:
    """The longest non-decreasing run of values is kept; the rest is repaired from its kept neighbours: one or two outliers take the
    nearer neighbour's value (the left one's in a tie), more are spread evenly between both."""
    v = np.asarray(values, float)
    n = len(v)
    if not n:
        return []
    # a tree of (longest run, less its place) by value, so that the longest run that ends at a value or below is found in log n steps
    rank = np.unique(v, return_inverse=True)[1].tolist()
    best, size = [(0, 0)] * (max(rank) + 2), max(rank) + 2
    length, parent = np.ones(n, int), np.full(n, -1)
    for i, r in enumerate(rank):
        k, found = r + 1, (0, 0)
        while k:
            found = max(found, best[k])
            k &= k - 1
        if found[0]:
            length[i], parent[i] = found[0] + 1, -found[1]
        k, own = r + 1, (int(length[i]), -i)
        while k < size:
            best[k] = max(best[k], own)
            k += k & -k
    kept = []
    i = int(length.argmax())
    while i >= 0:
        kept.append(i)
        i = int(parent[i])
    kept = kept[::-1]
    out = v.copy()
    out[: kept[0]], out[kept[-1] + 1 :] = v[kept[0]], v[kept[-1]]
    for a, b in zip(kept, kept[1:]):
        missing = b - a - 1
        for k in range(1, missing + 1):
            if missing <= 2:
                out[a + k] = v[a] if k <= missing + 1 - k else v[b]
            else:
                out[a + k] = int(v[a] + (v[b] - v[a]) / (missing + 1) * k)
    return [int(x) for x in out]


def kept(c: str) -> bool:
    return c == "'" or unicodedata.category(c)[0] in "LN"


def match_at(text: str, token: str, first: int) -> int | None:
    """Where the token ends if it begins at ``first``, with nothing but signs between its characters."""
    at, i = first, 0
    while at < len(text) and i < len(token):
        if text[at] == token[i]:
            i += 1
        elif at == first or kept(text[at]):
            return None
        at += 1
    return at if i == len(token) else None


def locate(text: str, token: str, start: int) -> tuple[int, int] | None:
    """The first span from ``start`` that holds the token's characters in a row, but for signs between them."""
    for first in range(start, len(text) if token else 0):
        if text[first] == token[0] and (end := match_at(text, token, first)) is not None:
            return first, end
    return None


class Places:
    """Where tokens stand in a text, found by an index of its kept characters' runs of up to three, and not by reading on from each start.

    A token's kept characters stand side by side among the text's kept ones. Of its runs the rarest gives the places to look at. A token that isn't found
    is not looked for again, as starts never fall."""

    RUN = 3

    def __init__(self, text: str):
        known: dict[str, bool] = {}
        self.text = text
        self.at = [i for i, c in enumerate(text) if (known[c] if c in known else known.setdefault(c, kept(c)))]
        self.kept, self.known = "".join([text[i] for i in self.at]), known
        self.runs: dict[int, dict[str, list[int]]] = {}
        self.gone: set[str] = set()

    def _run(self, size: int) -> dict[str, list[int]]:
        if size not in self.runs:
            places: dict[str, list[int]] = {}
            for i in range(len(self.kept) - size + 1):
                places.setdefault(self.kept[i : i + size], []).append(i)
            self.runs[size] = places
        return self.runs[size]

    def find(self, token: str, start: int) -> tuple[int, int] | None:
        """What ``locate`` finds; ``start`` must not fall from one call to the next."""
        if token in self.gone or not token:
            return None
        found = self._find(token, start)
        if found is None:
            self.gone.add(token)
        return found

    def _find(self, token: str, start: int) -> tuple[int, int] | None:
        if not kept(token[0]):  # a sign can stand anywhere
            return locate(self.text, token, start)
        bare = "".join(c for c in token if self.known.get(c, False) or kept(c))
        size = min(self.RUN, len(bare))
        runs = self._run(size)
        parts = [(len(places), off, places) for off in range(len(bare) - size + 1) if (places := runs.get(bare[off : off + size]))]
        if len(parts) < len(bare) - size + 1:
            return None
        _, off, places = min(parts)
        first = bisect_left(self.at, start)
        for p in places[bisect_left(places, first + off) :]:
            k = p - off
            if self.kept.startswith(bare, k):
                if bare == token:
                    return self.at[k], self.at[k + len(bare) - 1] + 1
                end = match_at(self.text, token, self.at[k])
                if end is not None:
                    return self.at[k], end
        return None


def reconcile(text: str, items: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Items (token, start, end) with what the text has between them put back as items without length."""
    if not items:
        return [(text, 0, 0)] if text else []
    places, out, at, last = Places(text), [], 0, items[0][1]
    for token, start, end in items:
        span = places.find(token, at)
        if span:
            if span[0] > at:
                out.append((text[at : span[0]], last, last))
            out.append((text[span[0] : span[1]], start, end))
            at = span[1]
        else:
            out.append((token, start, end))
        last = end
    if at < len(text):
        out.append((text[at:], last, last))
    return out


def reconciled(texts: DataFrame, keys: list[str], timed: Callable[[list], list[tuple[str, int, int]]], text: str = "text", tokens: str = "tokens") -> DataFrame:
    """keys, k (from 1), text, start_ms, end_ms: the items of each text by ``reconcile``, of its tokens with the times that ``timed`` gives them. A task holds one text's
    items and a few thousand rows, however many texts come in a batch."""
    numbers = [StructField(name, LongType()) for name in ("start_ms", "end_ms")]
    schema = StructType([*(texts.schema[c] for c in keys), StructField("k", LongType()), StructField("text", StringType()), *numbers])

    def run(batches) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for i in range(b.num_rows):
                    *key, t, found = (c[i].as_py() for c in b.columns)
                    for k, item in enumerate(reconcile(t, timed(found)), 1):
                        yield *key, k, *item

        yield from batches_of(rows(), schema)

    return texts.select(*keys, text, tokens).mapInArrow(run, schema).withColumn("k", F.col("k").cast("int"))
