"""Benchmark decontamination by BM25 retrieval with block-max WAND.

The test items are indexed, items over ``ENTRY`` words in segments, which are the index's entries. Every training text is cut into passages
of ``2 * ENTRY`` words with a step of ``ENTRY``, so that each run of up to ``ENTRY`` words is whole in some passage. Each passage is a query;
an entry is retrieved if its BM25 score is at least ``THRESHOLD`` of what it scores against itself. Term weights
use the passage frequencies of the index's terms over all training texts (a first pass; its result has one row for
each term of the index).

Retrieval is block-max WAND for every passage, and exact. Its lists are those of the essential terms: frequent terms of little weight are set
aside, as long as they can't add more than ``ASIDE`` of the threshold to any entry, and the lists need only reach the rest. The first
choice of a pivot is made for all passages of a batch at once; most passages have none, which ends their search. An entry that is
retrieved scores with all terms.

What is retrieved is verified against the item itself: at least ``OVERLAP`` of the three-word runs of its question
(its first part) and of its answer (its last sentence, or last third) must be there: in the passage if the item is one entry; else
in the words around the passage, as many on each side as the item has. So part of a long item without its answer is no leak.

Entries are numbered, and an index takes ``INDEX`` of them (and the whole of an item whose entries it shares). Indexes are searched one after the
other, each in one pass whose result is written, so the driver and a task hold one index at a time, whatever the size of
the benchmark.

Null or empty texts and items match nothing; texts of any length are searched whole. Rows with a null doc_id are searched too; repeated
rows give repeated results; a null item_id stays null, and rows of the benchmark that repeat an item_id are items of their own. Of passages of equal score the first is
reported. An empty table on either side gives no hits. ``filter_documents`` keeps all columns, whatever their names; ``find`` ignores all but doc_id and text.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, only_cache, read

ENTRY, THRESHOLD, OVERLAP, INDEX, BLOCK = 64, 0.6, 0.5, 20_000, 16
#: Share of the threshold that the terms set aside may add to an entry.
ASIDE = 0.5
K1, B = 1.2, 0.75
#: What the essential terms of an entry that is retrieved give at least.
LOW = THRESHOLD * (1 - ASIDE) - 1e-9
#: ASCII letters (lower-cased), digits and all bytes beyond ASCII make words; other bytes part them.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_PARTS).split() if text else []


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of the item's question and answer: the last sentence answers, if it has four words and at most half of all."""
    all_words = words(text)
    for m in reversed(list(re.finditer(r"[.!?\n]\s+", text))):
        tail = words(text[m.end() :])
        if len(tail) >= 4:
            if 2 * len(tail) <= len(all_words):
                return all_words[: -len(tail)], tail
            break
    k = max(1, len(all_words) // 3)
    return all_words[:-k], all_words[-k:]


def entries(n_words: int) -> int:
    return -(-n_words // ENTRY)


def runs(ids: list[int], n: int = 3) -> set:
    return {tuple(ids[i : i + n]) for i in range(max(1, len(ids) - n + 1))} if ids else set()


class Index:
    """Inverted index of entries ``low`` to ``high`` (without it) of the items (item_id, text, number of its first entry); ``weigh`` makes the weights."""

    def __init__(self, items: list[tuple], low: int = 0, high: float = float("inf")):
        self.terms: dict[bytes, int] = {}
        self.item: list[int] = []  # of each entry, its item's number
        self.entries: list[list[int]] = []
        self.item_id: list[int | None] = []
        self.parts: list[tuple[set, set]] = []  # of each item, the runs of question and answer
        self.reach: list[int] = []  # of each item, the words beside a passage that may hold the rest
        first = 0
        for item_id, text, *at in items:
            first = at[0] if at else first
            question, answer = question_answer(text or "")
            ids = [self.terms.setdefault(w, len(self.terms)) for w in question + answer]
            n = entries(len(ids))
            for k in range(n):
                if low <= first + k < high:
                    self.item.append(len(self.item_id))
                    self.entries.append(ids[k * len(ids) // n : (k + 1) * len(ids) // n])
            first += n
            self.item_id.append(item_id)
            self.parts.append((runs(ids[: len(question)]), runs(ids[len(question) :])))
            self.reach.append(len(ids) if n > 1 else 0)

    def weigh(self, frequency: np.ndarray, passages: int) -> None:
        """``frequency``: of each term, the passages that have it."""
        idf = np.log(1 + (passages - frequency + 0.5) / (frequency + 0.5)) + 1e-6
        mean = sum(map(len, self.entries)) / max(1, len(self.entries))
        postings = defaultdict(list)
        self.weight: list[dict[int, float]] = []  # of each entry, by term
        for e, ids in enumerate(self.entries):
            terms, counts = np.unique(ids, return_counts=True)
            w = idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(ids) / mean))
            self.weight.append(dict(zip(terms.tolist(), (w / w.sum()).tolist())))
            for t, x in self.weight[-1].items():
                postings[t].append((e, x))
        docs = [[e for e, _ in postings[t]] for t in range(len(self.terms))]
        weights = [[x for _, x in postings[t]] for t in range(len(self.terms))]
        aside, room = np.zeros(len(self.terms) + 1, bool), np.full(len(self.entries), ASIDE * THRESHOLD)
        for t in np.argsort(-frequency, kind="stable").tolist():
            d, w = docs[t], np.array(weights[t])
            if (room[d] >= w).all():
                room[d] -= w
                aside[t] = True
        self.added = (ASIDE * THRESHOLD - room).tolist()  # at most, by the terms set aside, to each entry
        # the lists of the essential terms; what is empty needs no list. The last place is for unknown words
        self.docs = [[] if aside[t] else docs[t] for t in range(len(self.terms))]
        self.weights = [[] if aside[t] else weights[t] for t in range(len(self.terms))]
        self.block_max = [[max(w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)] for w in self.weights]
        self.most = [max(w, default=0.0) for w in self.weights]
        self.most_of = np.array([*self.most, 0.0])

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Term ids of all words of all texts (-1: not in the index), and where each text starts."""
        found = [words(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in found])]).astype(np.int64)
        flat = np.fromiter(map(self.terms.get, itertools.chain.from_iterable(found), itertools.repeat(-1)), np.int64, int(starts[-1]))
        return flat, starts

    @staticmethod
    def passages(starts: np.ndarray):
        """For each word the passages that have it (-1: none), and how many passages each text has."""
        lengths = np.diff(starts)
        n = np.maximum(1, -(-lengths // ENTRY) - 1)
        base = np.concatenate([[0], np.cumsum(n)])
        text = np.repeat(np.arange(len(lengths)), lengths)
        k = (np.arange(starts[-1]) - starts[:-1][text]) // ENTRY
        return np.where(k < n[text], base[text] + k, -1), np.where(k > 0, base[text] + k - 1, -1), n, base

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, int]:
        flat, starts = self.ids(texts)
        p1, p2, n, _ = self.passages(starts)
        known = flat >= 0
        keys = pd.unique(np.concatenate([p[known & (p >= 0)] * len(self.terms) + flat[known & (p >= 0)] for p in (p1, p2)]))
        return np.bincount(keys % max(1, len(self.terms)), minlength=len(self.terms)), int(n.sum())

    def reaching(self, flat: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """Passages for which the first choice of a pivot finds one: the most that all their lists can give reaches the threshold."""
        at = np.flatnonzero(self.most_of[flat] > 0)
        size = len(self.terms) + 1
        keys = pd.unique(np.concatenate([p[at][p[at] >= 0] * size + flat[at][p[at] >= 0] for p in (p1, p2)]))
        passage = keys // size
        found, back = np.unique(passage, return_inverse=True)
        return found[np.bincount(back, self.most_of[keys % size], len(found)) >= LOW]

    def wand(self, query: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: (entry, score) of all entries whose score reaches the threshold. ``query``: distinct terms."""
        low, terms = LOW, set(query)
        lists = [[self.docs[t][0], 0, t] for t in query if self.docs[t]]  # current entry, place, term
        docs, weights, block_max, most = self.docs, self.weights, self.block_max, self.most
        out = []

        def advance(x: list, to: int) -> bool:
            d, i = docs[x[2]], x[1]
            while i < len(d) and d[i] < to:
                # a block whose last entry is too low is left at once
                i = (i // BLOCK + 1) * BLOCK if d[min((i // BLOCK + 1) * BLOCK, len(d)) - 1] < to else i + 1
            x[1] = i
            if i >= len(d):
                return False
            x[0] = d[i]
            return True

        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += most[x[2]]
                if total >= low:
                    pivot = k
                    break
            if pivot < 0:
                break
            entry = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == entry:
                pivot += 1
            bound, ends = 0.0, []
            for x in lists[: pivot + 1]:
                d, i = docs[x[2]], x[1]
                while i < len(d) and d[min((i // BLOCK + 1) * BLOCK, len(d)) - 1] < entry:
                    i = (i // BLOCK + 1) * BLOCK
                if i < len(d):
                    bound += block_max[x[2]][i // BLOCK]
                    ends.append(d[min((i // BLOCK + 1) * BLOCK, len(d)) - 1])
            if bound < low:
                to = min([e + 1 for e in ends] + [x[0] for x in lists[pivot + 1 : pivot + 2]], default=entry + 1)
                to = max(to, entry + 1)
                lists = [x for k, x in enumerate(lists) if k > pivot or advance(x, to)]
            elif lists[0][0] == entry:
                score = sum(weights[x[2]][x[1]] for x in lists[: pivot + 1])
                if score + self.added[entry] >= THRESHOLD - 1e-9:  # else the terms set aside can't make up for the rest
                    score = sum(w for t, w in self.weight[entry].items() if t in terms)
                    if score >= THRESHOLD - 1e-9:
                        out.append((entry, score))
                lists = [x for k, x in enumerate(lists) if k > pivot or advance(x, entry + 1)]
            else:
                lists = [x for k, x in enumerate(lists) if k > pivot or advance(x, entry)]
        return out

    def around(self, ids: list[int], item: int, places: list[int]) -> Iterator[tuple[float, float]]:
        """Overlaps of a long item's question and answer with the words around the passages at ``places`` (ascending) of a text; one pass over the text."""
        parts, reach = self.parts[item], self.reach[item]
        at = [(i, r) for i, r in enumerate(zip(ids, ids[1:], ids[2:])) if r in parts[0] or r in parts[1]]
        inside: Counter = Counter()
        low = high = 0
        shared = [0, 0]
        for start in places:
            while high < len(at) and at[high][0] + 3 <= start + 2 * ENTRY + reach:
                run = at[high][1]
                inside[run] += 1
                if inside[run] == 1:
                    shared = [n + (run in part) for n, part in zip(shared, parts)]
                high += 1
            while low < high and at[low][0] < start - reach:
                run = at[low][1]
                inside[run] -= 1
                if not inside[run]:
                    shared = [n - (run in part) for n, part in zip(shared, parts)]
                low += 1
            yield tuple(n / len(part) if part else 1.0 for n, part in zip(shared, parts))

    def hits(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text (item_id, first word of the passage, score, question's and answer's overlap), the best passage of each item."""
        out: list[list] = [[] for _ in texts]
        if not self.entries:
            return out
        flat, starts = self.ids(texts)
        p1, p2, n, base = self.passages(starts)
        best: dict[tuple[int, int], tuple] = {}

        def verified(text: int, item: int, start: int, score: float, question: float, answer: float) -> None:
            if question >= OVERLAP and answer >= OVERLAP:
                key, row = (text, item), (start, score, question, answer)
                if key not in best or row[1:] > best[key][1:]:
                    best[key] = row

        wide: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for p in self.reaching(flat, p1, p2).tolist():
            text = int(np.searchsorted(base, p, "right")) - 1
            start = int(p - base[text]) * ENTRY
            ids = flat[starts[text] + start : min(starts[text] + start + 2 * ENTRY, starts[text + 1])].tolist()
            seen = None
            for e, score in self.wand(sorted({i for i in ids if i >= 0})):
                item = self.item[e]
                if self.reach[item]:
                    wide.setdefault((text, item), []).append((start, score))
                else:
                    seen = seen or (runs(ids) | runs(ids, 1) | runs(ids, 2))
                    verified(text, item, start, score, *(len(part & seen) / len(part) if part else 1.0 for part in self.parts[item]))
        for (text, item), found in wide.items():
            for (start, score), overlaps in zip(found, self.around(flat[starts[text] : starts[text + 1]].tolist(), item, [x for x, _ in found])):
                verified(text, item, start, score, *overlaps)
        for (text, item), row in sorted(best.items()):
            out[text].append((self.item_id[item], *row))
        return out


def numbered(benchmark: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The items (item_id, text, part, first entry in its part, entries) as a written table, the first entries' offset by part, and how many entries there are."""

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = [entries(len(words(t))) for t in b.column(1).to_pylist()]
            first = np.cumsum([at, *n])
            at = int(first[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(n), pa.int32()), pa.array(first[:-1], pa.int64()), pa.array(n, pa.int64())], names=["item_id", "text", "part", "first", "n"])

    items = scratch.save(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, text string, part int, first long, n long"), "items")
    total, offset = 0, {}
    for r in sorted(items.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        offset[r["part"]], total = total, total + r["n"]
    at = spark_map(offset)[F.col("part")] if offset else F.lit(0)
    return items.withColumn("first", F.col("first") + at), total


def spark_map(values: dict):
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def indexes(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> Iterator[Index]:
    """The weighed indexes of ``benchmark`` (item_id, text) against the texts of ``docs``, one after the other."""
    items, total = numbered(benchmark, scratch)
    spark = docs.sparkSession
    for low in range(0, total, INDEX):
        part = items.where((F.col("first") < low + INDEX) & (F.col("first") + F.col("n") > low))
        index = Index([tuple(r) for r in part.select("item_id", "text", "first").orderBy("first").collect()], low, low + INDEX)
        shared = spark.sparkContext.broadcast(index)

        def count(batches, shared=shared):
            only_cache("decontamination")
            counts, n = np.zeros(len(shared.value.terms), np.int64), 0
            for b in batches:
                c, m = shared.value.counts(b.column(0).to_pylist())
                counts, n = counts + c, n + m
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"term": pa.array([-1, *at.tolist()], pa.int32()), "n": pa.array([n, *counts[at].tolist()], pa.int64())})

        got = docs.select(F.col("text").cast("string")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        shared.unpersist()
        frequency, passages = np.zeros(len(index.terms)), 0
        for t, n in zip(got["term"].to_pylist(), got["n"].to_pylist()):
            if t < 0:
                passages = n
            else:
                frequency[t] = n
        index.weigh(frequency, passages)
        yield index


def find(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, item_id, passage (its first word), score, question_overlap, answer_overlap of every leak."""
    spark, scratch = docs.sparkSession, scratch or Scratch(docs.sparkSession, "decontamination")
    schema = "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double"
    names, types = [x.split()[0] for x in schema.split(", ")], [pa.int64()] * 3 + [pa.float64()] * 3
    out = spark.createDataFrame([], schema)
    for k, index in enumerate(indexes(docs, benchmark, scratch)):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                rows = [(d, *h) for d, hits in zip(b.column(0).to_pylist(), shared.value.hits(b.column(1).to_pylist())) for h in hits]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=names)

        out = out.unionByName(scratch.save(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema), f"hits{k}"))
        shared.unpersist()
    return out


def filter_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak; written after each index."""
    scratch, at = Scratch(docs.sparkSession, "decontamination-filter"), docs.columns.index("text")
    left = docs
    for k, index in enumerate(indexes(docs, benchmark, scratch)):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                yield b.filter(pa.array([not x for x in shared.value.hits(b.column(at).cast(pa.string()).to_pylist())], pa.bool_()))

        left = scratch.save(left.mapInArrow(run, docs.schema), f"left{k}")
        shared.unpersist()
        scratch.drop(f"left{k - 1}")
    return left


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
