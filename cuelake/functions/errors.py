"""Error rates of transcripts: substitutions, insertions and deletions between what was said and what was written.

Of all alignments with the fewest edits those count that have the fewest insertions and deletions, so the three numbers are defined. The edits come from rows of differences between neighbouring
costs, which are bits of whole numbers, so a few operations go through a row of a text. Going back, a match is always taken, and where there is none only steps that cost one edit:
few cells, each with its fewest insertions and deletions. Where those are many, or a text is very long, a band around the diagonal that is as wide as the edits is worked out row by row.
Many pairs of texts are counted side by side: costs of cells in a band, from antidiagonal to antidiagonal, a column for each pair; a pair that its band may not hold goes on with a wider one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cost of an edit; an insertion or a deletion costs one more.
EDIT = 1 << 32
#: Cells of two texts up to which bits are used, bits of each kind that are held, and cells of a way back for each item of the texts.
CELLS, HELD, WAYS = 1 << 30, 1 << 26, 64
#: Side by side: cost of an edit, items of a pair at most (bits are faster for longer ones), costs at a time, pairs below which each is counted by itself, and items that are held.
SHORT_EDIT, SHORT, SIDE, FEW, ITEMS = 1 << 15, 1 << 12, 1 << 15, 16, 1 << 20
#: Blanks, as SQL functions know them.
BLANKS = " \t\n\x0b\f\r"
COUNTS = "struct<n_reference: long, n_hypothesis: long, substitutions: long, insertions: long, deletions: long>"


def _numbers(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    known: dict = {}
    return tuple(np.fromiter((known.setdefault(x, len(known)) for x in s), np.int64, len(s)) for s in (a, b))


def _within(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Least cost of turning ``a`` into ``b`` by alignments that stay within ``band`` of the diagonal."""
    far, step = np.int64(1) << 62, EDIT + 1
    # place k of a row stands for column i + k - band
    k = np.arange(2 * band + 1)
    row = np.where((k >= band) & (k - band <= len(b)), (k - band) * step, far)
    padded = np.concatenate([np.full(band + 1, -1), b, np.full(max(0, len(a) - len(b)) + band + 1, -2)])
    for i in range(1, len(a) + 1):
        j = i + k - band
        differ = padded[i : i + 2 * band + 1] != a[i - 1]  # column j compares b[j - 1]
        here = np.minimum(row + EDIT * differ, np.append(row[1:], far) + step)
        here[(j < 1) | (j > len(b))] = far
        if i <= band:
            here[band - i] = i * step
        row = np.minimum(np.minimum.accumulate(here - k * step) + k * step, far)
        row[(j < 0) | (j > len(b))] = far
    return int(row[len(b) - len(a) + band])


def _steps(a: list, b: list):
    """For each item of ``b``: how the whole cost changes, and bits of the items of ``a``: it is equal; a step down both costs nothing; along ``b`` costs one; along ``a`` costs one."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, len(a) - 1
    down, up = full, 0  # rows at which the cost is one more, or one less, than in the row before
    for x in b:
        same = places.get(x, 0)
        free = (((same & down) + down) ^ down | same | up) & full
        more, less = up | full & ~(free | down), down & free
        along = more << 1 | 1
        down, up = (less << 1 | ~(free | along)) & full, along & free
        yield (more >> top) - (less >> top), same, free, more, down


def _near(steps, edits: int):
    """``steps`` with the first row that so many edits reach, and the bits from there on that they reach."""
    reach = (1 << 2 * edits + 3) - 1
    for j, (change, *bits) in enumerate(steps, 1):
        low = max(0, j - edits - 1)
        yield low, change, *(x >> low & reach for x in bits)


def _fewest_indels(a: list, b: list, steps: list) -> int | None:
    """Insertions and deletions of the alignment with the fewest edits that has the fewest of them; None where very many cells are on such alignments."""
    left = WAYS * (len(a) + len(b))
    here = {len(a): 0}
    for low, _, same, free, along, down in reversed(steps):
        before: dict[int, int] = {}
        rows = sorted(here)
        left -= len(rows)
        while rows:
            i = rows.pop()
            n, bit = here[i], i - 1 - low
            if not i:
                before[0] = min(n + 1, before.get(0, n + 1))
                continue
            if same >> bit & 1:
                before[i - 1] = min(n, before.get(i - 1, n))
                continue
            if not free >> bit & 1:
                before[i - 1] = min(n, before.get(i - 1, n))
            if along >> bit & 1:
                before[i] = min(n + 1, before.get(i, n + 1))
            if down >> bit & 1:
                if i - 1 not in here:
                    rows.append(i - 1)
                    left -= 1
                here[i - 1] = min(n + 1, here.get(i - 1, n + 1))
        here = before
        if left < 0:
            return None
    return min(i + n for i, n in here.items())


def _trimmed(reference: list, hypothesis: list) -> tuple[list, list]:
    """Both without what they begin and end with alike."""
    first, n = 0, min(len(reference), len(hypothesis))
    while first < n and reference[first] == hypothesis[first]:
        first += 1
    last = 0
    while last < n - first and reference[-1 - last] == hypothesis[-1 - last]:
        last += 1
    return reference[first : len(reference) - last], hypothesis[first : len(hypothesis) - last]


def _split(edits: int, indels: int, apart: int) -> tuple[int, int, int]:
    return edits - indels, (indels + apart) // 2, (indels - apart) // 2


def edit_counts(reference: list, hypothesis: list) -> tuple[int, int, int]:
    """(substitutions, insertions, deletions)."""
    x, y = _trimmed(reference, hypothesis)
    apart, most = len(y) - len(x), max(len(x), len(y))
    if not x or not y:
        return 0, max(0, apart), max(0, -apart)
    edits = indels = None
    if len(x) * len(y) <= HELD:
        steps = [(0, *step) for step in _steps(x, y)]
        edits = len(x) + sum(step[1] for step in steps)
        indels = _fewest_indels(x, y, steps)
    elif len(x) * len(y) <= CELLS:
        edits = len(x) + sum(change for change, *_ in _steps(x, y))
        if len(y) * (2 * edits + 3) <= HELD:
            indels = _fewest_indels(x, y, list(_near(_steps(x, y), edits)))
    if indels is None:
        a, b = _numbers(x, y)
        band = edits or max(16, abs(apart))
        while True:
            edits, indels = divmod(_within(a, b, min(band, most)), EDIT)
            if edits <= band or band >= most:
                break
            band *= 2
    return _split(edits, indels, apart)


def _side_by_side(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Least cost of each pair by alignments that stay within ``band`` of the diagonal. Pairs come in falling order of both lengths together; no list is empty."""
    long_a, long_b = (max(len(pair[k]) for pair in pairs) for k in (0, 1))
    a, b = np.full((len(pairs), long_a), SHORT + 1, np.int32), np.full((len(pairs), long_b), SHORT + 2, np.int32)
    for p, (x, y) in enumerate(pairs):
        a[p, long_a - len(x) :] = x[::-1]  # from the last to the first, as along an antidiagonal one goes down where the other goes up
        b[p, : len(y)] = y
    a, b = (np.ascontiguousarray(items.T) * SHORT_EDIT for items in (a, b))
    apart, ends = (np.array([f(len(x), len(y)) for x, y in pairs]) for f in (lambda n, m: m - n, lambda n, m: n + m))
    step = SHORT_EDIT + 1
    # row band + 1 + k has the last cost on the diagonal of columns k ahead, at first that of its edge
    cost = np.full((2 * band + 3, len(pairs)), 1 << 30, np.int32)
    cost[1:-1] = np.abs(np.arange(-band, band + 1, dtype=np.int32))[:, None] * step
    one, two = (np.empty((band + 1, len(pairs)), np.int32) for _ in "ab")
    least = np.zeros(len(pairs), np.int64)
    going = len(pairs)  # pairs that have this antidiagonal
    for s in range(2, int(ends[0]) + 1):
        low, high = max(-band, 2 - s, s - 2 * long_a), min(band, s - 2, 2 * long_b - s)
        low, high = low + (s - low) % 2, high - (s - high) % 2
        if low <= high:
            at, n = band + 1 + low, (high - low) // 2 + 1
            here, t, u = cost[at : at + 2 * n - 1 : 2, :going], one[:n, :going], two[:n, :going]
            first_a, first_b = long_a - (s - low) // 2, (s + low) // 2 - 1
            np.bitwise_xor(a[first_a : first_a + n, :going], b[first_b : first_b + n, :going], out=t)
            np.minimum(t, SHORT_EDIT, out=t)  # nothing where both are equal
            np.add(t, here, out=t)
            np.minimum(cost[at - 1 : at + 2 * n - 2 : 2, :going], cost[at + 1 : at + 2 * n : 2, :going], out=u)
            np.add(u, step, out=u)
            np.minimum(t, u, out=here)
        left = going
        while left and ends[left - 1] == s:
            left -= 1
        least[left:going] = cost[band + 1 + apart[left:going], np.arange(left, going)]
        going = left
    return least


def many_edit_counts(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """``edit_counts`` of pairs of arrays of numbers, which are less than both lengths together."""
    counts: list = [None] * len(pairs)
    todo = []  # (band, pair)
    for p, (x, y) in enumerate(pairs):
        n, m = len(x), len(y)
        if not n or not m:
            counts[p] = _split(abs(m - n), abs(m - n), m - n)
        elif n + m > SHORT:
            counts[p] = edit_counts(x.tolist(), y.tolist())
        else:
            todo.append((min(8 + (n + m) // 16 + abs(m - n), max(n, m)), p))
    while todo:
        todo.sort()
        again, at = [], 0
        while at < len(todo):
            size = 1
            while at + size < len(todo) and (size + 1) * (todo[at + size][0] + 1) <= SIDE:
                size += 1
            group = [p for _, p in todo[at : at + size]]
            band, at = todo[at + size - 1][0], at + size
            group.sort(key=lambda p: -len(pairs[p][0]) - len(pairs[p][1]))
            if len(group) < FEW:
                for p in group:
                    counts[p] = edit_counts(*(x.tolist() for x in pairs[p]))
                continue
            for p, cost in zip(group, _side_by_side([pairs[p] for p in group], band).tolist()):
                n, m = map(len, pairs[p])
                edits, indels = divmod(cost, SHORT_EDIT)
                # leaving the band and coming back takes so many insertions and deletions and two more
                if edits <= 2 * (band + 1) - abs(m - n) or band >= max(n, m):
                    counts[p] = _split(edits, indels, m - n)
                else:
                    again.append((min(2 * band, max(n, m)), p))
        todo = again
    return counts


def _all_counts(pairs: Iterable[tuple[list, list]]) -> list[tuple]:
    """Both lengths and the edits of each pair, some ITEMS at a time."""
    rows, lengths, held, n = [], [], [], 0

    def done() -> None:
        rows.extend((*both, *counts) for both, counts in zip(lengths, many_edit_counts(held)))
        lengths.clear(), held.clear()

    for a, b in pairs:
        x, y = _trimmed(a, b)
        number = {item: k for k, item in enumerate(dict.fromkeys(x + y))}
        lengths.append((len(a), len(b)))
        held.append(tuple(np.fromiter(map(number.__getitem__, items), np.int32, len(items)) for items in (x, y)))
        n += len(x) + len(y)
        if n >= ITEMS:
            done()
            n = 0
    done()
    return rows


def _counted(reference: Column, hypothesis: Column, parts: Callable[[str], list]) -> Column:
    @F.pandas_udf(COUNTS)
    def run(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
        rows = _all_counts((parts(x or ""), parts(y or "")) for x, y in zip(reference, hypothesis))
        return pd.DataFrame(rows, columns=["n_reference", "n_hypothesis", "substitutions", "insertions", "deletions"])

    return run(reference, hypothesis)


def word_counts(reference: Column, hypothesis: Column) -> Column:
    """Struct of the words of both texts and the edits between them. Words are what blanks part; null counts as empty."""
    return _counted(reference, hypothesis, re.compile(f"[^{BLANKS}]+").findall)


def character_counts(reference: Column, hypothesis: Column) -> Column:
    """The same of characters, without blanks."""
    none = dict.fromkeys(map(ord, BLANKS))
    return _counted(reference, hypothesis, lambda t: list(t.translate(none)))


def error_rates(counted: DataFrame, keys: list[str], counts: str = "counts") -> DataFrame:
    """keys, n, edits, n_reference, pooled (all edits over all of the references), macro (the mean of each pair's own rate, of pairs with a reference); null where there is nothing to divide by."""
    c = lambda name: F.col(f"{counts}.{name}")
    edits = c("substitutions") + c("insertions") + c("deletions")
    own = F.when(c("n_reference") > 0, edits / c("n_reference"))
    total = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(edits).alias("edits"), F.sum(c("n_reference")).alias("n_reference"), F.avg(own).alias("macro"))
    return total.select(*keys, "n", "edits", "n_reference", F.try_divide("edits", "n_reference").alias("pooled"), "macro")
