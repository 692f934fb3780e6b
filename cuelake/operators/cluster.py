"""Agglomerative clustering of one recording's vectors by the distance of centroids, with a search for a wanted number of clusters."""

from __future__ import annotations

import heapq

import numpy as np

#: Distance at which merging ends, and members that make a cluster large.
THRESHOLD, LEAST = 0.7046, 12


class Centers:
    """Centers of clusters, with their distances worked out when they are asked for."""

    def __init__(self, x: np.ndarray):
        self.sum, self.size = np.array(x, float), np.ones(len(x))
        self.at, self.square, self.alive = self.sum.copy(), (self.sum**2).sum(axis=1), np.ones(len(x), bool)
        self.most = float(self.square.max(initial=0.0))

    def exact(self, i: int, js: np.ndarray) -> np.ndarray:
        return ((self.at[js] - self.at[i]) ** 2).sum(axis=1)

    def near(self, i: int, first: int) -> np.ndarray:
        """Squared distances of center i from those numbered ``first`` on, roughly; infinite where there is none."""
        d = self.square[first:] + self.square[i] - 2 * (self.at[first:] @ self.at[i])
        d[~self.alive[first:]] = np.inf
        if i >= first:
            d[i - first] = np.inf
        return d

    def slack(self, i: int) -> float:
        """More than rough distances are off; means are no longer than the longest row."""
        return 1e-12 * (self.square[i] + self.most)

    def nearest_after(self, i: int) -> tuple[float, int]:
        """The nearest center with a higher number, the first of several: rough distances leave few, which are compared exactly."""
        d = self.near(i, i + 1)
        if not len(d) or not np.isfinite(low := d.min()):
            return np.inf, -1
        js = i + 1 + np.flatnonzero(d <= low + 2 * self.slack(i))
        own = self.exact(i, js)
        k = int(own.argmin())
        return float(own[k]), int(js[k])

    def join(self, i: int, j: int) -> None:
        self.sum[i] += self.sum[j]
        self.size[i] += self.size[j]
        self.at[i] = self.sum[i] / self.size[i]
        self.square[i] = (self.at[i] ** 2).sum()
        self.alive[j] = False


def linkage(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All merges of the rows of ``x`` in order: (first members of both, their distance, members together); each joins the two nearest centroids, of several
    pairs the one with the lowest numbers.

    Each center knows a bound of the distance to the nearest of those after it, in a heap. What comes up is worked out anew if it no longer holds; a
    merge looks once at all centers, as it can bring the new one closer to those before it. Memory is that of the rows."""
    n, c = len(x), Centers(x)
    merges, distances = np.zeros((max(0, n - 1), 3), int), np.zeros(max(0, n - 1))
    found = [c.nearest_after(i) for i in range(n)]
    bound, near = np.array([d for d, _ in found]), np.array([j for _, j in found], int)
    heap = [(d, i) for i, (d, _) in enumerate(found)]
    heapq.heapify(heap)
    for k in range(n - 1):
        while True:
            d, i = heapq.heappop(heap)
            if not c.alive[i] or d != bound[i]:
                continue  # joined, or a later bound is in the heap
            j = int(near[i])
            if c.alive[j] and d == c.exact(i, near[i : i + 1])[0]:
                break
            bound[i], near[i] = c.nearest_after(i)
            heapq.heappush(heap, (bound[i], i))
        merges[k], distances[k] = (i, j, int(c.size[i] + c.size[j])), np.sqrt(d)
        c.join(i, j)
        before = np.flatnonzero(c.near(i, 0)[:i] <= bound[:i] + c.slack(i))
        for r, own in zip(before.tolist(), c.exact(i, before).tolist()):
            if (own, i) < (bound[r], near[r]):
                bound[r], near[r] = own, i
                heapq.heappush(heap, (own, r))
        bound[i], near[i] = c.nearest_after(i)
        heapq.heappush(heap, (bound[i], i))
    return merges, distances


def labels_after(merges: np.ndarray, n: int, upto: int) -> np.ndarray:
    """The first member of each row's cluster after the first ``upto`` merges."""
    up = np.arange(n)
    for i, j, _ in merges[:upto]:
        up[j] = i
    while (up[up] != up).any():
        up = up[up]
    return up


def agglomerate(x: np.ndarray, wanted: int | None = None, least: int = 1, most: int | None = None, threshold: float = THRESHOLD, least_members: int = LEAST) -> np.ndarray:
    """A cluster for each row, numbered by first appearance. Merging ends at ``threshold``. If that doesn't give ``wanted`` large clusters (or their number isn't
    between ``least`` and ``most``), the number of merges is taken instead that comes nearest to it, those near the threshold first. Small clusters, under the least number
    of members (at most a tenth of all), join the large one whose mean is nearest by cosine; without large ones all are one."""
    n = len(x)
    if n < 2:
        return np.zeros(n, int)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    small = min(least_members, max(1, round(0.1 * n)))
    merges, distances = linkage(x)

    def large(label: np.ndarray) -> np.ndarray:
        known, counts = np.unique(label, return_counts=True)
        return known[counts >= small]

    over = np.flatnonzero(distances > threshold)
    label = labels_after(merges, n, int(over[0]) if len(over) else n - 1)
    found = len(large(label))
    if found < least:
        wanted = least
    elif most is not None and found > most:
        wanted = most
    if wanted is not None and found != wanted:
        best, best_found = n - 1, 1
        for k in np.argsort(np.abs(distances - threshold), kind="stable").tolist():
            if merges[k, 2] < small:
                continue
            label = labels_after(merges, n, k + 1)
            found = len(large(label))
            if abs(found - wanted) < abs(best_found - wanted):
                best, best_found = k, found
            if found == wanted:
                break
        if best_found != wanted:
            label = labels_after(merges, n, best + 1)
    keep = large(label)
    if not len(keep):
        return np.zeros(n, int)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    centers = np.stack([unit(x[label == c].mean(axis=0)) for c in keep])
    for c in np.setdiff1d(label, keep):
        own = label == c
        label = np.where(own, keep[int((centers @ unit(x[own].mean(axis=0))).argmax())], label)
    _, first, back = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[back]
