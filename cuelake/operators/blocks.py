"""Recordings as tables of blocks: what needs neighbouring samples gets them as halos, so no task holds a whole recording.

A block table has rec_id, block (from 0) and samples (array of numbers): ``size`` samples in each block but a recording's last, which has 1 to ``size``. Rows
may come in any order. Samples are mono. A recording without samples has one block without any, or no block; then it has no row in the results
(``quiet_splits`` gives the one empty chunk).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import audio


def halo(blocks: DataFrame, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """rec_id, block, samples, before, after: each block with the samples that stand before and after it, as far as there are any.

    One shuffle by recording and block; a block is sent once, its ends to the blocks that want them."""
    ends = [(F.lit(0), F.lit(0), F.col("samples"))]
    for k in range(1, -(-after // size) + 1):
        ends.append((F.lit(-k), F.lit(k), F.slice("samples", 1, min(size, after - (k - 1) * size))))
    for k in range(1, -(-before // size) + 1):
        n = min(size, before - (k - 1) * size)
        ends.append((F.lit(k), F.lit(-k), F.slice("samples", F.greatest(F.size("samples") - n + 1, F.lit(1)), n)))
    sent = blocks.select("rec_id", F.explode(F.array(*(F.struct((F.col("block") + to).alias("block"), part.alias("part"), x.alias("x")) for to, part, x in ends))).alias("s"))
    met = sent.groupBy("rec_id", F.col("s.block").alias("block")).agg(F.sort_array(F.collect_list(F.struct("s.part", "s.x"))).alias("parts"))
    met = met.where(F.exists("parts", lambda p: p["part"] == 0))
    side = lambda keep: F.flatten(F.transform(F.filter("parts", keep), lambda p: p["x"]))
    return met.select("rec_id", "block", side(lambda p: p["part"] == 0).alias("samples"), side(lambda p: p["part"] < 0).alias("before"), side(lambda p: p["part"] > 0).alias("after"))


def _numbers(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column without copies of single numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


# ---- quiet points


class Cell:
    """What a stretch of window starts tells about its quietest windows, however much of it is asked.

    A window's level is the sum of its samples' magnitudes, and its cut the place of its quietest sample; ties go to the first. ``pieces`` has the windows
    that no later one of the cell undercuts: (level, first, last, cut, moves), of neighbours with one level, which have one cut, or cuts that move with
    them. ``steps`` has the windows that undercut all earlier ones: (level, at, cut)."""

    def __init__(self, levels: np.ndarray, cuts: np.ndarray, first: int):
        at = first + np.arange(len(levels))
        cuts = cuts + first
        lowest = np.minimum.accumulate(levels)
        step = np.concatenate([[True], levels[1:] < lowest[:-1]])
        self.steps = np.stack([levels[step], at[step], cuts[step]], axis=1)
        last = np.flatnonzero(levels == np.minimum.accumulate(levels[::-1])[::-1])
        level, t, cut = levels[last], at[last], cuts[last]
        beside = (t[1:] == t[:-1] + 1) & (level[1:] == level[:-1])
        start = np.flatnonzero(np.concatenate([[True], ~(beside & (cut[1:] == cut[:-1]))]))  # pieces with one cut
        end = np.append(start[1:], len(t)) - 1
        single = start == end
        moves = np.concatenate([[False], single[1:] & single[:-1] & beside[end[:-1]] & (cut[start[1:]] - t[start[1:]] == cut[start[:-1]] - t[start[:-1]])])
        head = np.flatnonzero(~moves)
        tail = np.append(head[1:], len(start)) - 1
        self.pieces = np.stack([level[start[head]], t[start[head]], t[end[tail]], cut[start[head]], (tail > head).astype(np.int64)], axis=1)


def quietest(cells: list[tuple[np.ndarray, np.ndarray]], lo: int, hi: int) -> int:
    """Cut of the first of the quietest windows that start from ``lo`` to ``hi``, in consecutive cells (pieces, steps) of which the first has
    ``lo`` and the last ``hi``; a single one ends with ``hi``."""
    pieces, _ = cells[0]
    level, first, _, cut, moves = pieces[np.searchsorted(pieces[:, 2], lo)].tolist()
    best = (level, cut + (max(lo - first, 0) if moves else 0))
    for k, (_, steps) in enumerate(cells[1:], 2):
        i = -1 if k < len(cells) else int(np.searchsorted(steps[:, 1], hi, side="right")) - 1
        if steps[i, 0] < best[0]:
            best = (int(steps[i, 0]), int(steps[i, 2]))
    return best[1]


def quiet_splits(blocks: DataFrame, size: int, rate: int, most_s: float, around_s: float = 5.0, window_s: float = 0.1, least_s: float = 0.5) -> DataFrame:
    """rec_id, chunk (from 0), start, end (samples), length (with the silence that fills up a chunk of under ``least_s``) of chunks of about ``most_s``.

    Each cut is at the quietest sample of the quietest window that lies within ``around_s`` of where the chunk would be full; nothing is lost. Blocks
    are reduced to a few numbers for each cell of half such a range, side by side. A cut hangs on the one before, so those few numbers alone are
    gone through in order, one recording after the other, with the cells of one range in memory. ``around_s`` has to be ``window_s`` or more,
    and ``most_s`` longer than ``window_s``."""
    most, around, width = int(most_s * rate), int(around_s * rate), max(4, int(window_s * rate))
    if around < width or most <= width:
        raise ValueError("the range around a cut, and a chunk, have to be longer than a window")
    ahead = max(1, most - around)
    cell = max(1, min(size, (most + around - ahead - width + 1) // 2))

    def summaries(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                yield pa.RecordBatch.from_arrays([*_summary(part, size, width, cell)], names=["rec_id", "first", "n", "pieces", "steps"])

    kind = blocks.schema["rec_id"].dataType.simpleString()
    cells = halo(blocks, size, after=width - 1).select("rec_id", F.col("block").cast("long").alias("block"), "samples", "after")
    cells = cells.mapInArrow(summaries, f"rec_id {kind}, first long, n long, pieces binary, steps binary")
    cells = cells.repartition("rec_id").sortWithinPartitions("rec_id", "first")
    return cells.mapInArrow(lambda batches: _chains(batches, most, around, width, ahead, int(least_s * rate)), f"rec_id {kind}, chunk int, start long, end long, length long")


def _summary(b: pa.RecordBatch, size: int, width: int, cell: int) -> tuple[pa.Array, ...]:
    whose, first, n, pieces, steps = [], [], [], [], []
    for row, (block, x, after) in enumerate(zip(b.column(1).to_pylist(), _numbers(b.column(2)), _numbers(b.column(3)))):
        both = np.concatenate([x, after])
        levels, cuts = audio.levels_and_cuts(both, width) if len(both) >= width else (np.zeros(0, np.int64),) * 2
        levels, cuts = levels[: len(x)], cuts[: len(x)]
        for at in range(0, max(1, len(x)), cell):
            whose.append(row)
            first.append(block * size + at)
            n.append(min(cell, len(x) - at))
            own = levels[at : at + cell]
            c = Cell(own, cuts[at : at + cell] - at, block * size + at) if len(own) else None
            pieces.append(c.pieces.astype("<i8").tobytes() if c else b"")
            steps.append(c.steps.astype("<i8").tobytes() if c else b"")
    return b.column(0).take(pa.array(whose, pa.int64())), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(pieces, pa.binary()), pa.array(steps, pa.binary())


def _chains(batches, most: int, around: int, width: int, ahead: int, least: int) -> Iterator[pa.RecordBatch]:
    """Cuts of one recording after the other, from its cells in order."""
    none = object()
    rec, total, start, chunk, held, out = none, 0, 0, 0, deque(), []  # held: (first, n, pieces, steps)

    def cut() -> None:
        nonlocal start, chunk
        lo, hi = start + ahead, min(total, start + most + around) - width
        while held and held[0][0] + held[0][1] <= lo:
            held.popleft()
        own = [(p, s) for f, _, p, s in held if f <= hi and len(s)]
        at = max(quietest(own, lo, hi), start + 1)
        out.append((rec, chunk, start, at))
        start, chunk = at, chunk + 1

    def ended() -> None:
        if rec is not none:
            while total - start > most:
                cut()
            out.append((rec, chunk, start, total))

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * 4
        length = [max(e - s, least) for _, _, s, e in out]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field(0).type), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in (*columns[2:], length))], names=["rec_id", "chunk", "start", "end", "length"])

    b = None
    for b in batches:
        for key, first, n, pieces, steps in zip(*(c.to_pylist() for c in b.columns)):
            if rec is none or key != rec:
                ended()
                rec, total, start, chunk, held = key, 0, 0, 0, deque()
            held.append((first, n, np.frombuffer(pieces, "<i8").reshape(-1, 5), np.frombuffer(steps, "<i8").reshape(-1, 3)))
            total = first + n
            while total >= start + most + around:  # all windows of the range are in
                cut()
        yield rows(b)
        out.clear()
    ended()
    if out:
        yield rows(b)


def chunk_samples(blocks: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """rec_id, chunk, part (from 0), samples: the chunks' samples in parts of a block at most, joined by recording and block."""
    wanted = chunks.where("end > start").select("rec_id", "chunk", "start", "end", F.posexplode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("part", "block"))
    joined = wanted.join(blocks.select("rec_id", F.col("block").cast("long").alias("block"), "samples"), ["rec_id", "block"])
    lo = F.greatest(F.col("start") - F.col("block") * size, F.lit(0))
    hi = F.least(F.col("end") - F.col("block") * size, F.lit(size))
    return joined.select("rec_id", "chunk", "part", F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("samples"))


# ---- spectra


def _frames(x: np.ndarray, first: int, block_end: int, width: int, step: int) -> tuple[int, np.ndarray]:
    """Number of the first frame that begins in the block, and the frames of the block; ``x`` begins with sample ``first`` of the recording, which is
    no later than that frame, and has all samples that its frames cover."""
    k, last = -(-first // step), -(-block_end // step)  # frames k to last - 1 begin in it
    rows = max(0, min(last - k, (len(x) - (k * step - first) - width) // step + 1)) if len(x) >= k * step - first + width else 0
    if not rows:
        return k, np.zeros((0, width))
    return k, np.lib.stride_tricks.sliding_window_view(x[k * step - first :], width)[: rows * step : step][:rows]


def log_filter_bank(blocks: DataFrame, size: int, rate: int = 16_000, n_mels: int = 80, width: int = 400, step: int = 160, n_fft: int = 512) -> DataFrame:
    """rec_id, block, first_frame, n_frames, energies (array of n_frames * n_mels, frame by frame): logarithms of filter-bank energies, of the frames that begin in the
    block; and their totals (by filter) and top, for what follows. ``centred`` takes each recording's mean off. A recording shorter than a frame is filled up with zeros to one."""
    filters = audio.mel_filters(n_mels, n_fft, rate).T

    def run(block: int, x: np.ndarray, _before: np.ndarray, after: np.ndarray) -> tuple[int, np.ndarray, float | None]:
        first, whole = block * size, np.concatenate([x, after])
        if block == 0 and len(whole) < width:
            whole = np.pad(whole, (0, width - len(whole)))
        k, frames = _frames(whole, first, first + len(x), width, step)
        out = np.log(np.maximum(audio.frame_power(frames, n_fft) @ filters, np.finfo(np.float32).eps))
        return k, out, float(out.max()) if out.size else None

    return _by_block(halo(blocks, size, after=width - 1), run)


def centred(spectra: DataFrame) -> DataFrame:
    """Filter-bank energies less their mean over the recording, for each filter. Blocks bring their totals, which are added up by recording and filter."""
    spectra = spectra.where("n_frames > 0")
    each = spectra.select("rec_id", "n_frames", F.posexplode("totals").alias("mel", "v")).groupBy("rec_id", "mel")
    mean = each.agg((F.sum("v") / F.sum("n_frames")).alias("mean"))
    means = mean.groupBy("rec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("mel", "mean"))), lambda x: x["mean"]).alias("means"))
    less = F.transform("energies", lambda v, i: v - F.get("means", i % F.size("means")))
    return spectra.join(means, "rec_id").select("rec_id", "block", "first_frame", "n_frames", less.alias("energies"))


def log_mel_power(blocks: DataFrame, size: int, rate: int = 16_000, n_mels: int = 128, n_fft: int = 400, step: int = 160) -> DataFrame:
    """rec_id, block, first_frame, n_frames, energies (array of n_frames * n_mels, frame by frame): logarithms to base 10 of mel power, of the frames whose middle is in the
    block; and their totals (by filter) and top, for what follows.

    Frames stand around every ``step``-th sample; the signal is mirrored at both ends. ``floored`` finishes the spectrum."""
    filters, half = audio.slaney_filters(n_mels, n_fft, rate).T, n_fft // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)

    def run(block: int, x: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[int, np.ndarray, float | None]:
        first, whole = block * size - len(before), np.concatenate([before, x, after])
        ends = len(after) < half  # the recording's end is known then
        if first == 0 and ends and len(whole) <= half:
            whole = np.pad(whole, (0, half + 1 - len(whole)))
        total = first + len(whole) if ends else None
        if ends:
            whole = np.pad(whole, (0, half), mode="reflect")
        if first == 0:
            whole = np.concatenate([whole[half:0:-1], whole])
            first = -half
        begin, end = block * size, block * size + len(x)
        if total is not None and not len(after):
            end = total + 1  # a frame around the very end counts for the loudest, though it is left out
        k, last = -(-begin // step), -(-end // step)
        if last <= k:
            return k, np.zeros((0, n_mels)), None
        at = k * step - half - first
        frames = np.lib.stride_tricks.sliding_window_view(whole[at:], n_fft)[: (last - k) * step : step]
        out = np.log10(np.maximum(np.abs(np.fft.rfft(frames * window)) ** 2 @ filters, 1e-10))
        return k, out if total is None else out[: max(0, total // step - k)], float(out.max())

    return _by_block(halo(blocks, size, before=2 * half, after=half), run)


def floored(spectra: DataFrame) -> DataFrame:
    """Log mel spectrum: eight powers of ten under the recording's loudest at the least, a quarter of (power + 4). Blocks bring their loudest."""
    loudest = spectra.groupBy("rec_id").agg((F.max("top") - 8).alias("least"))
    scaled = F.transform("energies", lambda v: ((F.greatest(v, F.col("least")) + 4) / 4).cast("float"))
    return spectra.join(loudest, "rec_id").select("rec_id", "block", "first_frame", "n_frames", scaled.alias("energies")).where("n_frames > 0")


def _by_block(haloed: DataFrame, run) -> DataFrame:
    kind = haloed.schema["rec_id"].dataType.simpleString()

    def lists(arrays) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([v.size for v in arrays])]), pa.int32()), pa.array(np.concatenate([v.ravel() for v in arrays]), pa.float64()))

    def blocks(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                b = batch.slice(i, 16)
                found = [run(*row) for row in zip(b.column(1).to_pylist(), *(_numbers(b.column(c)) for c in (2, 3, 4)))]
                starts, spectra, tops = zip(*found)
                first, n = pa.array(starts, pa.int64()), pa.array([len(v) for v in spectra], pa.int32())
                totals, top = lists([v.sum(axis=0) for v in spectra]), pa.array(tops, pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), first, n, lists(spectra), totals, top], names=["rec_id", "block", "first_frame", "n_frames", "energies", "totals", "top"])

    haloed = haloed.select("rec_id", F.col("block").cast("long").alias("block"), "samples", "before", "after")
    return haloed.mapInArrow(blocks, f"rec_id {kind}, block long, first_frame long, n_frames int, energies array<double>, totals array<double>, top double")
