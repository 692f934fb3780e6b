"""Greedy segmentation of a recording's rows: clauses, subtitle lines, translation units, rows of a translation.

Where a row's fate hangs on what the rows before it were joined to, no window can say it; such folds run over stretches
of a recording's ordered rows (``folds``). Times are integer milliseconds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.itn import normalize as digits
from ..functions.text import AFTER, BEFORE, BREAKS
from . import folds, intervals
from .rows import batches_of

# Signs that end a clause, and signs that end a sentence and may be followed by closing signs.
BREAK = re.compile(rf"[{BREAKS}]|\.(?=\s|$)")
ENDS = set("。！？!?….")
CLOSERS = "\"'”’」』）)》】…～ "
_AFTER, _BEFORE = re.compile(f"{AFTER}$"), re.compile(f"^{BEFORE}")
TAG = re.compile(r"^\s*\[([^\]]{1,32})\]\s*")


def ends_sentence(text: str) -> bool:
    bare = text.rstrip().rstrip(CLOSERS)
    return bool(bare) and bare[-1] in ENDS


def join_pieces(pieces: list[str]) -> str:
    out = ""
    for p in pieces:
        out += " " + p if out and p and _AFTER.search(out) and _BEFORE.search(p) else p
    return out


def split_tag(text: str) -> tuple[str, str]:
    m = TAG.match(text or "")
    return (m[1], text[m.end() :].strip()) if m else ("", (text or "").strip())


def clauses_from(items: list[tuple[int, int, str]], most_ms: int = 6000, gap_ms: int = 1200) -> list[tuple[int, tuple[int, int, str]]]:
    """(number of its first item, (start, end, text)) of clauses. An item opens a new clause after a long silence, or if it would make the clause too
    long; a clause closes after a break sign, or when it is long enough."""
    out: list[list] = []
    is_open = False
    for i, (start, end, text) in enumerate(items):
        if not text:
            continue
        end = max(start, end)
        if is_open and (start - out[-1][2] > gap_ms or end - out[-1][1] > most_ms):
            is_open = False
        if not is_open:
            out.append([i, start, end, ""])
        out[-1][2] = max(out[-1][2], end)
        out[-1][3] += text
        is_open = not (BREAK.search(text) or out[-1][2] - out[-1][1] >= most_ms)
    return [(i, (s, e, t.strip())) for i, s, e, t in out if t.strip()]


def clauses(items: list[tuple[int, int, str]], most_ms: int = 6000, gap_ms: int = 1200) -> list[tuple[int, int, str]]:
    return [c for _, c in clauses_from(items, most_ms, gap_ms)]


def clause_certain(items: list[tuple[int, int, str]], reached: int | None, gap_ms: int = 1200) -> int | None:
    """First item before which a clause ends whatever came before: after a break sign, or a silence. ``reached``: the end of the items before."""
    closed, end = False, reached
    for i, (start, stop, text) in enumerate(items):
        if not text:
            continue
        if i and (closed or end is not None and start - end > gap_ms):
            return i
        closed = bool(BREAK.search(text))
        end = max(start, stop) if end is None else max(end, start, stop)
    return None


def pack_from(rows: list[tuple[int, int, str, str]], most_ms: int = 6000, most_chars: int = 48, gap_ms: int = 1200, least_ms: int = 1000, written: Callable[[str], str] = digits) -> list[tuple[int, tuple[int, int, str, str]]]:
    """(number of its first clause, (start, end, text, speaker)) of lines made of clauses (start, end, text, speaker). ``written`` is how a line's text is written: its numerals as digits."""
    lines: list[dict] = []
    current: dict | None = None

    def fits(c: dict, row: tuple) -> bool:
        return row[1] - c["start"] <= most_ms and sum(map(len, c["texts"])) + len(row[2]) <= most_chars and row[0] - c["end"] <= gap_ms

    for i, row in enumerate(rows):
        start, end, text, speaker = row
        # a clause without a speaker never parts a line that is open
        if current and (not fits(current, row) or speaker and speaker != current["speaker"]):
            current = None
        if current is None:
            current = {"at": i, "start": start, "end": 0, "texts": [], "speaker": speaker}
            lines.append(current)
        current["texts"].append(text)
        current["end"] = max(current["end"], end)
        if ends_sentence(text):
            follows = rows[i + 1] if i + 1 < len(rows) else None
            long_enough = current["end"] - current["start"] >= least_ms
            # a short sentence stays open for what may join it; here a missing speaker does count as another
            if follows is None or long_enough or follows[3] != current["speaker"] or not fits(current, follows):
                current = None
    joined = ((c["at"], c["start"], max(c["start"], c["end"]), join_pieces(c["texts"]).strip(), c["speaker"]) for c in lines)
    return [(i, (a, b, written(t), who)) for i, a, b, t, who in joined if t]


def pack(rows: list[tuple[int, int, str, str]], most_ms: int = 6000, most_chars: int = 48, gap_ms: int = 1200, least_ms: int = 1000, written: Callable[[str], str] = digits) -> list[tuple[int, int, str, str]]:
    return [line for _, line in pack_from(rows, most_ms, most_chars, gap_ms, least_ms, written)]


def pack_certain(rows: list[tuple[int, int, str, str]], most_ms: int = 6000, most_chars: int = 48, least_ms: int = 1000) -> int | None:
    """First clause that begins a line whatever came before its neighbour: two of different speakers, or two that don't fit one line, or after a sentence that is long enough."""
    for i, (a, b) in enumerate(zip(rows, rows[1:]), 1):
        if a[3] and b[3] and a[3] != b[3] or b[1] - a[0] > most_ms or len(a[2]) + len(b[2]) > most_chars or ends_sentence(a[2]) and a[1] - a[0] >= least_ms:
            return i
    return None


def merge_from(rows: list[tuple[int, tuple[int, int, str, str]]], first: bool = True, least_ms: int = 1000, most_ms: int = 6000, most_chars: int = 64) -> list[tuple[int, tuple[int, int, str, str]]]:
    """Lines under ``least_ms`` joined to the line before of the same speaker, then a short first line, of a recording's ``first`` rows, to the one after it."""
    def may(a: tuple, b: tuple) -> bool:
        return a[3] == b[3] and b[1] - a[0] <= most_ms and len(a[2]) + len(b[2]) <= most_chars

    out: list[tuple[int, tuple]] = []
    for i, row in rows:
        if out and row[1] - row[0] < least_ms and may(out[-1][1], row):
            i, a = out.pop()
            row = (a[0], max(a[1], row[1]), join_pieces([a[2], row[2]]), a[3])
        out.append((i, row))
    while first and len(out) > 1 and out[0][1][1] - out[0][1][0] < least_ms and may(out[0][1], out[1][1]):
        (i, a), (_, b) = out[:2]
        out[:2] = [(i, (a[0], b[1], join_pieces([a[2], b[2]]), b[3]))]
    return out


def merge_short(rows: list[tuple[int, int, str, str]], least_ms: int = 1000, most_ms: int = 6000, most_chars: int = 64) -> list[tuple[int, int, str, str]]:
    return [line for _, line in merge_from(list(enumerate(rows)), True, least_ms, most_ms, most_chars)]


def merge_certain(rows: list[tuple[int, int, str, str]], least_ms: int = 1000) -> int | None:
    """The second line of ``least_ms`` or more: no such line joins one before it, and a recording's first lines join none beyond the first such line."""
    long = [i for i, r in enumerate(rows) if r[1] - r[0] >= least_ms]
    return long[1] if len(long) > 1 else None


def on_timeline(rows: list[tuple[int, int, str, str]], least_ms: int = 600, after: int | None = None) -> list[tuple[int, int, str, str]]:
    """Lines that last ``least_ms`` if the next leaves room, and end 20 ms before it; at the least 100 and 50 ms long. ``after``: where the line after the last begins."""
    out = []
    for i, (start, end, text, speaker) in enumerate(rows):
        following = rows[i + 1][0] if i + 1 < len(rows) else after
        end = start + least_ms if end <= start else end
        if end - start < least_ms:
            end = start + least_ms if following is None else min(start + least_ms, max(start + 100, following - 20))
        if following is not None and end > following:
            end = max(start + 50, following - 20)
        out.append((start, end, text, speaker))
    return out


def finish_from(rows: list[tuple[int, int, str, str]], first: bool = True, after: int | None = None, most_chars: int = 48, most_ms: int = 6000, with_speaker: bool = True) -> list[tuple[int, tuple[int, int, str, str]]]:
    """Subtitle lines of clauses with speakers: packed, short ones merged, put on the timeline; with the number of the clause that each begins with."""
    lines = pack_from(rows, most_ms, most_chars)
    lines = lines if with_speaker else [(i, (*x[:3], "")) for i, x in lines]
    merged = merge_from(lines, first, most_ms=most_ms, most_chars=max(most_chars, int(1.4 * most_chars)))
    return [(i, x) for (i, _), x in zip(merged, on_timeline([x for _, x in merged], after=after))]


def finish_certain(rows: list[tuple[int, int, str, str]]) -> int | None:
    """First clause that is sure to begin a line that joins no other before it. The last line that is known may yet grow, and doesn't count."""
    begin = pack_certain(rows)
    if begin is None:
        return None
    lines = pack_from(rows[begin:])[:-1]
    k = merge_certain([x for _, x in lines])
    return None if k is None else begin + lines[k][0]


def lines_from(items: list[tuple[int, int, str]], first: bool = True, after: int | None = None) -> list[tuple[int, tuple[int, int, str, str]]]:
    """Subtitle lines of items, with the number of the item that each begins with."""
    found = clauses_from(items)
    return [(found[k][0], x) for k, x in finish_from([(*c, "") for _, c in found], first, after)]


def lines_certain(items: list[tuple[int, int, str]], reached: int | None) -> int | None:
    begin = clause_certain(items, reached)
    if begin is None:
        return None
    found = clauses_from(items[begin:])[:-1]
    k = finish_certain([(*c, "") for _, c in found])
    return None if k is None else begin + found[k][0]


def text_clauses(text: str | None, total_ms: int, most_ms: int = 6000, most_chars: int = 48) -> list[tuple[int, int, str]]:
    """(start, end, text): clauses of a text without times. Pieces between clause signs, cut to what fits a line at the text's pace, share the
    time by length; each gets 400 ms at least, as long as there is time."""
    bare = (text or "").strip()
    if not bare:
        return []
    allowed = max(4, int(most_ms / 1000 * (len(bare) / max(total_ms / 1000, 0.001)) * 0.95))
    most, cuts = max(1, min(most_chars, allowed)), [0, *(m.end() for m in BREAK.finditer(text)), len(text)]
    pieces = [p for a, b in zip(cuts, cuts[1:]) if (x := text[a:b].strip()) for p in split_oversize(x, most)] or [bare]
    whole, out, cursor = sum(map(len, pieces)), [], 0.0
    for p in pieces:
        end = min(float(total_ms), cursor + max(400.0, total_ms * len(p) / whole))
        out.append((round(cursor), round(max(end, cursor)), p))
        cursor = end
    return out


def units_from(rows: list[tuple[int, int, str, str, int]], hard_ms: int = 45_000) -> list[tuple[int, tuple]]:
    """(number of its first row, (start, end, summed duration, text, speaker, complete, rows, their numbers, their (start, end, text))) of translation units of rows (start, end, text, speaker, number)."""
    out, block = [], []

    def close() -> None:
        if block:
            text = join_pieces([b[2] for b in block]).strip()
            own = [{"start_ms": b[0], "end_ms": b[1], "text": b[2]} for b in block]
            out.append((block[0][5], (block[0][0], max(b[1] for b in block), sum(max(0, b[1] - b[0]) for b in block), text, block[0][3], ends_sentence(text), len(block), [b[4] for b in block], own)))
            block.clear()

    for i, (start, end, text, speaker, n) in enumerate(rows):
        tag, body = split_tag(text)
        speaker = speaker or tag
        if not body:
            continue
        if block and speaker and block[-1][3] and speaker != block[-1][3]:
            close()
        block.append((start, end, body, speaker, n, i))
        if ends_sentence(body) or max(b[1] for b in block) - block[0][0] >= hard_ms:
            close()
    close()
    return [u for u in out if u[1][3]]


def units(rows: list[tuple[int, int, str, str]], hard_ms: int = 45_000) -> list[tuple[int, int, int, str, str, bool, int, list[int]]]:
    """(start, end, summed duration, text, speaker, complete, rows, their numbers from 1) of translation units."""
    return [u[:8] for _, u in units_from([(*r, n) for n, r in enumerate(rows, 1)], hard_ms)]


def units_certain(rows: list[tuple[int, int, str, str, int]]) -> int | None:
    """First row that begins a unit whatever came before its neighbour: after the end of a sentence, or between two speakers."""
    last = None
    for i, (_, _, text, speaker, _) in enumerate(rows):
        tag, body = split_tag(text)
        if body:
            who = speaker or tag
            if last and (ends_sentence(last[0]) or who and last[1] and who != last[1]):
                return i
            last = (body, who)
    return None


def split_translation(text: str, start: int, duration: int) -> list[tuple[int, int, str]]:
    """(start, end, text): cut after a full stop or question mark (with its closing quote), and after a comma once five characters have come;
    time is shared by length."""
    text = (text or "").strip()
    if not text:
        return []
    pieces, at = [], 0
    for m in re.finditer(r"[。？]”?|，", text):
        if m[0] != "，" or len(text[at : m.end()].strip()) >= 5:
            pieces.append(text[at : m.end()].strip())
            at = m.end()
    pieces.append(text[at:].strip())
    pieces = [p for p in pieces if p]
    duration = duration if duration > 10 else max(600, 200 * len(text))
    total, out, cursor = sum(map(len, pieces)), [], start
    for i, p in enumerate(pieces):
        end = start + duration if i == len(pieces) - 1 else cursor + duration * len(p) // total
        end = max(end, cursor + 50)
        out.append((cursor, end, p))
        cursor = end
    return out


def split_oversize(text: str, most: int) -> list[str]:
    """Words wrapped at spaces; a text without spaces is sliced. Further spaces stay inside a line and go where a line begins."""
    if len(text) <= most:
        return [text] if text else []
    if " " not in text:
        return [text[i : i + most] for i in range(0, len(text), most)]
    lines: list[str] = []
    for w in text.split(" "):
        if lines and (not lines[-1] or len(lines[-1]) + 1 + len(w) <= most):
            lines[-1] = f"{lines[-1]} {w}" if lines[-1] else w
        else:
            lines.append(w)
    return [x for x in lines if x] or [text]


_LINE = "start_ms long, end_ms long, text string, speaker string"


#: Milliseconds of items, and rows of what has numbers, that are folded by themselves.
STRETCH_MS, STRETCH = 600_000, 500


def _tuples(pdf: pd.DataFrame, *columns: str) -> list[tuple]:
    return list(pdf[list(columns)].itertuples(index=False, name=None))


def _fold_items(items: DataFrame, out: str, process, certain, loose: int = 1) -> DataFrame:
    """A fold of items in order of time."""
    end = F.greatest("start_ms", "end_ms")
    last = F.floor((end + 1200) / STRETCH_MS)  # a silence is counted from the end of all items before
    return folds.fold(items, ["start_ms", "pos"], ["start_ms", "end_ms", "text"], F.floor(F.col("start_ms") / STRETCH_MS), out, process, certain, (last, end), loose=loose)


def _fold_rows(rows: DataFrame, columns: list[str], out: str, process, certain) -> DataFrame:
    """A fold of numbered rows."""
    return folds.fold(rows, ["idx"], columns, F.floor(F.col("idx") / STRETCH), out, process, lambda x, _: certain(x))


def split_into_clauses(items: DataFrame) -> DataFrame:
    """Clauses of items (rec_id, pos, start_ms, end_ms, text)."""
    return _fold_items(items, "start_ms long, end_ms long, text string", lambda x, *_: clauses_from(x), clause_certain)


_CLAUSE = ["start_ms", "end_ms", "text", "speaker"]


def pack_lines(rows: DataFrame) -> DataFrame:
    """Lines of clauses (rec_id, idx, start_ms, end_ms, text, speaker)."""
    return _fold_rows(rows, _CLAUSE, _LINE, lambda x, *_: pack_from(x), pack_certain)


def merge_short_lines(rows: DataFrame) -> DataFrame:
    return _fold_rows(rows, _CLAUSE, _LINE, lambda x, first, _: merge_from(list(enumerate(x)), first), merge_certain)


def translation_units(rows: DataFrame) -> DataFrame:
    """Units of rows (rec_id, idx, start_ms, end_ms, text, speaker); ``members`` are the numbers (from 1, by idx) of a unit's rows, ``rows`` their times and texts, without tags."""
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("rec_id").orderBy("idx")))
    schema = "start_ms long, end_ms long, duration_ms long, text string, speaker string, complete boolean, n_rows int, members array<int>, rows array<struct<start_ms: long, end_ms: long, text: string>>"
    return _fold_rows(numbered, [*_CLAUSE, "n"], schema, lambda x, *_: units_from(x), units_certain)


def translated_rows(units_: DataFrame, keep_source: bool = False, with_speaker: bool = True) -> DataFrame:
    """Rows of translated units (rec_id, idx, start_ms, end_ms, translation, speaker): the translation cut at its signs. With ``keep_source`` a unit without a
    translation keeps the source rows that it brings in ``rows``; else it has none."""
    part = "array<struct<start_ms: long, end_ms: long, text: string>>"

    @F.pandas_udf(part)
    def pieces(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([[{"start_ms": a, "end_ms": b, "text": t} for a, b, t in split_translation(x, s, max(1, e - s))] for x, s, e in zip(text, start, end)])

    made = pieces("translation", "start_ms", "end_ms")
    if keep_source:
        bare = F.trim(F.coalesce("translation", F.lit(""))) == ""
        source = F.transform("rows", lambda r: F.struct(r["start_ms"].alias("start_ms"), F.greatest(r["end_ms"], r["start_ms"] + 50).alias("end_ms"), r["text"].alias("text")))
        made = F.when(bare, source).otherwise(made)
    out = units_.select("rec_id", F.col("idx").alias("unit"), "speaker", F.posexplode(made).alias("part", "r"))
    n = F.row_number().over(Window.partitionBy("rec_id").orderBy("unit", "part"))
    speaker = F.col("speaker") if with_speaker else F.lit("").alias("speaker")
    return out.select("rec_id", n.alias("idx"), "r.start_ms", "r.end_ms", "r.text", speaker)


def attach_speakers(clause_rows: DataFrame, turn_rows: DataFrame, keys: list[str], deal: list[str] | None = None) -> DataFrame:
    """Clauses with speaker: the label that shares most time with each, '' if none does."""
    return intervals.dominant_speaker(clause_rows, turn_rows, keys, deal=deal).withColumn("speaker", F.coalesce("label", F.lit(""))).drop("label", "overlap_ms")


def _finished(clause_rows: DataFrame, with_speaker: bool) -> DataFrame:
    return _fold_rows(clause_rows, _CLAUSE, _LINE, lambda x, first, after: finish_from(x, first, after, with_speaker=with_speaker), finish_certain)


def build_subtitles(items: DataFrame, turn_rows: DataFrame | None = None, with_speaker: bool = True) -> DataFrame:
    """Subtitle lines of items (rec_id, pos, start_ms, end_ms, text), with the speakers of turns (rec_id, seq, start_ms, end_ms, label) if
    there are any. Without turns all folds of a stretch are one after the other."""
    if turn_rows is None:
        # the last clause may grow, and leave its line, which may then join the line before
        return _fold_items(items, _LINE, lines_from, lines_certain, loose=2)
    return _finished(attach_speakers(split_into_clauses(items), turn_rows, ["rec_id", "idx"]), with_speaker)


def build_subtitles_from_text(texts: DataFrame, turn_rows: DataFrame | None = None, with_speaker: bool = True) -> DataFrame:
    """Subtitle lines of texts (rec_id, text, total_ms) without times. A recording's several texts come one after the other, by total_ms, then text.

    A text goes to its clauses once, and no clause brings it along; clauses are handed on a few thousand at a time."""
    rec = texts.schema["rec_id"]
    schema = StructType([rec, StructField("idx", IntegerType()), *(StructField(name, LongType()) for name in ("start_ms", "end_ms")), StructField("text", StringType())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last, idx = (), 0
            for b in batches:
                for i in range(b.num_rows):
                    who, total, text = (c[i].as_py() for c in b.columns)
                    idx = idx if (who,) == last else 0
                    last = (who,)
                    for idx, clause in enumerate(text_clauses(text, total), idx + 1):
                        yield who, idx, *clause

        yield from batches_of(rows(), schema)

    ordered = texts.select("rec_id", "total_ms", "text").repartition("rec_id").sortWithinPartitions("rec_id", "total_ms", "text")
    found = ordered.mapInArrow(run, schema)
    found = found.withColumn("speaker", F.lit("")) if turn_rows is None else attach_speakers(found, turn_rows, ["rec_id", "idx"])
    return _finished(found, with_speaker)
