r"""Fill-in-middle transformation by bit-parallelism over big integers.

A text is cut into units (a word with the blanks before it; what is left of blanks at the end) of which some become the prefix, the middle and the
suffix. ``bytes.translate`` turns the UTF-8 bytes into a mask of one bit a byte, shifted boolean operations leave the bits at which
units end, ``bit_count`` gives their number, and recursive halving selects the bit with a given rank. All blanks are ASCII, so bytes and code points have the
same borders; a second mask, of the bytes that begin a code point, counts code points.

The draws are hashes of the seed and doc_id, so a task that runs again gives the same. Rows are transformed one by one, without a shuffle, and leave a task in
batches of bounded bytes; the longest text bounds a task's memory.

Null text counts as empty and stays plain, as does a text with one of the marks in it, so that every output can be undone. A null doc_id has no digits. Rows with
the same doc_id get the same draws. Other columns are kept, whatever their names; new ones get a prefix that no column begins with. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import fresh, read

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text after which a task hands a batch on.
BATCH = 8_000_000

_WORD = bytes(48 if c == 32 or 9 <= c <= 13 else 49 for c in range(256))
_START = bytes(48 if c & 0xC0 == 0x80 else 49 for c in range(256))


def unit_ends(raw: bytes) -> int:
    """Integer whose bit i is set where a unit ends with byte i."""
    if not raw:
        return 0
    word = int(raw[::-1].translate(_WORD), 2)
    return word & ~(word >> 1) | 1 << (len(raw) - 1)


def code_points(raw: bytes) -> int:
    """Integer whose bit i is set where byte i begins a code point."""
    return int(raw[::-1].translate(_START), 2) if raw else 0


def select(mask: int, width: int, rank: int) -> int:
    """Place of the set bit with this rank, from 1, among the lowest ``width`` bits: into the half that has it, again and again."""
    place = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        n = low.bit_count()
        if rank <= n:
            mask, width = low, half
        else:
            mask, width, rank, place = mask >> half, width - half, rank - n, place + half
    return place


def draws(seed: str, doc_id) -> list[int]:
    """Four numbers of 32 bits."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def rearrange(raw: bytes, doc_id, seed: str, percent: int, spm_percent: int, marks: tuple[bytes, bytes, bytes]) -> tuple[bytes, str, int, int | None, int | None]:
    """Output, form (plain, psm, spm), number of units, code points of the prefix and of the middle (None if plain)."""
    ends = unit_ends(raw)
    n = ends.bit_count()
    h = draws(seed, doc_id)
    if not raw or h[2] % 100 >= percent or any(m in raw for m in marks):
        return raw, "plain", n, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (select(ends, len(raw), r) + 1 if r else 0 for r in (a, b))
    points = code_points(raw)
    until = [(points & ((1 << x) - 1)).bit_count() for x in (a, b)]
    (p, s, m), prefix, middle, suffix = marks, raw[:a], raw[a:b], raw[b:]
    if h[3] % 100 < spm_percent:
        return b"".join((s, suffix, p, prefix, m, middle)), "spm", n, until[0], until[1] - until[0]
    return b"".join((p, prefix, s, suffix, m, middle)), "psm", n, until[0], until[1] - until[0]


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = MARKS, text: str = "text", doc_id: str = "doc_id", prefix: str = "fim_") -> DataFrame:
    """``docs`` with the columns output, form, n, prefix_chars and middle_chars, their names led by ``prefix`` (made longer until no column begins with it).

    ``percent`` of the texts are rearranged, ``spm_percent`` of those with the suffix first. A mark's first character may be in no mark again, so that
    marks can't arise where parts meet."""
    if len(set(marks)) < 3 or any(x[:1] in y[1:] or not x for x in marks for y in marks):
        raise ValueError("marks must differ, and begin with a character that occurs in none of them again")
    prefix = fresh(docs.columns, prefix)
    raw_marks = tuple(m.encode() for m in marks)
    at_text, at_id = docs.columns.index(text), docs.columns.index(doc_id)
    new = [("output", pa.string(), StringType()), ("form", pa.string(), StringType()), ("n", pa.int64(), LongType()), ("prefix_chars", pa.int64(), LongType()), ("middle_chars", pa.int64(), LongType())]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(at_text)), 0).to_numpy()
            first, held = 0, 0
            for i, size in enumerate(sizes.tolist()):
                held += size
                if held > BATCH or i + 1 == len(sizes):
                    yield changed(b.slice(first, i + 1 - first))
                    first, held = i + 1, 0

    def changed(b: pa.RecordBatch) -> pa.RecordBatch:
        raws, ids = b.column(at_text).cast(pa.binary()).to_pylist(), b.column(at_id).to_pylist()
        out = zip(*(rearrange(r or b"", i, str(seed), percent, spm_percent, raw_marks) for r, i in zip(raws, ids)))
        columns = [pa.array(v, pa.binary()).cast(pa.string()) if name == "output" else pa.array(v, kind) for (name, kind, _), v in zip(new, out)]
        return pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *(f"{prefix}{name}" for name, _, _ in new)])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(f"{prefix}{name}", kind) for name, _, kind in new)]))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """Column: the text that was rearranged into ``output``."""
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(read(spark, sf_dir, "documents").select("doc_id", "text"), prefix="fim_")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        sha(F.col("fim_output")).alias("output_sha256"), sha(restored(F.col("fim_output"), F.col("fim_form"))).alias("restored_sha256"),
    )
