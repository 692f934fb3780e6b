"""A sink that writes one text file a row, and shows all files of a job or none.

    spark.dataSource.register(TextFiles)          # or write(rows, folder)
    rows.write.format("text_files").mode("append").save(folder)

Rows: name (the file's place in the folder, with ``/`` between its parts), content, and source if there is one (the path of the file that the row was made from).
A task writes below ``_temporary-<job>`` in the folder. What it wrote is named to the driver when it ends well; only those files are moved to their places, once all
tasks have ended, so nothing of a task that failed, or ran twice, is ever seen. ``_SUCCESS`` is written last. A task that still runs when its job is given up
may leave its part of the job's folder, whose name readers pass over, as it begins with an underscore.

Refused before any file is moved, with the folder as it was: a name that two rows have; a name that leaves the folder, or is null or empty; a name whose place is the row's source;
in mode append, a place that is taken. Mode overwrite replaces files of the same name, and leaves others alone. Null content is an empty file.
Paths are local or of any store that Arrow opens and that can rename. The driver gets the names of files, not their content.
"""

from __future__ import annotations

import posixpath
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow.fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from .places import absolute, opened

#: Files that the driver moves at a time.
THREADS = 16


@dataclass
class Written(WriterCommitMessage):
    """(name, place below the job's folder) of a task's files."""

    files: list[tuple[str, str]] = field(default_factory=list)


def inside(name: str | None) -> str:
    """The name in its plain form; an error if it is none, or leads out of the folder."""
    plain = posixpath.normpath(name or "")
    if not name or name.endswith("/") or plain in (".", "..") or plain.startswith(("/", "../")) or plain.startswith("_temporary-") or plain == "_SUCCESS":
        raise ValueError(f"no name for a file: {name!r}")
    return plain


class TextFilesWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool, columns: list[str]):
        self.folder, self.overwrite, self.columns = folder, overwrite, columns
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, folder = opened(self.folder)
        task, out = uuid.uuid4().hex, Written()
        place = f"{folder}/{self.job}/{task}"
        try:
            system.create_dir(place, recursive=True)
            for n, row in enumerate(iterator):
                name = inside(row["name"])
                if "source" in self.columns and row["source"] is not None and opened(row["source"])[1] == f"{folder}/{name}":
                    raise ValueError(f"{row['source']} would be written over by what was made from it")
                with system.open_output_stream(f"{place}/{n}") as f:
                    f.write((row["content"] or "").encode("utf-8", "surrogatepass"))
                out.files.append((name, f"{task}/{n}"))
        except BaseException:
            system.delete_dir(place)
            raise
        return out

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        try:
            twice = [name for name, n in Counter(name for name, _ in files).items() if n > 1]
            if twice:
                raise ValueError(f"{len(twice)} names have more than one row, as {sorted(twice)[0]!r}")
            system.create_dir(folder, recursive=True)
            if not self.overwrite:
                taken = [i.path for k in range(0, len(files), 10_000) for i in system.get_file_info([f"{folder}/{name}" for name, _ in files[k : k + 10_000]]) if i.type != pyarrow.fs.FileType.NotFound]
                if taken:
                    raise FileExistsError(f"{len(taken)} places are taken, as {taken[0]}")
            for parent in sorted({posixpath.dirname(name) for name, _ in files} - {""}):
                system.create_dir(f"{folder}/{parent}", recursive=True)
            with ThreadPoolExecutor(THREADS) as pool:
                list(pool.map(lambda f: system.move(f"{folder}/{self.job}/{f[1]}", f"{folder}/{f[0]}"), files))
            with system.open_output_stream(f"{folder}/_SUCCESS"):
                pass
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Removes whatever the job has left below its own folder."""
        system, folder = opened(self.folder)
        if system.get_file_info(f"{folder}/{self.job}").type == pyarrow.fs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.job}")


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, content string, source string"

    def writer(self, schema: StructType, overwrite: bool) -> TextFilesWriter:
        columns = schema.fieldNames()
        if not {"name", "content"} <= set(columns) or any(not isinstance(schema[c].dataType, StringType) for c in {"name", "content", "source"} & set(columns)):
            raise ValueError(f"name and content have to be strings, and source if there is one; there are {', '.join(columns)}")
        return TextFilesWriter(absolute(self.options["path"]), overwrite, columns)


def write(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """One file of ``folder`` for each row (name, content, and source if there is one)."""
    rows.sparkSession.dataSource.register(TextFiles)
    rows.write.format("text_files").mode(mode).save(folder)
