"""A sink whose files are written by tasks and published together: log lines and workbooks.

`df.write.format("published")` writes every task's files into a staging folder that readers do not see. When all
tasks have succeeded the files of the attempts that count are kept, the folder gets its final name by one rename,
and that publishes the commit; when one fails, nothing of it is left. Appending adds a commit, overwriting
removes the earlier ones once the new one is there.

Kinds: `lines` writes a column `value` as text, one file for each task; `files` writes each row (name, content) as a
file; `workbooks` writes rows (book, sheet_no, sheet,
row, cells) as one office workbook for each book, sheet after sheet, row after row. Use `workbooks()`, which brings
the rows of a book together: they are no more than its sheets can hold, which is checked.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .landed import _files
from .sheets import BookWriter


def _safe(name: str) -> str:
    """A file name in which unusual characters are written as their numbers."""
    return re.sub(r"[^A-Za-z0-9_.-]", lambda m: f"%{ord(m[0]):x}", name)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its attempt's folder, files and rows."""

    attempt: str
    files: list[str] = field(default_factory=list)
    rows: int = 0


class _Publisher(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.kind, self.overwrite = options["path"].rstrip("/"), options.get("kind", "lines"), overwrite
        if self.kind not in ("lines", "files", "workbooks"):
            raise ValueError(f"no such kind of file: {self.kind}")
        self.commit_id = uuid.uuid4().hex
        self.staging = f"_staging-{self.commit_id}"

    def write(self, iterator: Iterator) -> Written:
        context = TaskContext.get()
        system, root = _files(self.path)
        done = Written(f"task-{context.partitionId()}-{context.taskAttemptId()}")
        folder = f"{root}/{self.staging}/{done.attempt}"
        system.create_dir(folder, recursive=True)
        {"lines": self._lines, "files": self._files, "workbooks": self._books}[self.kind](iterator, system, folder, done)
        return done

    def _lines(self, rows: Iterator, system, folder: str, done: Written) -> None:
        out = None
        try:
            for r in rows:
                if out is None:
                    done.files.append("part.txt")
                    out = system.open_output_stream(f"{folder}/part.txt")
                out.write((r["value"] or "").replace("\r", " ").replace("\n", " ").encode() + b"\n")
                done.rows += 1
        finally:
            if out is not None:
                out.close()

    def _files(self, rows: Iterator, system, folder: str, done: Written) -> None:
        for r in rows:
            name = _safe(r["name"])
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(bytes(r["content"] or b""))
            done.files.append(name)
            done.rows += 1

    def _books(self, rows: Iterator, system, folder: str, done: Written) -> None:
        book = sheet = writer = out = None
        try:
            for r in rows:
                if r["book"] != book or writer is None:
                    if writer:
                        writer.close()
                        out.close()
                    book, sheet = r["book"], None
                    name = _safe(book or "book") + ".xlsx"
                    done.files.append(name)
                    out = system.open_output_stream(f"{folder}/{name}")
                    writer = BookWriter(out)
                if (r["sheet_no"], r["sheet"]) != sheet:
                    sheet = r["sheet_no"], r["sheet"]
                    writer.sheet(r["sheet"])
                writer.row(list(r["cells"]))
                done.rows += 1
            if writer:
                writer.close()
        finally:
            if out is not None and not out.closed:
                out.close()

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _files(self.path)
        kept = {m.attempt for m in messages if m and m.files}
        staging = f"{root}/{self.staging}"
        before = [i.path for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith("commit-")]
        system.create_dir(staging, recursive=True)
        for info in system.get_file_info(fs.FileSelector(staging)):
            if info.base_name not in kept:  # an attempt that another one replaced, or that wrote nothing
                system.delete_dir(info.path)
        system.move(staging, f"{root}/commit-{self.commit_id}")
        if self.overwrite:
            for old in before:
                system.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _files(self.path)
        if system.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.staging}")


class Published(DataSource):
    @classmethod
    def name(cls) -> str:
        return "published"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Publisher(dict(self.options), overwrite)


def publish(df: DataFrame, path: str, kind: str = "lines", mode: str = "append") -> None:
    df.sparkSession.dataSource.register(Published)
    df.write.format("published").option("kind", kind).mode(mode).save(path)


def workbooks(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes rows (book, sheet_no, sheet, row, cells) as a workbook for each book."""
    dealt = rows.select("book", "sheet_no", "sheet", "row", "cells").repartition("book").sortWithinPartitions("book", "sheet_no", "row")
    publish(dealt, path, "workbooks", mode)
