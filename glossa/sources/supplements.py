"""Supplementary files as rows: delimited text, workbooks, archives and web pages, by a table function.

`supplement_rows` reads files as bytes and gives every table row in them to SQL as a row. The function is
polymorphic: the type of the paper's id is that of the table it is called on. Its input is partitioned by paper, so
that the limits of a paper's files (members of an archive, sheets of a workbook, rows of a table) hold whatever task
reads them. A file that cannot be read is a row with the reason, and so is a kind of file that has no tables.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import ParseError

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .sheets import read_book

ROWS, SHEETS, MEMBERS = 200, 2, 3
#: Members of an archive that are looked at, and bytes of one that are read.
LOOKED_AT, MEMBER_BYTES = 10, 200_000
_DELIMITED = {".csv": ",", ".tsv": "\t", ".txt": ","}


def _suffix(name: str) -> str:
    return name[name.rfind(".") :].lower() if "." in name else ""


def _delimited(raw: bytes, suffix: str) -> Iterator[tuple[int, list[str]]]:
    text = raw.decode("utf-8", errors="replace").removeprefix("﻿")
    for n, cells in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=_DELIMITED[suffix]), 1):
        if n > ROWS:
            return
        yield n, [c.strip() for c in cells]


class SupplementRows:
    """(paper, file, member, sheet, row, cells, reason) of files (paper, name, content)."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        fields = {f.name.lower(): f for f in files.dataType.fields} if files.isTable else {}
        if not {"paper", "name", "content"} <= fields.keys() or not isinstance(fields["content"].dataType, T.BinaryType):
            raise ValueError("a table with paper, name and content (binary) is asked for")
        schema = T.StructType([T.StructField("paper", fields["paper"].dataType), T.StructField("file", T.StringType()), T.StructField("member", T.StringType()), T.StructField("sheet", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("paper")], orderBy=[OrderingColumn("name")])

    def eval(self, files) -> Iterator[tuple]:
        paper, name, content = files["paper"], files["name"] or "", files["content"]
        out = []
        try:
            for member, sheet, n, cells in self._rows(_suffix(name), bytes(content or b"")):
                out.append((paper, name, member, sheet, n, cells, None))
            reason = None if out else "no rows"
        except KeyError:
            reason = "no workbook"
        except (zipfile.BadZipFile, ParseError, csv.Error, ValueError, IndexError, NotImplementedError, RuntimeError, OSError) as failure:
            reason = type(failure).__name__
        if reason:
            # What a broken file gave before it broke does not count.
            yield paper, name, None, None, None, None, reason
        else:
            yield from out

    def _rows(self, suffix: str, content: bytes) -> Iterator[tuple[str | None, str | None, int, list[str]]]:
        if suffix in _DELIMITED:
            for n, cells in _delimited(content, suffix):
                yield None, None, n, cells
        elif suffix == ".xlsx":
            for sheet, n, cells in read_book(io.BytesIO(content), SHEETS, ROWS):
                if any(c.strip() for c in cells):
                    yield None, sheet, n, [c.strip() for c in cells]
        elif suffix == ".zip":
            read = 0
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for member in z.namelist()[:LOOKED_AT]:
                    if _suffix(member) in _DELIMITED and read < MEMBERS:
                        read += 1
                        with z.open(member) as part:
                            for n, cells in _delimited(part.read(MEMBER_BYTES), _suffix(member)):
                                yield member, None, n, cells
        else:
            raise ValueError(f"no tables in {suffix}")


def supplement_rows(files: DataFrame) -> DataFrame:
    """Rows of the tables in files (paper, name, content)."""
    spark = files.sparkSession
    spark.udtf.register("supplement_rows", F.udtf(SupplementRows))
    return spark.sql("SELECT s.* FROM supplement_rows(TABLE({files})) AS s", files=files.select("paper", "name", "content"))


def read_supplements(spark: SparkSession, path: str, paper: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """Rows of all supplementary files under a folder; the paper's id is taken from a file's path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return supplement_rows(raw.select(F.regexp_extract("path", paper, 1).alias("paper"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content"))
