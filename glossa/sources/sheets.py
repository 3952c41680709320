"""Sheets of office workbooks, written and read as a stream with the standard library.

A workbook is a ZIP of XML parts. Cells are written as inline text. Characters that XML has no room for are
written as _xHHHH_, as office programs do, and an underscore that begins such a sequence is itself escaped.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

MOST_ROWS, MOST_COLUMNS, MOST_CHARS = 1_048_576, 16_384, 32_767
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\r￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_CODED = re.compile("_x([0-9A-Fa-f]{4})_")


class BookWriter:
    """Writes one workbook, sheet after sheet and row after row; nothing of it is held."""

    def __init__(self, out: BinaryIO) -> None:
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        self.names: list[str] = []
        self.part, self.rows = None, 0

    def sheet(self, name: str) -> None:
        self._end_sheet()
        own = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "Sheet"
        if own.lower() in (n.lower() for n in self.names):
            raise ValueError(f"two sheets would be named {own}")
        self.names.append(own)
        self.part, self.rows = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True), 0
        self.part.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())

    def row(self, cells: list[str | None]) -> None:
        self.rows += 1
        if self.rows > MOST_ROWS or len(cells) > MOST_COLUMNS or any(c and len(c) > MOST_CHARS for c in cells):
            raise ValueError(f"sheet {self.names[-1]} cannot hold row {self.rows}")
        said = "".join('<c t="inlineStr"><is><t xml:space="preserve">%s</t></is></c>' % escape(_NO_XML.sub(lambda m: f"_x{ord(m[0]):04X}_", c)) if c is not None else "<c/>" for c in cells)
        self.part.write(f'<row r="{self.rows}">{said}</row>'.encode())

    def _end_sheet(self) -> None:
        if self.part:
            self.part.write(b"</sheetData></worksheet>")
            self.part.close()
            self.part = None

    def close(self) -> None:
        self._end_sheet()
        n = range(1, len(self.names) + 1)
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_KIND}.worksheet+xml"/>' for k in n) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + "</Relationships>",
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>' + "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(self.names, 1)) + "</sheets></workbook>",
        }
        for name, body in parts.items():
            self.zip.writestr(name, _HEAD + body)
        self.zip.close()


def _column(ref: str | None, default: int) -> int:
    """The number of a cell's column, from 0, by its reference such as B7."""
    letters = re.match("[A-Z]+", ref or "")
    if not letters:
        return default
    n = 0
    for c in letters[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    own = "".join(t.text or "" for t in node.iter(f"{{{_MAIN}}}t"))
    return _CODED.sub(lambda m: chr(int(m[1], 16)), own)


def read_book(source: BinaryIO, sheets: int, rows: int) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of a workbook's first sheets and their first rows; rows of other programs' files too."""
    with zipfile.ZipFile(source) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, node in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if node.tag == f"{{{_MAIN}}}si":
                    shared.append(_text(node))
                    node.clear()
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        named = [(s.get("name"), targets[s.get(f"{{{_LINKS}}}id")]) for s in ElementTree.parse(z.open("xl/workbook.xml")).getroot().iter(f"{{{_MAIN}}}sheet")]
        for name, target in named[:sheets]:
            with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
                n = 0
                for _, node in ElementTree.iterparse(part):
                    if node.tag != f"{{{_MAIN}}}row":
                        continue
                    n += 1
                    if n > rows:
                        break
                    cells: list[str] = []
                    for c in node.iter(f"{{{_MAIN}}}c"):
                        at = _column(c.get("r"), len(cells))
                        cells += [""] * (at - len(cells))
                        value = c.find(f"{{{_MAIN}}}v")
                        raw = value.text or "" if value is not None else ""
                        cells.append(_text(c) if c.get("t") == "inlineStr" else shared[int(raw)] if c.get("t") == "s" and raw else raw)
                    yield name, n, cells
                    node.clear()
