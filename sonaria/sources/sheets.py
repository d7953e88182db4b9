"""The first sheet of an .xlsx workbook, which is a zip of XML files."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

# Namespaces of the workbook format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets/{MAIN}sheet")
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[sheet.get(LINK)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def rows(content: bytes) -> list[list[str | None]]:
    """The cells of the first sheet as they are written there, a list for each row; a missing cell is null."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        out = []
        for row in ElementTree.fromstring(book.read(_first_sheet(book))).iter(f"{MAIN}row"):
            cells: list[str | None] = []
            for k, c in enumerate(row.iter(f"{MAIN}c")):
                at = _column(c.get("r")) if c.get("r") else k
                cells += [None] * (at + 1 - len(cells))
                value = c.find(f"{MAIN}v")
                if c.get("t") == "inlineStr":
                    cells[at] = _text(c)
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
            out.append(cells)
        return out
