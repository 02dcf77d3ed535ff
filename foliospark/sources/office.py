"""DOCX, HWPX and XLSX files (ZIP archives of XML) to rows, with limits against oversized archives."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame

MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL = 1_024, 64 << 20, 128 << 20
TEXTS = "path string, text string, error string"
CELLS = "path string, sheet string, ref string, type string, raw string, error string"


class OfficeError(ValueError):
    """A file that isn't the archive it should be, or too large."""


class Archive:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise OfficeError("not a ZIP archive") from e
        sizes = {i.filename: i.file_size for i in self.zip.infolist()}
        if len(sizes) > MAX_ENTRIES or max(sizes.values(), default=0) > MAX_ENTRY or sum(sizes.values()) > MAX_TOTAL:
            raise OfficeError("archive is too large")
        self.names = list(sizes)

    def xml(self, name: str) -> ET.Element:
        with self.zip.open(name) as f:
            data = f.read(MAX_ENTRY + 1)
        if len(data) > MAX_ENTRY or b"<!ENTITY" in data:
            raise OfficeError(f"{name} is too large or has entities")
        return ET.fromstring(data)


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _flow(root: ET.Element) -> str:
    """Text of an XML body: t is text, tab a tab, br and cr line ends, as is the end of p."""
    out: list[str] = []

    def visit(e):
        kind = local(e)
        if kind == "t":
            out.append("".join(e.itertext()))
            return
        out.extend({"tab": "\t", "br": "\n", "cr": "\n"}.get(kind, ""))
        for child in e:
            visit(child)
        if kind == "p":
            out.append("\n")

    visit(root)
    return re.sub("\n{3,}", "\n\n", "".join(out))


def docx_text(data: bytes) -> str:
    a = Archive(data)
    if "word/document.xml" not in a.names:
        raise OfficeError("no document part")
    return _flow(a.xml("word/document.xml"))


def hwpx_text(data: bytes) -> str:
    """Sections in order of their numbers; a name without one comes last."""
    a = Archive(data)
    found = [(n, re.search(r"section([0-9]*)\.xml$", n)) for n in a.names if re.match(r"Contents/section.*\.xml$", n)]
    parts = sorted(found, key=lambda x: (not (x[1] and x[1][1]), int(x[1][1]) if x[1] and x[1][1] else 0, x[0]))
    if not parts:
        raise OfficeError("no sections")
    return re.sub("\n{3,}", "\n\n", "".join(_flow(a.xml(n)) for n, _ in parts))


def xlsx_cells(data: bytes) -> list[tuple[str, str, str, str]]:
    """(sheet, ref, type, raw) of every cell, shared strings put in; a missing place follows the one before."""
    from ..functions import letters

    a = Archive(data)
    shared = ["".join("".join(t.itertext()) for t in si.iter() if local(t) == "t") for si in a.xml("xl/sharedStrings.xml") if local(si) == "si"] if "xl/sharedStrings.xml" in a.names else []
    rels = {_attr(r, "Id"): _attr(r, "Target") for r in a.xml("xl/_rels/workbook.xml.rels")} if "xl/_rels/workbook.xml.rels" in a.names else {}
    out = []
    sheets = [s for s in a.xml("xl/workbook.xml").iter() if local(s) == "sheet"]
    for k, s in enumerate(sheets):
        target = (rels.get(_attr(s, "id")) or "").lstrip("/").removeprefix("xl/")
        part = f"xl/{target}" if f"xl/{target}" in a.names else f"xl/worksheets/sheet{k + 1}.xml"
        if part not in a.names:
            raise OfficeError(f"no sheet {part}")
        row_no = 0
        for row in (r for r in a.xml(part).iter() if local(r) == "row"):
            row_no = int(row.get("r") or row_no + 1)
            col = 0
            for c in (c for c in row if local(c) == "c"):
                ref = c.get("r")
                col = letters.number(re.match("[A-Z]*", ref)[0]) if ref else col + 1
                kind = c.get("t") or "n"
                raw = "".join("".join(t.itertext()) for t in c.iter() if local(t) == ("t" if kind == "inlineStr" else "v"))
                if kind == "s":
                    raw = shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
                out.append((_attr(s, "name") or f"Sheet{k + 1}", ref or f"{letters.name(col)}{row_no}", {"s": "str", "inlineStr": "str"}.get(kind, kind), raw))
    return out


def _texts(files: DataFrame, read) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((p, read(bytes(c)), None))
                except (ValueError, KeyError, ET.ParseError) as e:
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, TEXTS)


def docx(files: DataFrame) -> DataFrame:
    """(path, text, error) of (path, content) rows."""
    return _texts(files, docx_text)


def hwpx(files: DataFrame) -> DataFrame:
    return _texts(files, hwpx_text)


def xlsx(files: DataFrame) -> DataFrame:
    """Cells of (path, content) rows; a file that can't be read is one row with an error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(p, *x, None) for x in xlsx_cells(bytes(c))]
                except (ValueError, KeyError, ET.ParseError) as e:
                    rows.append((p, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CELLS.split(", ")])

    return files.select("path", "content").mapInPandas(run, CELLS)
