"""Small files made from rows: PDF pages of text, DOCX and XLSX archives. Round trips test the readers with them."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

from ..functions import letters


def pdf(pages: list[dict]) -> bytes:
    """pages: text (Latin-1, lines), width, height, rotate, and ``flate`` to pack the content."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids = []
    for p in pages:
        lines = p.get("text", "").encode("latin-1", "replace").split(b"\n")
        shown = b" T* ".join(b"(" + x.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for x in lines)
        body = b"BT /F1 11 Tf " + shown + b" ET"
        head = b""
        if p.get("flate", True):
            body, head = zlib.compress(body), b" /Filter /FlateDecode"
        objects.append(b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(body), head, body))
        kids.append(len(objects) + 1)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Rotate %d /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (p.get("width", 612), p.get("height", 792), p.get("rotate", 0), len(objects)))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = b"%PDF-1.7\n", []
    for k, o in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k + 1, o)
    table = b"".join(b"%010d 00000 n \n" % x for x in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def docx(paragraphs: list[str]) -> bytes:
    body = "".join("<w:p><w:r>" + "<w:br/>".join("<w:tab/>".join(f'<w:t xml:space="preserve">{escape(t)}</w:t>' for t in line.split("\t")) for line in p.split("\n")) + "</w:r></w:p>" for p in paragraphs)
    return _zip({"word/document.xml": f'<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def xlsx(sheets: dict[str, dict[tuple[int, int], str]]) -> bytes:
    """sheets: name to {(row, col): text}; numbers are written as numbers, other texts as shared strings."""
    shared: dict[str, int] = {}
    parts, entries, rels = {}, "", ""
    for k, (name, cells) in enumerate(sheets.items(), 1):
        rows = ""
        for r in sorted({x for x, _ in cells}):
            rows += f'<row r="{r}">'
            for c in sorted(y for x, y in cells if x == r):
                v, ref = cells[r, c], f"{letters.name(c)}{r}"
                rows += f'<c r="{ref}"><v>{v}</v></c>' if v.isdigit() else f'<c r="{ref}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>'
            rows += "</row>"
        parts[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet><sheetData>{rows}</sheetData></worksheet>"
        entries += f'<sheet name="{escape(name)}" sheetId="{k}" r:id="r{k}"/>'
        rels += f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>'
    parts["xl/workbook.xml"] = f'<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{entries}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f"<Relationships>{rels}</Relationships>"
    parts["xl/sharedStrings.xml"] = "<sst>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>"
    return _zip(parts)
