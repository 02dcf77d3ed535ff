"""Inline Markdown as HTML, and the sizes that image files state about themselves."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .text import INLINE

#: How HTML writes its own signs, and the elements of the marks in text.INLINE, in its order.
_SIGNS = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;"})
_ELEMENTS = ("image", "a", "code", "strong", "strong", "em", "em")
_MARKS = tuple((re.compile(pattern), name) for (pattern, _), name in zip(INLINE, _ELEMENTS, strict=True))
_LINK_TARGET = re.compile(r"\(([^)]*)\)\Z")


def safe_link(href: str) -> str:
    """The link without line ends and outer blanks if it has no scheme or one of http, https and mailto; else empty."""
    bare = href.translate({9: None, 10: None, 13: None}).strip()
    scheme, colon, _ = bare.partition(":")
    named = colon and re.fullmatch(r"[A-Za-z0-9+.-]+", scheme)
    return "" if named and scheme.lower() not in ("http", "https", "mailto") else bare


def inline_html(text: str, kind: int = 0) -> str:
    """Marks become elements, everything else is escaped. A mark is looked for in what earlier kinds have left, so none
    reaches over another's border; nothing is looked for in code, images go, and unsafe links leave their label."""
    if kind == len(_MARKS):
        return text.translate(_SIGNS)
    pattern, name = _MARKS[kind]
    out, at = [], 0
    for m in pattern.finditer(text):
        out.append(inline_html(text[at : m.start()], kind + 1))
        at = m.end()
        if name == "image":
            continue
        if name == "code":
            out.append(f"<code>{m[1].translate(_SIGNS)}</code>")
            continue
        inner, more = inline_html(m[1], kind + 1), ""
        if name == "a":
            href = safe_link(_LINK_TARGET.search(m[0])[1])
            if not href:
                out.append(inner)
                continue
            more = f' href="{href.translate(_SIGNS)}"' + (' target="_blank" rel="noopener"' if href.startswith(("http://", "https://")) else "")
        out.append(f"<{name}{more}>{inner}</{name}>")
    out.append(inline_html(text[at:], kind + 1))
    return "".join(out)


@F.pandas_udf(StringType())
def markdown_html(texts: pd.Series) -> pd.Series:
    """inline_html of each text; null stays null."""
    return texts.map(inline_html, na_action="ignore")


def _jpeg_segments(data: bytes):
    """(marker, body) of the segments before the first scan; ValueError if they are broken."""
    at = 2
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no JPEG marker at byte {at}")
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at + 3 > len(data) and not (at < len(data) and _bare(data[at])):
            return
        marker, at = data[at], at + 1
        if _bare(marker):
            continue
        (size,) = struct.unpack_from(">H", data, at)
        if size < 2 or at + size > len(data):
            raise ValueError("broken JPEG segment")
        yield marker, data[at + 2 : at + size]
        if marker == 0xDA:
            return
        at += size


def _bare(marker: int) -> bool:
    return marker == 0x01 or 0xD0 <= marker <= 0xD9


def exif_orientation(body: bytes) -> int:
    """The orientation in an Exif block; 1 if it doesn't state a number."""
    tiff, order = body[6:], {b"II": "<", b"MM": ">"}.get(body[6:8])
    if not body.startswith(b"Exif\0\0") or order is None or len(tiff) < 8:
        return 1
    magic, first = struct.unpack_from(order + "HI", tiff, 2)
    if magic != 42 or first < 8 or first + 2 > len(tiff):
        return 1
    (entries,) = struct.unpack_from(order + "H", tiff, first)
    for at in range(first + 2, min(first + 2 + 12 * entries, len(tiff) - 11), 12):
        tag, kind, count, value = struct.unpack_from(order + "HHIH", tiff, at)
        if (tag, kind) == (0x0112, 3) and count:
            return value
    return 1


def jpeg_header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, number of components and orientation; ValueError for what is no JPEG or states no size."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    turn = 1
    for marker, body in _jpeg_segments(data):
        if marker == 0xE1:
            found = exif_orientation(body)
            turn = found if found != 1 else turn
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if len(body) < 6:
                raise ValueError("broken JPEG frame")
            height, width, parts = struct.unpack_from(">HHB", body, 1)
            return width, height, parts, turn
    raise ValueError("JPEG without a frame")


_HEADER = StructType([*[StructField(n, IntegerType()) for n in ("width", "height", "components", "orientation")], StructField("error", StringType())])


@F.pandas_udf(_HEADER)
def jpeg_size(files: pd.Series) -> pd.DataFrame:
    """jpeg_header of each file; what can't be read, null included, has an error and no numbers."""
    rows = []
    for data in files:
        try:
            rows.append((*jpeg_header(bytes(data or b"")), None))
        except ValueError as e:
            rows.append((None, None, None, None, str(e)))
    numbers = {f.name: "Int32" for f in _HEADER if f.name != "error"}
    return pd.DataFrame(rows, columns=_HEADER.names).astype(numbers)
