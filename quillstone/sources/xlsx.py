"""Spreadsheet containers: a cell reader and a cell rewriter over ``binaryFile`` rows, with the standard library.

A container is bounded by ``MAX_ARCHIVE``, ``MAX_PARTS`` and ``MAX_EXPANDED`` before any part is opened; a broken one gives
one row with an error_code.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

MAX_ARCHIVE, MAX_EXPANDED, MAX_PARTS = 100 << 20, 250 << 20, 5000
ACTIVE = ("vbaproject", "activex", "embeddings", "oleobject", "controls")
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "doc_id string, sheet string, row int, col int, value string, cell_type string, error_code string"


class ContainerError(ValueError):
    pass


def opened(content: bytes) -> zipfile.ZipFile:
    if len(content) > MAX_ARCHIVE:
        raise ContainerError("XLSX_TOO_LARGE")
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise ContainerError("XLSX_INVALID") from None
    parts = z.infolist()
    if len(parts) > MAX_PARTS or sum(p.file_size for p in parts) > MAX_EXPANDED:
        raise ContainerError("XLSX_TOO_LARGE")
    if any(a in p.filename.lower() for p in parts for a in ACTIVE):
        raise ContainerError("XLSX_ACTIVE_CONTENT")
    return z


def _xml(data: bytes) -> ElementTree.Element:
    head = data.upper()
    if b"<!DOCTYPE" in head or b"<!ENTITY" in head:
        raise ContainerError("XLSX_UNSAFE")
    return ElementTree.fromstring(data)


def sheet_parts(z: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name to part, in workbook order."""
    links = {r.get("Id"): r.get("Target", "") for r in _xml(z.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for s in _xml(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = links.get(s.get(LINK), "")
        out[s.get("name", "")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return out


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in _xml(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def cells_of(content: bytes) -> Iterator[tuple[str, int, int, str, str]]:
    """(sheet, row, col, value, cell_type) of every cell with a value; numbers keep their written form."""
    z = opened(content)
    strings = shared_strings(z)
    for sheet, part in sheet_parts(z).items():
        for c in _xml(z.read(part)).iter(f"{MAIN}c"):
            ref, kind = c.get("r", ""), c.get("t", "n")
            v = c.findtext(f"{MAIN}v")
            if c.find(f"{MAIN}f") is not None:
                value, kind = "=" + (c.findtext(f"{MAIN}f") or ""), "formula"
            elif kind == "s":
                value, kind = strings[int(v)], "string"
            elif kind in ("inlineStr", "str"):
                value, kind = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) or v, "string"
            else:
                value, kind = v, {"n": "number", "b": "boolean", "e": "error", "d": "date"}.get(kind, kind)
            if value is not None and ref:
                yield sheet, int(re.search(r"\d+", ref)[0]), column_number(ref), value, kind


def cells(files: DataFrame) -> DataFrame:
    """The cells of files (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CELLS.split(", ")]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows = [(path, *c, None) for c in cells_of(bytes(content))]
                except ContainerError as e:
                    rows = [(path, None, None, None, None, None, str(e))]
                except (KeyError, IndexError, ValueError, ElementTree.ParseError):
                    rows = [(path, None, None, None, None, None, "XLSX_INVALID")]
                yield pd.DataFrame(rows, columns=names).astype({"row": "Int32", "col": "Int32"})

    return files.select("path", "content").mapInPandas(run, CELLS)


def with_texts(content: bytes, edits: dict[tuple[str, str], str]) -> bytes:
    """The container with the cells of edits ((sheet, reference): text) as inline strings; other cells' bytes stay."""
    z = opened(content)
    by_part: dict[str, dict[str, str]] = {}
    parts = sheet_parts(z)
    for (sheet, ref), text in edits.items():
        by_part.setdefault(parts[sheet], {})[ref] = text
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in z.infolist():
            data = z.read(item.filename)
            for ref, text in by_part.get(item.filename, {}).items():
                inner = f'<is><t xml:space="preserve">{escape(text)}</t></is>'
                pattern = re.compile(rf'<c\b([^>]*\br="{ref}"[^>]*?)(?:/>|>.*?</c>)'.encode(), re.S)

                def cell(m: re.Match, inner: str = inner) -> bytes:
                    kept = re.sub(rb'\s*\bt="[^"]*"', b"", m[1])
                    return b"<c" + kept + b' t="inlineStr">' + inner.encode() + b"</c>"

                data = pattern.sub(cell, data, count=1)
            new.writestr(item, data)
    return out.getvalue()
