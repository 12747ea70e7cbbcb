"""Office and e-mail files: text and table grids, unpacked partition-parallel.

Input rows have ``name`` and ``content``.  A file that cannot be read becomes a row whose
method says so; it never fails the job.
"""

from __future__ import annotations

import email
import email.policy
import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _joined(node, name: str) -> str:
    return "".join(part.text or "" for part in node.iter() if _local(part.tag) == name)


def _tree(data: bytes):
    """The root of an XML part.  Office files declare no document types; one that does could
    blow up by its entities, so it counts as broken."""
    if any("<!DOCTYPE".encode(code) in data for code in ("ascii", "utf-16-le", "utf-16-be")):
        raise ET.ParseError("document type declarations are not read")
    return ET.fromstring(data)


def _docx(data: bytes, blank: bool) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = _tree(archive.read("word/document.xml"))
    lines = (_joined(p, "t").strip() for p in root.iter() if _local(p.tag) == "p")
    return "\n".join(line for line in lines if line or blank)


def _xlsx(data: bytes, blank: bool) -> str:
    values = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            table = _tree(archive.read("xl/sharedStrings.xml"))
            shared = [_joined(item, "t") for item in table if _local(item.tag) == "si"]
        for name in names:
            if not (name.startswith("xl/worksheets/") and name.endswith(".xml")):
                continue
            for cell in _tree(archive.read(name)).iter():
                if _local(cell.tag) != "c":
                    continue
                raw = next((v.text for v in cell if _local(v.tag) == "v" and v.text is not None), "")
                kind = cell.get("t")
                if kind == "inlineStr":
                    raw = _joined(cell, "t")
                elif kind == "s":
                    index = int(raw) if raw.isdigit() else -1
                    raw = shared[index] if 0 <= index < len(shared) else ""
                if raw or blank and kind in ("inlineStr", "s"):
                    values.append(raw)
    return "\n".join(values)


def _eml(data: bytes, blank: bool) -> str:
    message = email.message_from_bytes(data, policy=email.policy.default)
    head = [f"{h.capitalize()}: {message[h]}" for h in ("subject", "from", "to") if message[h]]
    body = message.get_body(preferencelist=("plain", "html"))
    return "\n".join([*head, body.get_content() if body is not None else message.as_string()])


_READERS = {"docx": _docx, "xlsx": _xlsx, "eml": _eml}
#: Texts that leave a task at once, so that it never holds those of a whole batch of files.
TEXTS = 200


def extract_container_text(files: DataFrame, blank: bool = False) -> DataFrame:
    """(source_file, method, text) of docx, xlsx and eml files.

    Empty paragraphs and empty text cells are left out unless ``blank`` asks for their lines."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["source_file", "method", "text"]
        for batch in batches:
            out = []
            for name, content in zip(batch["name"], batch["content"]):
                if len(out) == TEXTS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
                kind = name.rsplit(".", 1)[-1].lower()
                reader = _READERS.get(kind)
                if reader is None:
                    out.append((name, "unsupported", ""))
                    continue
                try:
                    out.append((name, f"local_{kind}", reader(bytes(content), blank)))
                except MemoryError:  # says nothing of the file
                    raise
                except Exception as error:  # an unreadable file is a row, not a failed job
                    out.append((name, f"local_{kind}_failed:{type(error).__name__}", ""))
            yield pd.DataFrame(out, columns=names)

    return files.select("name", "content").mapInPandas(read, "source_file string, method string, text string")


def _span(cell) -> int:
    node = next(cell.iter(f"{WORD}gridSpan"), None)
    value = node.get(f"{WORD}val", "1") if node is not None else "1"
    return max(1, int(value)) if value.isdigit() else 1


def _grid(name: str, data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = _tree(archive.read("word/document.xml"))
    for t, tbl in enumerate(root.iter(f"{WORD}tbl")):
        for r, row in enumerate(tbl.iter(f"{WORD}tr")):
            col = 0
            for cell in row.iter(f"{WORD}tc"):
                span = _span(cell)
                text = "\n".join(filter(None, (_joined(p, "t") for p in cell.iter(f"{WORD}p"))))
                yield name, t, r, col, span, text.strip()
                col += span


GRID_SCHEMA = "doc string, tbl int, row int, col int, span int, text string"
#: Cells that leave a task at once: a frame for each document would cost more than its cells.
CELLS = 10_000


def extract_grid(files: DataFrame) -> DataFrame:
    """Table cells of docx files: (doc, tbl, row, col, span, text), col in visual columns."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, out = ["doc", "tbl", "row", "col", "span", "text"], []
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                try:
                    out += list(_grid(name, bytes(content)))
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    continue
                if len(out) >= CELLS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    docx = files.where("lower(name) like '%.docx'").select("name", "content")
    return docx.mapInPandas(read, GRID_SCHEMA)


def extract_shape(files: DataFrame) -> DataFrame:
    """(doc, paragraphs, tables) of docx files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["name"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                        root = _tree(archive.read("word/document.xml"))
                    tags = [n.tag for n in root.iter()]
                    out.append((name, tags.count(f"{WORD}p"), tags.count(f"{WORD}tbl")))
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    out.append((name, 0, 0))
            yield pd.DataFrame(out, columns=["doc", "paragraphs", "tables"])

    docx = files.where("lower(name) like '%.docx'").select("name", "content")
    return docx.mapInPandas(read, "doc string, paragraphs long, tables long")
