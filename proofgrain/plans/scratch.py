"""Scratch folders and packed files for queries that exercise file sources."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from proofgrain.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _xml(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _zip(entries: dict[str, bytes]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in entries.items():
            archive.writestr(zipfile.ZipInfo(name), data)
    return buffer.getvalue()


def docx_bytes(text: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{_xml(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
    return _zip({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>".encode()})


def docx_table_bytes(rows: list[list[tuple[int, str]]]) -> bytes:
    """A document with one table; a cell is (span, text)."""
    def cell(span, text):
        props = f'<w:tcPr><w:gridSpan w:val="{span}"/></w:tcPr>' if span > 1 else ""
        return f"<w:tc>{props}<w:p><w:r><w:t>{_xml(text)}</w:t></w:r></w:p></w:tc>"

    trs = "".join("<w:tr>" + "".join(cell(s, t) for s, t in row) + "</w:tr>" for row in rows)
    return _zip({"word/document.xml": f"<w:document {_W}><w:body><w:tbl>{trs}</w:tbl></w:body></w:document>".encode()})


def xlsx_bytes(text: str) -> bytes:
    lines = text.split("\n")
    shared = "".join(f"<si><t>{_xml(line)}</t></si>" for line in lines)
    cells = "".join(f'<row><c t="s"><v>{i}</v></c></row>' for i in range(len(lines)))
    return _zip({
        "xl/sharedStrings.xml": f"<sst>{shared}</sst>".encode(),
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>".encode(),
    })


def eml_bytes(subject: str, text: str) -> bytes:
    return (
        f"Subject: {subject}\nFrom: sender@example.org\nTo: reader@example.org\n"
        "MIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n" + text
    ).encode("utf-8")


def zip_bytes(entries: dict[str, bytes]) -> bytes:
    return _zip(entries)


FILES = 200  # packed files that leave a task at once


def pack(df: DataFrame, make, schema: str) -> DataFrame:
    """Rows -> packed files, a few at a time; ``make(row)`` gives output tuples."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                out.extend(make(row))
                if len(out) >= FILES:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, schema)
