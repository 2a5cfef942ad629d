"""Text of docx, xlsx and pdf files, from their bytes."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shipping import ship


def docx_text(data: bytes) -> str:
    xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8")
    parts = ("".join(re.findall(r"<w:t(?:\s[^>]*)?>(.*?)</w:t>", p, re.DOTALL)) for p in xml.split("</w:p>"))
    return "\n".join(unescape(p) for p in parts if p)


def xlsx_text(data: bytes) -> str:
    """Sheets under headings, cells of a row joined by tabs; a cell's type holds wherever its attribute stands."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        xml = book.read("xl/sharedStrings.xml").decode("utf-8")
        shared = ["".join(re.findall(r"<t(?:\s[^>]*)?>(.*?)</t>", s, re.DOTALL)) for s in re.findall(r"<si>(.*?)</si>", xml, re.DOTALL)]
    out = []
    for no, name in enumerate(sorted(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), 1):
        out.append(f"## Sheet{no}")
        for row in re.findall(r"<row\b[^>]*>(.*?)</row>", book.read(name).decode("utf-8"), re.DOTALL):
            cells = []
            for attrs, body in re.findall(r"<c\b([^>]*?)(?:/>|>(.*?)</c>)", row, re.DOTALL):
                value = re.search(r"<v>(.*?)</v>", body, re.DOTALL)
                inline = "".join(re.findall(r"<t(?:\s[^>]*)?>(.*?)</t>", body, re.DOTALL))
                cells.append(unescape(shared[int(value[1])] if value and 't="s"' in attrs else value[1] if value else inline))
            out.append("\t".join(cells))
    return "\n".join(out)


def pdf_text(data: bytes) -> str:
    """Strings shown by Tj and TJ in the page streams, a line per text block."""
    out = []
    for raw in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", data, re.DOTALL):
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        for block in re.findall(rb"BT(.*?)ET", raw, re.DOTALL):
            shown = re.findall(rb"\(((?:\\.|[^\\()])*)\)", block, re.DOTALL)
            text = re.sub(rb"\\([()\\])", rb"\1", b"".join(shown)).decode("latin-1")
            if text:
                out.append(text)
    return "\n".join(out)


READERS = {"docx": docx_text, "xlsx": xlsx_text, "pdf": pdf_text}


def document_texts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """files (path, content as bytes) with text; null where the file cannot be read or is of another kind."""
    ship(files.sparkSession)

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paths, contents in batches:
            texts = []
            for p, c in zip(paths, contents, strict=True):
                try:
                    texts.append(READERS[p.rsplit(".", 1)[-1].lower()](c))
                except (KeyError, IndexError, ValueError, AttributeError, zipfile.BadZipFile):
                    texts.append(None)
            yield pd.Series(texts, dtype="object")

    return files.withColumn("text", read(F.col(path), F.col(content)))
