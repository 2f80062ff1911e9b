"""Plain PDF files: text to PDF, PDF to text, page counts.  No layout, no OCR: pages of lines in one fixed-width face."""

from __future__ import annotations

import re
import textwrap
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

LINES, COLUMNS, SIZE, LEADING = 54, 90, 10, 13
_STREAM = re.compile(rb"(<<(?:[^<>]|<<[^<>]*>>)*>>)\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_SHOWN = re.compile(rb"\[((?:\\.|\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ|(\((?:\\.|[^\\()])*\))\s*(?:Tj|'|\")|(T\*|T[dD]\b|ET\b)", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def write_pdf(text: str) -> bytes:
    """A PDF of ``text``, wrapped; characters outside Latin-1 become question marks."""
    lines = [part for line in text.split("\n") for part in textwrap.wrap(line, COLUMNS) or [""]]
    pages = [lines[a : a + LINES] for a in range(0, len(lines), LINES)]
    first = 4
    kids = " ".join(f"{first + 2 * k} 0 R" for k in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    for k, page in enumerate(pages):
        shown = b"\n".join(b"(" + re.sub(rb"([\\()])", rb"\\\1", x.encode("latin-1", "replace")) + b") Tj T*" for x in page)
        body = zlib.compress(b"BT /F1 %d Tf %d TL 50 750 Td\n%s\nET" % (SIZE, LEADING, shown))
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents {first + 2 * k + 1} 0 R >>".encode())
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body))
    out, places = b"%PDF-1.4\n", []
    for n, x in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, x)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))


def _unescape(raw: bytes) -> str:
    raw = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), raw)
    return re.sub(rb"\\(\r\n|.)", lambda m: b"" if m[1] in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(m[1], m[1]), raw, flags=re.S).decode("cp1252", "replace")


def _streams(data: bytes) -> list[bytes]:
    out = []
    for head, body in _STREAM.findall(data):
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        out.append(body)
    return out


def page_count(data: bytes | None) -> int:
    """Page objects, those in compressed object streams included."""
    data = data or b""
    return len(_PAGE.findall(_STREAM.sub(b"", data))) + sum(len(_PAGE.findall(s)) for s in _streams(data) if b"/Type" in s)


def read_pdf(data: bytes | None) -> str:
    """The text that a PDF's content streams show, by lines; files that are no PDF, and scans, give an empty text."""
    lines = [""]
    for stream in _streams(data or b""):
        if b"BT" not in stream:
            continue
        for array, single, move in _SHOWN.findall(stream):
            if move:
                lines.append("")
            else:
                lines[-1] += "".join(_unescape(x) for x in _STRING.findall(array or single))
    return "\n".join(x for x in lines if x.strip())


@F.pandas_udf(StructType([StructField("raw_text", StringType()), StructField("n_pages", IntegerType())]))
def _parsed(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"raw_text": [read_pdf(x) for x in content], "n_pages": [page_count(x) for x in content]})


@F.pandas_udf(BinaryType())
def to_pdf(text: pd.Series) -> pd.Series:
    return pd.Series([write_pdf(x or "") for x in text])


def read_pdf_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``path, raw_text, n_pages`` of every ``*.pdf`` below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root)
    return files.select("path", _parsed("content").alias("x")).select("path", "x.*")
