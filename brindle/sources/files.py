"""Files as rows: text, pages, office formats, by suffix. Every file is read whole by the task that holds its row.

``binaryFile`` rows (path, content) go through one Arrow-batched function that picks the reader by suffix; a file that
cannot be read gives a row with its error, and harms no other. Office formats are zip archives of XML, read with the
standard library. A PDF needs a reader from outside: a function from bytes to pages.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pages import upload_text
from ..operators.tables import convert

SUFFIXES = frozenset(".pdf .docx .txt .html .htm .xlsx .pptx".split())
#: Encodings tried in turn; the last one reads any bytes.
ENCODINGS = ("utf-8", "cp1254", "latin-1")
#: A PDF page: its tables (rows of cells) and its text.
PdfPages = list[tuple[list[list[list[str | None]]], str | None]]
PdfReader = Callable[[bytes], PdfPages]

EXTRACTED = "text string, html_format string, error string"


def suffix_of(name: str) -> str:
    return PurePosixPath(name).suffix.lower()


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _joined(e: ElementTree.Element, text: str, breaks: tuple[str, ...] = (), tabs: tuple[str, ...] = ()) -> str:
    """The character data of the elements named ``text`` below ``e``, breaks as line ends."""
    out = []
    for x in e.iter():
        name = _tag(x)
        if name == text:
            out.append(x.text or "")
        elif name in breaks:
            out.append("\n")
        elif name in tabs:
            out.append("\t")
    return "".join(out)


def read_docx(data: bytes) -> str:
    """The body's own paragraphs, one per line; tables, heads and feet are left out."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    body = next(x for x in root if _tag(x) == "body")
    return "\n".join(_joined(p, "t", ("br", "cr"), ("tab",)) for p in body if _tag(p) == "p")


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _value(cell: ElementTree.Element, shared: list[str]):
    kind, v = cell.get("t"), next((x.text for x in cell if _tag(x) == "v"), None)
    if kind == "inlineStr":
        return _joined(cell, "t")
    if v is None:
        return None
    if kind == "s":
        return shared[int(v)]
    if kind == "b":
        return v == "1"
    if kind in ("str", "e", "d"):
        return v
    return float(v) if re.search(r"[.eE]", v) else int(v)


def read_xlsx(data: bytes, keep_falsy: bool = False) -> str:
    """All sheets in the workbook's order, a line per row, cells parted by spaces. Zero, false and empty cells read as
    empty unless ``keep_falsy``. Cells that a sheet leaves out count up to its widest row."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = [_joined(x, "t") for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    target = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in (x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(x) == "sheet"):
        part = target[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        root = ElementTree.fromstring(z.read(part.lstrip("/") if part.startswith("/") else f"xl/{part}"))
        rows: dict[int, dict[int, object]] = {}
        for i, row in enumerate((x for x in root.iter() if _tag(x) == "row"), 1):
            cells = [c for c in row if _tag(c) == "c"]
            rows[int(row.get("r") or i)] = {_column(c.get("r") or "") if c.get("r") else j: _value(c, shared) for j, c in enumerate(cells)}
        wide = max((j + 1 for r in rows.values() for j in r), default=0)
        for i in range(1, max(rows, default=0) + 1):
            values = [rows.get(i, {}).get(j) for j in range(wide)]
            out.append(" ".join(str(v) if v or (keep_falsy and v is not None) else "" for v in values) + "\n")
    return "".join(out)


def read_pptx(data: bytes) -> str:
    """The text of each slide's shapes, slides in order, a line end after each shape and between paragraphs."""
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for _, name in slides:
        tree = next((x for x in ElementTree.fromstring(z.read(name)).iter() if _tag(x) == "spTree"), [])
        for shape in (x for x in tree if _tag(x) == "sp"):
            body = next((x for x in shape if _tag(x) == "txBody"), None)
            lines = [] if body is None else [_joined(p, "t", ("br",)) for p in body if _tag(p) == "p"]
            out.append("\n".join(lines) + "\n")
    return "".join(out)


def pdf_row_lines(row: list[str | None]) -> list[str]:
    """A table row as lines: a cell that ends in a colon takes the next one, two plain cells are a pair, others stand alone."""
    cells = [s for c in row if c and (s := str(c).strip())]
    if len(cells) == 2 and ":" not in cells[0]:
        return [f"{cells[0]}: {cells[1]}"]
    out, waiting = [], None
    for c in cells:
        if waiting is not None:
            out.append(f"{waiting} {c}")
            waiting = None
        elif c.endswith(":"):
            waiting = c
        else:
            out.append(c)
    return out + [waiting] * (waiting is not None)


def read_pdf(data: bytes, pages: PdfReader, plain: PdfReader | None = None, least: int = 100) -> str:
    """Pages below ``## Sayfa n``: table rows as lines, or else the page's text. Where that is too little, the plain
    reader's text of each page."""
    out = []
    for n, (tables, text) in enumerate(pages(data), 1):
        lines = [x for t in tables for row in t for x in pdf_row_lines(row)] if tables else [text.strip()] if text else []
        if lines:
            out.append("\n".join([f"## Sayfa {n}", *lines]))
    whole = "\n\n".join(out)
    if len(whole.strip()) > least or plain is None:
        return whole
    return "\n\n".join(f"## Sayfa {n}\n\n{t.strip()}" for n, (_, t) in enumerate(plain(data), 1) if t and t.strip())


def decode(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "ignore")


def extract_bytes(name: str, data: bytes, pdf: PdfReader | None = None) -> tuple[str | None, str | None, str | None]:
    """(text, HTML layout, error) of one file. A suffix that is not known is an error."""
    kind = suffix_of(name)
    try:
        if kind == ".txt":
            return data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n"), None, None
        if kind in (".html", ".htm"):
            layout, text = convert(decode(data))
            return text, layout, None
        if kind == ".pdf":
            if pdf is None:
                raise ValueError("no reader for PDF files was given")
            return read_pdf(data, pdf), None, None
        if kind in SUFFIXES:
            return {".docx": read_docx, ".xlsx": read_xlsx, ".pptx": read_pptx}[kind](data), None, None
        raise ValueError(f"files of type {kind or 'none'} are not read")
    except Exception as e:  # one file's fault is that file's error
        return None, None, f"{type(e).__name__}: {e}"


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, filename, length, content of the files below ``path``. Content is read where it is asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content")


def extracted(files: DataFrame, pdf: PdfReader | None = None) -> DataFrame:
    """``files`` (filename, content) with text, html_format and error in place of the content."""

    @F.pandas_udf(EXTRACTED)
    def run(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_bytes(n, bytes(c), pdf) for n, c in zip(names, contents)], columns=["text", "html_format", "error"])

    return files.withColumn("_x", run(F.col("filename"), F.col("content"))).drop("content").select("*", "_x.*").drop("_x")


def read_files(spark: SparkSession, path: str, pdf: PdfReader | None = None) -> DataFrame:
    return extracted(binary_files(spark, path), pdf)


def upload_bytes(name: str, data: bytes, pdf: PdfReader | None = None) -> str:
    """An upload that is kept as one row: what is not known is read as UTF-8, with marks for what is not."""
    kind = suffix_of(name)
    if kind == ".docx":
        return read_docx(data)
    if kind == ".pdf":
        if pdf is None:
            raise ValueError("no reader for PDF files was given")
        return "\n".join(t or "" for _, t in pdf(data))
    if kind in (".html", ".htm"):
        return upload_text(data.decode("utf-8", "replace"))
    return data.decode("utf-8", "replace")


def upload_metadata(filename: Column, size: Column, text: Column, upload_date: Column, pages: Column) -> Column:
    """The JSON of a whole upload; ``pages`` (JSON text) is left out where it cannot be parsed."""
    fields = [filename.alias("filename"), F.lower(F.regexp_extract(filename, r"(\.[^.]*)$", 1)).alias("file_type"), upload_date.alias("upload_date"), size.alias("file_size"), F.length(text).alias("content_length")]
    parsed = F.try_parse_json(pages)
    own = F.to_json(F.struct(*fields))
    return F.when(parsed.isNull(), own).otherwise(F.to_json(F.struct(*fields, parsed.alias("pages"))))


def uploads(files: DataFrame, upload_date: Column | None = None, pages: Column | None = None, pdf: PdfReader | None = None) -> DataFrame:
    """One row per file (filename, content): the whole text as chunk 0, no vector, the upload's metadata."""

    @F.pandas_udf("string")
    def run(names: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([upload_bytes(n, bytes(c), pdf) for n, c in zip(names, contents)])

    rows = files.withColumn("_text", run(F.col("filename"), F.col("content")))
    date = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if upload_date is None else upload_date
    meta = upload_metadata(F.col("filename"), F.octet_length("content"), F.col("_text"), date, F.lit(None).cast("string") if pages is None else pages)
    return rows.select("filename", F.lit(0).alias("chunk_index"), F.col("_text").alias("content"), F.lit(None).cast("array<float>").alias("embedding"), meta.alias("doc_metadata"))
