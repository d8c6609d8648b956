"""Document readers over ``binaryFile``: one row per file, never failing the job.

Plain text, CSV and JSON use the standard library; PDF needs an optional
library and otherwise gives a row with success = false, as broken files do."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, format string, text string, page_count int, metadata map<string,string>, success boolean, error string"
FORMATS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "csv": "csv", "json": "json", "txt": "text", "md": "text", "log": "text"}


def decode(raw: bytes) -> str:
    for name in ("utf-8", "utf-16", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeError:
            continue
    return raw.decode("latin-1")


def read_text(raw: bytes, rows: int | None = None) -> tuple[str, dict]:
    t = decode(raw).strip()
    return t, {"char_count": len(t)}


def read_csv(raw: bytes, rows: int | None = None) -> tuple[str, dict]:
    """Cells stripped, empty ones dropped, ' | ' between; all rows, or the first ``rows``, are shown and all counted."""
    lines = [" | ".join(c.strip() for c in row if c.strip()) for row in csv.reader(io.StringIO(decode(raw)))]
    lines = [x for x in lines if x]
    return "\n".join(lines[:rows]), {"row_count": len(lines)}


def _strings(x) -> Iterator[str]:
    todo = [x]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            if len(v.strip()) > 3:
                yield v.strip()
        elif isinstance(v, dict):
            todo.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            todo.extend(reversed(v))


def read_json(raw: bytes, rows: int | None = None) -> tuple[str, dict]:
    """String values longer than three characters, depth first; all, or the first ``rows``, are shown and all counted."""
    found = list(_strings(json.loads(decode(raw))))
    return "\n".join(found[:rows]), {"items_extracted": len(found)}


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx(raw: bytes, rows: int | None = None) -> tuple[str, dict]:
    """Paragraphs outside tables, then table rows with ' | ' between filled cells."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = [words(p) for p in body.findall(f"{_W}p") if words(p).strip()]
    for table in body.iter(f"{_W}tbl"):
        for row in table.iter(f"{_W}tr"):
            cells = [words(c).strip() for c in row.findall(f"{_W}tc")]
            if any(cells):
                out.append(" | ".join(c for c in cells if c))
    return "\n".join(out).strip(), {"paragraph_count": len(out)}


def read_pdf(raw: bytes, rows: int | None = None) -> tuple[str, dict]:
    try:
        import pypdf
    except ImportError:
        raise RuntimeError("pdf reader not available") from None
    reader = pypdf.PdfReader(io.BytesIO(raw))
    pages = [(i, (p.extract_text() or "").strip()) for i, p in enumerate(reader.pages, 1)]
    return "\n\n".join(f"--- Page {i} ---\n{t}" for i, t in pages if t), {"page_count": len(pages)}


READERS = {"text": read_text, "csv": read_csv, "json": read_json, "docx": read_docx, "pdf": read_pdf}


def extract(path: str, raw: bytes | None, rows: int | None = None) -> tuple:
    kind = FORMATS.get(os.path.splitext(path)[1].lower().lstrip("."), "text")
    try:
        if raw is None:
            raise ValueError("no content")
        text, meta = READERS[kind](raw, rows)
        return path, kind, text, int(meta.pop("page_count", 1)), {k: str(v) for k, v in meta.items()}, True, None
    except Exception as e:  # one broken file is one row
        return path, kind, "", 0, {}, False, f"{type(e).__name__}: {e}"[:300]


#: Rows and bytes of content that a task reads at a time, and hands on before it reads more.
ROWS, BYTES = 256, 8 << 20


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(size):
        if i > start and (i - start == ROWS or held + n > BYTES):
            yield b.slice(start, i - start)
            start, held = i, 0
        held += n
    if size:
        yield b.slice(start)


def extract_documents(files: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows (path, content) to rows of SCHEMA; with ``rows`` only so many CSV rows and JSON strings of a file are shown.
    A task holds the texts of a few files at a time, however many come in one Arrow batch."""
    schema = pa.schema([(n, {"int": pa.int32(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}.get(t, pa.string())) for n, t in (c.split(" ") for c in SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in _slices(b):
                made = zip(*(extract(p, c, rows) for p, c in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in col] if pa.types.is_map(f.type) else col, f.type) for f, col in zip(schema, made, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_files(spark: SparkSession, path: str, glob: str = "*", rows: int | None = None) -> DataFrame:
    """Every file below ``path`` whose name matches ``glob``, those of zero length too, which the
    scan leaves out: they are the listed files that it gives no row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    listed = [(re.sub("^file:/+", "file:/", unquote(f)),) for f in found.inputFiles()]
    scanned = found.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"))
    empty = spark.createDataFrame(listed, "path string").join(scanned, "path", "left_anti")
    return extract_documents(found.select("path", "content").unionByName(empty.select("path", F.lit(b"").alias("content"))), rows)
