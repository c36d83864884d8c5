"""Files of a folder as a table: listing without reading, and text with page offsets of the files that are wanted."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.ingest import supported, visible
from lodestone.sources.tables import spread

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BETWEEN_PAGES = "\n\n"


def _status(spark: SparkSession, root: str):
    """Hadoop's status of ``root``; a missing one is an error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(root)
    return fs.getFileStatus(at)


def folders_of(spark: SparkSession, roots: list[str]) -> list[str]:
    """Those of ``roots`` that are folders, as their paths are listed."""
    found = [_status(spark, root) for root in roots]
    return [plain(s.getPath().toString()) for s in found if s.isDirectory()]


def plain(path: str) -> str:
    """A local path without its scheme; others as they are."""
    return re.sub(r"^file:/+", "/", path)


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``path, mtime, size`` of the supported files of folders (at any depth, without names that begin with a dot below the
    folder) and single files, of any Hadoop file system. Contents aren't read. A file below two roots is listed once, a
    root that doesn't exist is an error."""
    made = None
    for root in roots:
        status = _status(spark, root)
        own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        path = F.regexp_replace("path", "^file:/+", "/")
        rows = own.select(path.alias("path"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("length").alias("size")).where(supported(F.col("path")))
        if status.isDirectory():
            rows = rows.where(visible(F.col("path"), plain(status.getPath().toString())))
        made = rows if made is None else made.unionByName(rows)
    return made.dropDuplicates(["path"])


def read_bytes(path: str) -> bytes:
    """The content of one file, local or of a scheme that Arrow's file systems know."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_stream(at) as f:
        return f.read()


def read_docx(data: bytes) -> str:
    """Paragraphs that aren't blank, then the rows of all tables, cells joined by bars; blank lines between."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    parts = [text(p) for p in body.findall(f"{_W}p")]
    for grid in body.iter(f"{_W}tbl"):
        parts += [" | ".join("\n".join(text(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")) for row in grid.findall(f"{_W}tr")]
    return "\n\n".join(p for p in parts if p.strip())


def read_pdf(data: bytes) -> tuple[str, list[tuple[int, int, int]]]:
    """Text and page ranges; empty pages have none but count. Needs pypdf."""
    import pypdf

    reader = pypdf.PdfReader(io.BytesIO(data))
    if reader.is_encrypted:
        raise ValueError("encrypted PDF")
    parts, pages, at = [], [], 0
    for number, page in enumerate(reader.pages, 1):
        text = (page.extract_text() or "").strip()
        if text:
            pages.append((number, at, at + len(text)))
            parts.append(text)
            at += len(text) + len(BETWEEN_PAGES)
    if not parts:
        raise ValueError("no text in PDF")
    return BETWEEN_PAGES.join(parts), pages


def extract_one(path: str, data: bytes | None) -> tuple[str | None, list[tuple[int, int, int]], str | None]:
    """Text, pages and error; whatever a parser raises is the error, never an exception."""
    try:
        kind = (re.search(r"(\.[^./]*)$", path or "") or [""])[0].lower()
        if data is None:
            raise ValueError("no content")
        if kind in (".md", ".txt"):
            return data.decode("utf-8", "replace"), [], None
        if kind == ".docx":
            return read_docx(data), [], None
        if kind == ".pdf":
            text, pages = read_pdf(data)
            return text, pages, None
        raise ValueError(f"unsupported file type {kind!r}")
    except Exception as e:  # noqa: BLE001 - any damage of a file is a row, not a failed job
        return None, [], f"{type(e).__name__}: {e}"[:500]


def missing(files: DataFrame) -> DataFrame:
    """The rows of ``files`` (with ``path``) whose file exists no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            gone = []
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                gone.append(system.get_file_info(at).type == fs.FileType.NotFound)
            yield batch.filter(pa.array(gone, pa.bool_()))

    return files.mapInArrow(run, files.schema)


#: Characters of text that a task holds before it hands them on.
HELD = 1 << 24


def extract(wanted: DataFrame, opened=None) -> DataFrame:
    """``path, content_hash, text, pages, error`` of the files ``path``, which tasks open one after another; no other file is
    opened. A file that can't be read or parsed has an error and no text. ``opened``: an accumulator of files opened."""
    kind = pa.list_(pa.struct([("page", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
    names = ["path", "content_hash", "text", "pages", "error"]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        pages = pa.array([[{"page": n, "start": s, "stop": e} for n, s, e in r[3]] for r in rows], kind)
        columns = [pages if i == 3 else pa.array([r[i] for r in rows], pa.string()) for i in range(5)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if opened is not None:
                    opened.add(1)
                try:
                    data = read_bytes(path)
                except Exception as e:  # noqa: BLE001 - a file may be gone or locked by now
                    rows.append((path, None, None, [], f"{type(e).__name__}: {e}"[:500]))
                    continue
                rows.append((path, hashlib.sha256(data).hexdigest(), *extract_one(path, data)))
                held += len(rows[-1][2] or "")
                if held > HELD:
                    yield packed(rows)
                    rows, held = [], 0
        yield packed(rows)

    source = spread(wanted.select("path").distinct(), 4)
    return source.mapInArrow(run, "path string, content_hash string, text string, pages array<struct<page:int,start:int,stop:int>>, error string")
