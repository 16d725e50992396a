"""Decoded documents: PDF files, or whatever an opener opens, as rows of pages, spans, tables and contents.

A file is read in parts, each by a task of its own: a part takes an even share of the pages. Files are
listed by Spark's own file source, so any store that Spark reads will do, and no list comes to the
driver. What can't be read becomes a row that says why; other files and pages aren't affected.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quirefold.operators.layout import lines_of_spans
from quirefold.operators.readback import error_class

#: Rows of a decoded document: its pages, lines of spans, cells of tables, entries of its contents table, and failures.
DECODED = (
    "doc_id string, kind string, page_no int, block_no int, line_no int, span_no int, x0 double, y0 double, x1 double, y1 double, "
    "size double, text string, cells array<array<string>>, level int, page_count int, width double, height double"
)
PART_BYTES = 8 << 20
DECODERS = ("auto", "pymupdf")


def decoded_rows(doc_id: str, document, part: int = 0, of: int = 1) -> Iterator[tuple]:
    """DECODED rows of one of ``of`` parts of an open document (page_count; get_toc; pages with rect, get_text, find_tables).

    The first part has the contents table. A page that can't be read gives its failure.
    """
    count = document.page_count
    if part == 0:
        for n, entry in enumerate(document.get_toc(simple=True)):
            if len(entry) >= 3:
                level, title, page = entry[:3]
                yield (doc_id, "toc", int(page), 0, n, 0, None, None, None, None, None, str(title), None, int(level), count, None, None)
    for number in range(1 + part * count // of, 1 + (part + 1) * count // of):
        try:
            rows = list(page_rows(doc_id, number, document.load_page(number - 1), count))
        except Exception as e:
            rows = [failure(doc_id, e, number, count)]
        yield from rows


def page_rows(doc_id: str, number: int, page, count: int) -> Iterator[tuple]:
    size = float(page.rect.width), float(page.rect.height)
    yield (doc_id, "page", number, 0, 0, 0, 0.0, 0.0, *size, None, None, None, None, count, *size)
    for b, block in enumerate(page.get_text("dict").get("blocks", [])):
        for k, line in enumerate(block.get("lines", []) if block.get("type") == 0 else []):
            box = [float(v) for v in line.get("bbox", (0, 0, 0, 0))]
            for j, span in enumerate(line.get("spans", [])):
                yield (doc_id, "span", number, b, k, j, *box, float(span.get("size", 0)), span.get("text", ""), None, None, count, *size)
    try:
        found = page.find_tables().tables
    except Exception:  # a page whose tables can't be found has none
        found = []
    for k, t in enumerate(found):
        if len(t.bbox or ()) >= 4:
            yield (doc_id, "table", number, 0, k, 0, *[float(v) for v in t.bbox[:4]], None, None, t.extract() or [], None, count, *size)


def failure(doc_id: str, error: Exception, page: int | None = None, count: int | None = None) -> tuple:
    return (doc_id, "error", page, 0, 0, 0, None, None, None, None, None, f"{type(error).__name__}: {error}", None, None, count, None, None)


def open_pdf(path: str):
    """A PDF file of any file system that Arrow knows, opened by PyMuPDF."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF on every executor; give decoded frames instead") from e
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)
    with system.open_input_file(inner) as f:
        return fitz.open(stream=f.read(), filetype="pdf")


def stem(path: str) -> str:
    return os.path.splitext(unquote(path).rstrip("/").rsplit("/", 1)[-1])[0]


def part_rows(path: str, part: int, of: int, opener: Callable) -> Iterator[tuple]:
    """DECODED rows of a part of a file; a file that doesn't open gives its failure, once."""
    try:
        document = opener(path)
    except Exception as e:
        if part == 0:
            yield failure(stem(path), e)
        return
    with document:
        yield from decoded_rows(stem(path), document, part, of)


def read_documents(spark: SparkSession, path: str, opener: Callable = open_pdf, part_bytes: int = PART_BYTES, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """DECODED rows of the files below ``path`` whose names fit ``pattern``; doc_id is a file's name without its ending.

    A file of more than ``part_bytes`` is read in as many parts as that takes. No file gives no rows.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    of = F.greatest(F.lit(1), F.ceil(F.col("length") / part_bytes)).cast("int")
    parts = listed.select("path", of.alias("of")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    arrow = to_arrow_schema(StructType.fromDDL(DECODED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        out: list[tuple] = []
        for b in batches:
            for p, n, k in zip(*[b.column(c).to_pylist() for c in ("path", "of", "part")], strict=True):
                for row in part_rows(p, k, n, opener):
                    out.append(row)
                    if len(out) >= 5000:
                        yield batch(out)
                        out = []
        if out:
            yield batch(out)

    return parts.repartition("path", "part").mapInArrow(run, DECODED)


class DocumentSource(DataSource):
    """``spark.read.format("documents").load(path)``: DECODED rows of PDF files, in parts of ``part_bytes``.

    ``path`` is a file or folder, plain or as a URI, that Arrow's file systems and all executors see.
    Executors need PyMuPDF. Option ``decoder``: auto or pymupdf.
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return DECODED

    def reader(self, schema) -> DataSourceReader:
        return DocumentReader(dict(self.options))


class DocumentReader(DataSourceReader):
    opener = staticmethod(open_pdf)

    def __init__(self, options: dict):
        if options.get("decoder", "auto") not in DECODERS:
            raise ValueError(f"unsupported decoder {options['decoder']!r}")
        self.path, self.part_bytes = options.get("path", ""), int(options.get("part_bytes", PART_BYTES))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        uri = re.match(r"\w+:", self.path)
        system, inner = fs.FileSystem.from_uri(self.path) if uri else (fs.LocalFileSystem(), os.path.abspath(self.path))
        told = system.get_file_info(inner)
        found = [told] if told.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
        found = sorted((f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(".pdf"))
        if not found:
            raise FileNotFoundError(f"no .pdf file at {self.path!r}")
        start = self.path[: self.path.index(inner)] if uri and inner in self.path else ""
        return [InputPartition((start + p, k, of)) for p, size in found for of in [max(1, -(-size // self.part_bytes))] for k in range(of)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from part_rows(*partition.value, self.opener)


def frames(decoded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines, contents entries, tables, pages) of DECODED rows, as the plan takes them.

    Lines and tables keep their page's size, so nothing is joined to know it. Pages are all that were
    decoded, with or without text.
    """
    toc = decoded.filter("kind = 'toc'").select("doc_id", F.col("line_no").alias("toc_no"), "level", F.col("text").alias("title"), F.col("page_no").alias("page"))
    cells = decoded.filter("kind = 'table'").select("doc_id", "page_no", "x0", "y0", "x1", "y1", "cells", "width", "height")
    pages = decoded.filter("kind = 'page'").select("doc_id", "page_no", "width", "height")
    return lines_of_spans(decoded.filter("kind = 'span'")), toc, cells, pages


def failures(decoded: DataFrame) -> DataFrame:
    """(doc_id, page_no, message, class) of files, and of pages of files, that could not be read."""
    return decoded.filter("kind = 'error'").select("doc_id", "page_no", F.col("text").alias("message"), error_class(F.col("text")).alias("class"))
