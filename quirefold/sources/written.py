"""What ``sinks.write_files`` has written, read back by tasks: listings, outlines, texts.

``root`` is the folder of the documents' folders. Listings hold no contents, and contents are read for
the files that are asked for alone. Spark's file source would hold the state of every file on the driver
and read some thirty of these small files a task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from itertools import islice
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirefold.operators.readback import combined_parts, outline_with_files, without_preamble
from quirefold.plans.sinks import opened

ENTRIES = (
    "array<struct<id:string, level:int, title:string, page_start:int, source:string, y0:double, line_count:bigint, char_count:bigint, section_file:string>>"
)
SEGMENTS = "array<struct<id:string, title:string, level:int, page_start:int, page_end:int, file:string, char_count:bigint>>"
NO_DOCUMENT = "\u0001"
NO_OUTLINE, BAD_OUTLINE = "outline.json not found. Run conversion first.", "outline.json holds no list."


@F.pandas_udf(StringType())
def document_of(folder: pd.Series) -> pd.Series:
    """The document that a folder's name was made from; names that end in a digest stay as they are."""
    special = {"%": "", "%null": None}
    return folder.map(lambda x: special[x] if x in special else x if re.search(r"%~[0-9a-f]{32}$", x) else unquote(x))


def hidden(name: str) -> bool:
    """Whether Spark's file sources pass over a file or folder of this name."""
    return name[0] in "._" or name.endswith("._COPYING_")


def parts_of(spark: SparkSession) -> int:
    """Number of tasks that folders and files are dealt to; names are too small for their size to tell it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def folders(spark: SparkSession, root: str) -> DataFrame:
    """(folder): names of the documents' folders, dealt to tasks. The root is one listing, of names alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for _ in batches:
            if isinstance(system, fs.LocalFileSystem):  # names as they come, without a look at each folder
                with os.scandir(base) as found:
                    names = (x.name for x in found if x.is_dir())
                    while some := [*islice(names, 10_000)]:
                        yield pa.RecordBatch.from_pydict({"folder": [n for n in some if not hidden(n)]})
            else:
                names = [x.base_name for x in system.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.Directory]
                yield pa.RecordBatch.from_arrays([pa.array([n for n in names if not hidden(n)], pa.string())], names=["folder"])

    # A range has eight bytes, by which Spark would take all that is listed and read for small; of an RDD it knows no size.
    # Adaptive plans still judge listings by the folders they come from, so joins with listings and texts say "merge".
    one = spark.createDataFrame(spark.sparkContext.parallelize([(0,)], 1), "n int")
    return one.mapInArrow(run, "folder string").repartition(parts_of(spark), "folder")


def listed(spark: SparkSession, root: str, pattern: str | None = None, name: str | None = None) -> DataFrame:
    """(doc_id, path, place, modified, length) of files; ``path`` is below the document's folder, ``place`` the whole one.

    Each folder is listed by the task that it is dealt to, so no listing comes to the driver.
    ``pattern`` is of names; ``name`` asks for one file of each document's folder, without a listing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for folder in (f for b in batches for f in b.column("folder").to_pylist()):
            home = f"{base.rstrip('/')}/{folder}"
            found = system.get_file_info([f"{home}/{name}"] if name else fs.FileSelector(home, recursive=True))
            rows = [(x.path[len(home) + 1 :], x) for x in found if x.is_file]
            rows = [(p, x) for p, x in rows if not any(map(hidden, p.split("/"))) and (not pattern or fnmatchcase(x.base_name, pattern))]
            if rows:
                columns = [[folder] * len(rows), [p for p, _ in rows], [x.path for _, x in rows], [x.mtime_ns // 1_000_000 * 1000 for _, x in rows], [x.size for _, x in rows]]
                types = [pa.string(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["folder", "path", "place", "modified", "length"])

    rows = folders(spark, root).mapInArrow(run, "folder string, path string, place string, modified timestamp, length bigint")
    return rows.select(document_of(F.col("folder")).alias("doc_id"), "path", "place", "modified", "length")


def texts_of(spark: SparkSession, root: str, pattern: str | None = None, name: str | None = None) -> DataFrame:
    """(doc_id, path, text) of the files that ``listed`` tells; a folder's files are dealt to tasks one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(root)
        rows: list[tuple] = []
        size = 0
        for doc, path, place in (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("doc_id", "path", "place")], strict=True)):
            with system.open_input_stream(place) as file:
                rows.append((doc, path, file.read()))
            size += len(rows[-1][2])
            if size >= 1 << 23 or len(rows) >= 5000:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "path", "content"])

    dealt = listed(spark, root, pattern, name).select("doc_id", "path", "place").repartition(parts_of(spark), "place")
    return dealt.mapInArrow(run, "doc_id string, path string, content binary").select("doc_id", "path", F.decode("content", "UTF-8").alias("text"))


def entries_of(json: Column, kind: str = ENTRIES) -> Column:
    """The entries that a text holds as a JSON list; null for any other text."""
    return F.when(json.rlike(r"\A\s*\["), F.from_json(json, kind))


def outlines(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, pos, entry columns): the entries of every outline.json, whose files exist or are null."""
    found = texts_of(spark, root, name="outline.json")
    entries = found.select("doc_id", F.posexplode(entries_of(F.col("text"))).alias("pos", "e")).select("doc_id", "pos", "e.*")
    return outline_with_files(entries, listed(spark, root).select("doc_id", "path"))


def segments(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, n, entry columns): the entries of every segments.json, numbered from 1."""
    found = texts_of(spark, root, name="segments.json")
    return found.select("doc_id", F.posexplode(entries_of(F.col("text"), SEGMENTS)).alias("n", "e")).select("doc_id", (F.col("n") + 1).alias("n"), "e.*")


def payloads(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, outline_markdown, n_entries, message) of every document's folder; a missing outline.md is empty."""
    text = lambda name: texts_of(spark, root, name=name).select("doc_id", F.col("text").alias(name.split(".")[1]))
    docs = listed(spark, root).select("doc_id").distinct()
    both = docs.join(text("outline.json").hint("merge"), "doc_id", "left").join(text("outline.md").hint("merge"), "doc_id", "left")
    entries = entries_of(F.col("json"))
    message = F.when(F.col("json").isNull(), NO_OUTLINE).when(entries.isNull(), BAD_OUTLINE)
    return both.select("doc_id", F.coalesce("md", F.lit("")).alias("outline_markdown"), F.coalesce(F.size(entries), F.lit(0)).alias("n_entries"), message.alias("message"))


def section_texts(spark: SparkSession, root: str, plain: bool = False) -> DataFrame:
    """(doc_id, path, text) of Markdown files; parts of a file are one text, under the first part's name without its number.

    ``plain`` texts come without heading and metadata lines.
    """
    md = texts_of(spark, root, "*.[mM][dD]").filter("path <> 'outline.md'")
    named = md.select(F.concat(F.coalesce("doc_id", F.lit(NO_DOCUMENT)), F.lit("\u0000"), F.col("path")).alias("path"), "text")
    out = combined_parts(named).withColumn("_p", F.split("stem", "\u0000"))
    out = out.select(F.nullif(F.get("_p", F.lit(0)), F.lit(NO_DOCUMENT)).alias("doc_id"), F.concat(F.get("_p", F.lit(1)), F.lit(".md")).alias("path"), "text")
    return out.withColumn("text", without_preamble(F.col("text"))) if plain else out
