"""Sinks: a document's files as text, and outline and segments as JSON.

``write_files`` puts a document's files below its own folder in three steps, of which each can be run
again: tasks write to staging folders of their own, a table of what the tasks that counted have written
is stored, and from that table files are moved to their places, document by document. So tasks that are
killed, run twice or run again leave one set of files, and what an earlier run left goes last.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirefold.store import stored

#: Folder of the Markdown files of each mode, below a document's.
FOLDERS = {"sections": "Sections", "major": "By Major Heading", "single": ""}
STAGING = "_staging"
LONGEST = 180  # bytes of a name before it is cut
WRITTEN = "doc_id string, file string, staged string, n_chars bigint"


@F.pandas_udf(StringType())
def indented(s: pd.Series) -> pd.Series:
    return s.map(lambda x: json.dumps(json.loads(x), indent=2))


def json_file(rows: DataFrame, order: str, name: str) -> DataFrame:
    """(doc_id, file, text): all rows of a document as an indented JSON array; nulls are written."""
    kept = [c for c in rows.columns if c not in ("doc_id", order)]
    packed = F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*kept).alias("r")))), lambda x: x["r"])
    told = rows.groupBy("doc_id").agg(F.to_json(packed, {"ignoreNullFields": "false"}).alias("text"))
    return told.select("doc_id", F.lit(name).alias("file"), indented(F.col("text")).alias("text"))


def folder_name(doc_id: str | None) -> str:
    """A folder's name for a document, another one for every other document.

    Characters that part or disguise names are written as %XX, as are a leading dot or underscore, so
    no name is hidden, leaves its folder, or is the staging folder. Very long names end in a digest.
    """
    if not doc_id:
        return "%" if doc_id == "" else "%null"  # which no other name becomes
    code = lambda m: "".join(f"%{b:02X}" for b in m[0].encode())
    name = re.sub(r'^[._]|[\x00-\x1f\x7f%/\\:*?"<>|]', code, doc_id)
    if len(name.encode()) > LONGEST:
        cut = name.encode()[:LONGEST].decode(errors="ignore")
        name = f"{cut}%~{hashlib.md5(doc_id.encode()).hexdigest()}"
    return name


@F.pandas_udf(StringType())
def folder_names(s: pd.Series) -> pd.Series:
    return s.map(folder_name)


def file_place(file: str) -> str:
    """A file's path below its document's folder; one that could lead elsewhere is refused."""
    if not file or any(p in ("", ".", "..") for p in file.split("/")) or "\\" in file:
        raise ValueError(f"not a place below a document's folder: {file!r}")
    return file


def opened(root: str):
    """(file system, path) of a folder, given as a path or a URI that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if re.match(r"\w+:", root) else (fs.LocalFileSystem(), root)


def staged(files: DataFrame, root: str, job: str) -> DataFrame:
    """WRITTEN rows: each task writes its files to a folder that no other task, nor another try of it, uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        home, n = f"{base}/{STAGING}/{job}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}", 0
        system.create_dir(home, recursive=True)
        for b in batches:
            rows = []
            for doc, file, text in zip(*[b.column(c).to_pylist() for c in ("doc_id", "file", "text")], strict=True):
                place = f"{home}/{n}"
                with system.open_output_stream(place) as out:
                    out.write(text.encode())
                rows.append((doc, file_place(file), place, len(text)))
                n += 1
            types = [pa.string(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "file", "staged", "n_chars"])

    return files.select(F.col("doc_id").cast("string"), "file", "text").mapInArrow(run, WRITTEN)


def published(written: DataFrame, root: str, mode: str) -> DataFrame:
    """(path, n_chars): moves staged files to their places; one that is there already was moved by an earlier try.

    A document's rows are in one task. Markdown files of the mode that are not among its rows go at the end.
    """
    target = FOLDERS[mode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = opened(root)
        rows = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("doc_id", "file", "staged", "n_chars")], strict=True))
        for doc, group in groupby(rows, key=lambda r: r[0]):
            home, done = f"{base}/{folder_name(doc)}", []
            for _, file, place, n in group:
                to = f"{home}/{file}"
                if system.get_file_info(place).is_file:
                    system.create_dir(to.rpartition("/")[0], recursive=True)
                    if system.get_file_info(to).is_file:
                        system.delete_file(to)
                    system.move(place, to)
                elif not system.get_file_info(to).is_file:
                    raise FileNotFoundError(f"neither staged nor written: {to}")
                done.append((to, n))
            kept = {p for p, _ in done}
            for old in system.get_file_info(fs.FileSelector(f"{home}/{target}".rstrip("/"), allow_not_found=True)):
                if old.is_file and old.path.endswith(".md") and old.path not in kept and (target or old.base_name.lower() != "outline.md"):
                    system.delete_file(old.path)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "n_chars"])

    # A file that is given twice: the last of its staged copies counts.
    one = written.groupBy("doc_id", "file").agg(F.max_by(F.struct("staged", "n_chars"), "staged").alias("w")).select("doc_id", "file", "w.*")
    # Rows are short and moves are not, so the number of tasks is told; by the rows' size they would be one or two.
    parts = int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return one.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "file").mapInArrow(run, "path string, n_chars bigint")


def write_files(files: DataFrame, root: str, mode: str = "sections") -> DataFrame:
    """Writes (doc_id, file, text) below ``root``/folder of doc_id; returns what was written as (path, n_chars).

    ``root`` is a path or URI that all executors see. If a step fails, files of documents that weren't
    reached are as they were. What tasks still wrote then may stay staged until ``clear_staging``.
    """
    job = uuid.uuid4().hex
    try:
        return stored(published(stored(staged(files, root, job), "staged"), root, mode), "written")
    finally:
        clear_staging(root, job)


def clear_staging(root: str, job: str = "") -> None:
    """Deletes what is staged of a job, or of all jobs, of which none may run."""
    system, base = opened(root)
    try:
        system.delete_dir(f"{base}/{STAGING}/{job}".rstrip("/"))
    except FileNotFoundError:  # no task began
        pass
