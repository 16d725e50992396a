"""Documents to sections: the whole plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import clean_line, slugify
from quirefold.operators import bodies, grouping, layout, outline, render, sections, tables
from quirefold.plans.sinks import folder_names, json_file
from quirefold.store import passing, stored


@dataclass(frozen=True)
class ConvertOptions:
    """``max_section_chars`` is accepted and not used; ``mode`` is single, major or sections."""

    mode: str = "sections"
    metadata: bool = True
    keep_footnotes: bool = False
    autojunk: bool = True
    rubric_tables: bool = True
    max_section_chars: int = 8000
    decoder: str = "auto"

    def __post_init__(self) -> None:
        if self.mode not in ("single", "major", "sections"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.decoder not in ("auto", "pymupdf"):
            raise ValueError(f"unsupported decoder {self.decoder!r}")


def outlines(lines: DataFrame, toc: DataFrame | None = None, mode: str = "sections", docs: DataFrame | None = None, cleaned: bool = False) -> DataFrame:
    """Per document its contents table, anchored to lines, else headings by font, else one entry.

    ``docs`` (doc_id) are all documents, also those without a line; else those with one. ``cleaned``:
    the lines' texts are.
    """
    fonts = stored(outline.from_fonts(lines, cleaned), "headings")  # read for its rows and for the documents that have any
    own = outline.anchored(outline.from_toc(toc), lines) if toc is not None else fonts.limit(0)
    chosen = outline.with_fallback(own, fonts, (lines if docs is None else docs).select("doc_id").distinct())
    if mode == "single":
        chosen = outline.collapsed(chosen, outline.document_title(lines, docs))
    return sections.front_matter(outline.normalized(chosen))


def spine(lines: DataFrame, pages: DataFrame | None = None, page_counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_count) of every document: by ``page_counts``, else its last page, with or without text."""
    told = lines.select("doc_id", "page_no")
    if pages is not None:
        told = told.unionByName(pages.select("doc_id", "page_no"))
    if page_counts is not None:
        told = told.unionByName(page_counts.select("doc_id", F.col("page_count").alias("page_no")))
        own = page_counts.select("doc_id", F.col("page_count").alias("_own"))
        last = told.groupBy("doc_id").agg(F.max("page_no").alias("_last")).join(own, "doc_id", "left")
        return last.select("doc_id", F.coalesce("_own", "_last").alias("page_count"))
    return told.groupBy("doc_id").agg(F.max("page_no").alias("page_count"))


def convert(
    lines: DataFrame, toc: DataFrame | None = None, options: ConvertOptions | None = None, cells: DataFrame | None = None, page_counts: DataFrame | None = None,
    pages: DataFrame | None = None,
) -> DataFrame:
    """One row per section: doc_id, pos, code, title, level, source, page_start, y0, start, end, line_count,
    char_count, file, body, is_empty. ``cells`` are decoded tables (doc_id, page_no, x0, y0, x1, y1, cells);
    ``pages`` (doc_id, page_no, width, height) all pages, also those without text; ``page_counts``
    (doc_id, page_count) is the last page unless given. Lines and cells that carry width and height
    keep them. A document of ``pages`` without any line has one section, which says that it is empty.

    Decoded lines are written once, cleaned, with their page's size and the keys of its margins; the outline, the noise profile
    and the sections read them. Lines are written again by section, and then the first ones go: so lines are shuffled by page and by
    section one after the other, and the disk never holds both.
    """
    o = options or ConvertOptions()
    with passing(lines.sparkSession) as lasting:
        lines = stored(sections.banded(layout.sized(lines, pages).withColumn("text", clean_line("text"))), "lines", "zstd")
        counts = lasting(spine(lines, pages, page_counts), "spine")
        found = lasting(outlines(lines, toc, o.mode, counts, cleaned=True), "outlines")
        following = F.lead("title").over(Window.partitionBy("doc_id").orderBy("pos"))
        ranges = grouping.numbered(sections.section_ranges(found, counts)).withColumn("next_title", following)
        quiet = sections.denoised(lines, sections.noise_profile(lines, counts))
        own = lasting(sections.section_lines(ranges, quiet).drop(*sections.MARGINS, "size"), "own", "zstd")
    drawn = bodies.section_tables(ranges, bodies.page_tables(layout.sized(cells, pages), o.rubric_tables)) if cells is not None else None
    told = ("code", "title", "level", "source", "page_start", "y0", "start", "end")
    made = bodies.section_bodies(ranges, own, drawn, o.keep_footnotes, o.autojunk, told)
    if o.keep_footnotes:  # without markers both passes and the last one for repeats change nothing
        made = grouping.footnotes_settled(made, o.autojunk)
    return made.select(
        "doc_id", "pos", "code", "title", "level", "source", "page_start", "y0", "start", "end", grouping.line_count(F.col("body")).alias("line_count"),
        F.length("body").cast("long").alias("char_count"), F.concat(F.col("code"), F.lit("-"), slugify(F.col("title")), F.lit(".md")).alias("file"), "body",
        "is_empty",
    )


def with_files(converted: DataFrame, mode: str) -> DataFrame:
    """Adds ``id`` and ``section_file``, the file that an entry stands for (null: it is inside another's)."""
    doc = Window.partitionBy("doc_id")
    synthetic = F.max((F.col("source") == "synthetic-front-matter").cast("int")).over(doc)
    s = converted.withColumn("id", F.concat(F.lit("h"), (F.col("pos") + 1 - synthetic).cast("string")))
    if mode == "sections":
        return s.withColumn("section_file", F.concat(F.lit("Sections/"), F.col("file")))
    if mode == "major":
        name = F.when(F.col("grp") == F.col("pos"), F.concat(F.lit("By Major Heading/"), F.col("file")))
        return grouping.major_groups(s).withColumn("section_file", name)
    return s.withColumn("section_file", F.when(F.col("pos") == 0, F.concat(folder_names(F.col("doc_id").cast("string")), F.lit(".md"))))


def markdown_files(converted: DataFrame, options: ConvertOptions | None = None) -> DataFrame:
    """(doc_id, file, text): the Markdown files of the chosen mode.

    One file for a document starts with its contents when they come from its own contents table.
    """
    o = options or ConvertOptions()
    s = with_files(converted, o.mode).withColumn("md", render.section_markdown(o.metadata))
    if o.mode == "sections":
        return s.select("doc_id", F.col("section_file").alias("file"), F.col("md").alias("text"))
    packed = F.array_sort(F.collect_list(F.struct("pos", "md", "line")))
    plain = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    by = ["doc_id", "grp"] if o.mode == "major" else ["doc_id"]
    s = s.withColumn("line", tables.contents_line("start") if o.mode == "single" else F.lit(None).cast("string"))
    whole = s.groupBy(*by).agg(F.max("section_file").alias("file"), packed.alias("p"), F.max(F.col("source") == "pdf-outline").alias("own"))
    lines = F.filter(F.col("p")["line"], lambda x: x.isNotNull())
    head = F.array(plain(F.concat(F.lit(tables.CONTENTS), F.array_join(lines, ""))))
    contents = F.when(F.lit(o.mode == "single") & F.col("own") & (F.size(lines) > 0), head).otherwise(F.array().cast("array<string>"))
    text = F.concat(F.array_join(F.concat(contents, F.transform(F.col("p")["md"], plain)), "\n\n"), F.lit("\n"))
    return whole.select("doc_id", "file", text.alias("text"))


def outline_rows(converted: DataFrame, mode: str) -> DataFrame:
    """Entries of outline.json and outline.md, in order of ``pos``."""
    return with_files(converted, mode).select("doc_id", "pos", "id", "level", "title", "page_start", "source", "y0", "line_count", "char_count", "section_file")


def segment_rows(converted: DataFrame, mode: str) -> DataFrame:
    """(doc_id, n, id, title, level, page_start, page_end, file, char_count): one for each Markdown file."""
    s = with_files(converted, mode)
    if mode != "major":
        s = s.withColumn("grp", F.lit(0) if mode == "single" else F.col("pos"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("grp"))
    rows = grouping.segments(s).withColumn("n", n).withColumn("id", F.concat(F.lit("s"), F.col("n").cast("string")))
    if mode == "single":
        rows = rows.withColumn("title", F.lit("Document")).withColumn("level", F.lit(1))
    return rows.select("doc_id", "n", "id", "title", "level", "page_start", "page_end", "file", "char_count")


def told_files(converted: DataFrame, mode: str) -> DataFrame:
    """(doc_id, file, text): each document's outline.json, segments.json and outline.md. Bodies aren't read."""
    o = outline_rows(converted, mode)
    listed = render.outline_markdown(o).select("doc_id", F.lit("outline.md").alias("file"), F.col("md").alias("text"))
    return json_file(o, "pos", "outline.json").unionByName(json_file(segment_rows(converted, mode), "n", "segments.json")).unionByName(listed)


def files(converted: DataFrame, options: ConvertOptions | None = None, kept: bool = False) -> DataFrame:
    """(doc_id, file, text): everything that a conversion writes for each document. ``kept``: it is a stored table."""
    converted = converted if kept else stored(converted, "converted")
    return markdown_files(converted, options).unionByName(told_files(converted, (options or ConvertOptions()).mode))
