"""Bodies of sections: pages to blocks, blocks to clean text, in one pass over sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import clean_line
from quirefold.operators import layout, post
from quirefold.operators.layout import Line, Table
from quirefold.operators.sections import window_of
from quirefold.operators.tables import markdown_table


def page_tables(tables: DataFrame, rubric_tables: bool = True) -> DataFrame:
    """(doc_id, page_no, x0, y0, x1, y1, md) of decoded tables (..., cells array<array<string>>).

    Tables that make no Markdown go; of those that agree in text and in their edges to 0.1 point one stays.
    """
    t = tables.withColumn("md", markdown_table(F.col("cells"), rubric_tables)).filter("md is not null")
    edge = [F.bround("y0", 1).alias("_a"), F.bround("y1", 1).alias("_b")]
    first = Window.partitionBy("doc_id", "page_no", "_a", "_b", "md").orderBy("x0", "y0")
    own = [c for c in layout.SIZE if c in t.columns]
    t = t.select("doc_id", "page_no", "x0", "y0", "x1", "y1", "md", *own, *edge).withColumn("_k", F.row_number().over(first))
    return t.filter("_k = 1").drop("_a", "_b", "_k")


def section_tables(ranges: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables of each section, cut to its window on the page."""
    own, top, bottom = window_of(ranges, tables)
    own = own.filter((bottom > top) & (F.col("y1") > top) & (F.col("y0") < bottom))
    cut = own.withColumn("_y0", F.greatest("y0", top)).withColumn("_y1", F.least("y1", bottom))
    return cut.select("doc_id", "pos", "page_no", "x0", F.col("_y0").alias("y0"), "x1", F.col("_y1").alias("y1"), "md", layout.page_size(tables, "width").alias("width"))


def page_blocks(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page_no, seq, text): paragraphs and tables of whole pages in reading order.

    Lines that a table covers go. ``tables`` are those of ``page_tables``; a page of tables alone is one too.
    """
    own = lines.select("doc_id", "page_no", "block_no", "line_no", "x0", "y0", "x1", "y1", clean_line(F.col("text")).alias("text"), F.lit(1).alias("kind"), layout.page_size(lines, "width").alias("width"))
    own = layout.outside_tables(own.filter("text <> ''"), tables).select(own.columns)
    drawn = tables.select("doc_id", "page_no", F.lit(0).alias("block_no"), F.lit(0).alias("line_no"), "x0", "y0", "x1", "y1", F.col("md").alias("text"), F.lit(2).alias("kind"), layout.page_size(tables, "width").alias("width"))
    schema = f"doc_id {layout.key_type(own, 'doc_id')}, page_no int, seq int, text string"

    def fold(k: tuple, rows: list[tuple]) -> Iterator[tuple]:
        boxes = [[make(*r[4:9]) for r in rows if r[9] == kind] for kind, make in ((1, Line), (2, Table))]
        for seq, text in enumerate(layout.page_blocks(*boxes, rows[0][10])):
            yield (*k, seq, text)

    return layout.streamed(own.unionByName(drawn), ["doc_id", "page_no"], ["kind", "block_no", "line_no"], fold, schema)


def section_bodies(
    ranges: DataFrame, lines: DataFrame, tables: DataFrame | None = None, keep_footnotes: bool = False, autojunk: bool = True, carried: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, pos, body, is_empty, ...) of every section: ``lines`` (and ``tables``) are those of the sections.

    ``carried`` columns of ``ranges`` go through the fold with the section's titles, so bodies needn't be
    shuffled again to meet them.

    ``ranges`` gives each section's title and, as ``next_title``, the one after it. Every section has
    a row, so one without lines gets the text that says so. Lines arrive without margin noise. Each
    page is laid out by its own width.
    """
    own = lines.filter("text <> ''").select("doc_id", "pos", "page_no", "block_no", "line_no", "x0", "y0", "x1", "y1", "text", F.lit(1).alias("kind"), layout.page_size(lines, "width").alias("width"))
    if tables is not None:
        own = layout.outside_tables(own, tables).select(own.columns)
        drawn = tables.select("doc_id", "pos", "page_no", F.lit(0).alias("block_no"), F.lit(0).alias("line_no"), "x0", "y0", "x1", "y1", F.col("md").alias("text"), F.lit(2).alias("kind"), layout.page_size(tables, "width").alias("width"))
        own = own.unionByName(drawn)
    # Each section's titles come first, as a row of their own; kind 0 sorts before its lines.
    none = F.lit(0.0)
    head_columns = [
        "doc_id", "pos", F.lit(0).alias("page_no"), F.lit(0).alias("block_no"), F.lit(0).alias("line_no"), none.alias("x0"), none.alias("y0"),
        none.alias("x1"), none.alias("y1"), F.concat_ws("\n", "title", "next_title").alias("text"), F.lit(0).alias("kind"), none.alias("width"),
    ]
    heads = ranges.select(*head_columns)
    schema = f"doc_id {layout.key_type(ranges, 'doc_id')}, pos int, body string, is_empty boolean"
    if carried:
        told = F.struct(*carried).alias("carried")
        kind = ranges.select(told).schema["carried"].dataType
        heads = ranges.select(*head_columns, told)
        own = own.withColumn("carried", F.lit(None).cast(kind))
        schema = f"{schema}, carried {kind.simpleString()}"

    def fold(k: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        head = next(rows)
        title, _, next_title = head[9].partition("\n")
        pages = []  # texts; lines are held for a page at a time
        for _, page in groupby(rows, key=lambda r: r[2]):
            own = list(page)
            box = lambda kind, make, own=own: [make(*r[5:10]) for r in own if r[10] == kind]
            blocks = layout.page_blocks(box(1, Line), box(2, Table), own[0][11])
            if blocks:
                pages.append("\n\n".join(blocks))
        body = post.cleaned_section("\n\n".join(pages).strip() or post.NOTHING, title, next_title or None)
        yield (*k, post.post_processed(body, keep_footnotes, autojunk), not pages, *head[12:])

    made = layout.streamed(heads.unionByName(own), ["doc_id", "pos"], ["page_no", "kind", "block_no", "line_no"], fold, schema, whole=False)
    return made.select("doc_id", "pos", "body", "is_empty", "carried.*") if carried else made
