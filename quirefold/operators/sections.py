"""Running headers, section ranges, and lines of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import is_page_number, margin_key
from quirefold.operators.layout import page_size


MARGINS = ("in_top", "in_bottom", "norm")
BAND = 0.10  # share of a page's height that its top and its bottom margin take


def banded(lines: DataFrame) -> DataFrame:
    """Adds ``in_top`` and ``in_bottom``, by the height of each line's page, and ``norm``, the margin key of lines in either.

    Rows that have all three stay as they are, so a stored table has its keys made once.
    """
    if set(MARGINS) <= set(lines.columns):
        return lines
    height = page_size(lines, "height")
    own = lines.withColumns({"in_top": F.col("y0") <= height * BAND, "in_bottom": F.col("y1") >= height * (1 - BAND)})
    return own.withColumn("norm", F.when(F.col("in_top") | F.col("in_bottom"), margin_key("text")))


def noise_profile(lines: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, band, norm): keys on at least max(2, 15 % of pages) distinct pages of a document.

    Pages of a key are made distinct, then counted; no row holds a document's keys. Without
    ``page_counts`` (doc_id, page_count) a document ends at its last page with a line, which a row
    without a key tells for each page, so lines are read once.
    """
    rows = banded(lines)
    bands = F.array_compact(F.array(F.when(F.col("in_top"), "top"), F.when(F.col("in_bottom"), "bottom"), F.when(F.lit(page_counts is None), "")))
    keys = rows.select("doc_id", "page_no", F.explode(bands).alias("band"), "norm").withColumn("norm", F.when(F.col("band") != "", F.col("norm")))
    pages = keys.filter("band = '' or length(norm) >= 4").distinct().groupBy("doc_id", "band", "norm")
    seen = pages.agg(F.count(F.lit(1)).alias("_n"), F.max("page_no").alias("_last"))
    if page_counts is None:
        seen = seen.withColumn("page_count", F.max("_last").over(Window.partitionBy("doc_id")))
    else:
        seen = seen.join(page_counts.select("doc_id", "page_count"), "doc_id")
    need = F.greatest(F.lit(2), F.ceil(F.col("page_count") * 0.15))
    return seen.filter((F.col("band") != "") & (F.col("_n") >= need)).select("doc_id", "band", "norm")


def denoised(lines: DataFrame, noise: DataFrame) -> DataFrame:
    """Lines without margin noise; page numbers in the bottom band go in any case.

    Only lines of a band meet the noise, so those between them aren't shuffled for it.
    """
    every = banded(lines).filter(~(F.col("in_bottom") & is_page_number("text")))
    rest = every.filter(F.col("norm").isNull())
    rows, n = every.filter(F.col("norm").isNotNull()).alias("l"), noise.alias("n")
    there = ((F.col("n.band") == "top") & F.col("l.in_top")) | ((F.col("n.band") == "bottom") & F.col("l.in_bottom"))
    same = (F.col("l.doc_id") == F.col("n.doc_id")) & (F.col("l.norm") == F.col("n.norm"))
    return rest.select(*lines.columns).unionByName(rows.join(n, same & there, "left_anti").select(*lines.columns))


def front_matter(outline: DataFrame) -> DataFrame:
    """Prepends an entry where the first one is on a later page or below the top of page 1."""
    first = outline.groupBy("doc_id").agg(F.min(F.struct("pos", "page_start", "y0")).alias("f"))
    wanted = first.filter((F.col("f.page_start") > 1) | (F.coalesce("f.y0", F.lit(0.0)) > 2.0))
    extra = wanted.select(
        "doc_id", (F.col("f.pos") - 1).alias("pos"), F.lit(1).alias("level"), F.lit("Front Matter").alias("title"),
        F.lit(1).alias("page_start"), F.lit(0.0).alias("y0"), F.lit("synthetic-front-matter").alias("source"),
    )
    both = outline.select(*extra.columns).unionByName(extra)
    return both.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("int"))


def section_ranges(outline: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Adds start, end (inclusive; start - 1 when empty), y_min and y_max of each entry."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    o = outline.withColumn("_p", F.lead("page_start").over(w)).withColumn("_y", F.lead("y0").over(w))
    o = o.join(page_counts, "doc_id")
    start = F.col("page_start")
    end = (
        F.when(F.col("_p").isNull(), F.col("page_count"))
        .when(F.col("_y").isNotNull(), F.col("_p"))
        .when(F.col("_p") == start, start - 1)
        .otherwise(F.col("_p") - 1)
    )
    end = F.greatest(start - 1, F.least(end, F.col("page_count")))
    return o.select(*outline.columns, start.alias("start"), end.alias("end"), F.col("y0").alias("y_min"), F.when(F.col("_p") == end, F.col("_y")).alias("y_max"))


def window_of(ranges: DataFrame, rows: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Rows of each section's pages (an equi-join), and the top and bottom of its part of the page.

    The last part of a page ends at the page's own height.
    """
    pages = ranges.filter(F.col("end") >= F.col("start")).withColumn("page_no", F.explode(F.sequence("start", "end")))
    joined = pages.select("doc_id", "pos", "page_no", "start", "end", "y_min", "y_max").join(rows, ["doc_id", "page_no"])
    top = F.when(F.col("page_no") == F.col("start"), F.greatest(F.lit(0.0), F.coalesce(F.col("y_min") + 0.5, F.lit(0.0)))).otherwise(0.0)
    bottom = F.when((F.col("page_no") == F.col("end")) & F.col("y_max").isNotNull(), F.col("y_max")).otherwise(page_size(rows, "height"))
    return joined, top, bottom


def section_lines(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of each section, cut by y on its first and last page."""
    joined, top, bottom = window_of(ranges, lines)
    return joined.filter((bottom > top) & (F.col("y1") > top) & (F.col("y0") < bottom)).drop("start", "end", "y_min", "y_max")
