"""Frames of decoded lines from plain tables.

The engine's input is ``lines(doc_id, page_no, block_no, line_no, x0, y0, x1, y1, size, text)`` and
``pages(doc_id, page_no, width, height)``, one row for every page with or without text. ``binder``
makes ten-page volumes of each source's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.operators.layout import SIZE, page_size

#: Ranges of sources up to which their offsets are broadcast (some 40 bytes each).
MOST_OFFSETS = 200_000
#: Sheets of mixed volumes, by the remainder of the text's id: letter, A4, both lying (fixed values).
SHEETS = ((612.0, 792.0), (595.0, 842.0), (792.0, 612.0), (842.0, 595.0))


def sheet(number: Column) -> dict[str, Column]:
    """Width and height of the page that holds the text of this number."""
    kind = F.pmod(number, F.lit(len(SHEETS))).cast("int")
    return {side: F.get(F.array(*[F.lit(s[k]) for s in SHEETS]), kind) for k, side in enumerate(SIZE)}


def text_lines(pages: DataFrame) -> DataFrame:
    """Lines of (doc_id, page_no, text[, width, height]): y by line, size by place and length.

    Lines fill the page between margins of 40 and 52 points, and its width but for 72 points a side.
    """
    cut = pages.withColumn("_l", F.split(F.coalesce("text", F.lit("")), "\n")).withColumns({f"_{side}": page_size(pages, side) for side in SIZE})
    rows = cut.select("doc_id", "page_no", "_width", "_height", F.size("_l").alias("_n"), F.posexplode("_l").alias("line_no", "text"))
    y0 = F.when(F.col("_n") > 1, 40.0 + (F.col("_height") - 92.0) * F.col("line_no") / (F.col("_n") - 1)).otherwise(40.0)
    size = F.when((F.col("line_no") == 0) & (F.length("text") <= 60), 18.0).when(F.length("text") <= 40, 14.0).otherwise(10.0)
    return rows.select(
        "doc_id", "page_no", F.lit(0).alias("block_no"), "line_no", F.lit(72.0).alias("x0"), y0.alias("y0"),
        (72.0 + F.least(F.col("_width") - 144.0, 5.5 * F.length("text"))).alias("x1"), (y0 + 10.0).alias("y1"), size.alias("size"), "text",
    )


def volumes(docs: DataFrame, pages_each: int = 10, rows_each: int = 50_000) -> DataFrame:
    """(doc_id, page_no, text, number) of volumes: ``pages_each`` documents of a source in order of doc_id.

    Ranks come in two steps, so no source, however large, is sorted in one task: ids are cut into
    ranges of about ``rows_each`` rows, a range's offset is the number of rows in those before it, and
    the rank inside it is a window over that range alone.
    """
    lo, hi, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    span = max(1, -(-((hi or 0) - (lo or 0) + 1) // max(1, -(-n // rows_each))))
    cut = docs.select("source", "doc_id", "text", F.floor((F.col("doc_id") - F.lit(lo or 0)) / span).alias("_g"))
    sizes = cut.groupBy("source", "_g").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("source").alias("_s"), F.col("_g").alias("_k"), F.coalesce(before, F.lit(0)).alias("_o"))
    # A few rows for each source: texts stay where the ranks have put them, unless there are very many sources.
    offsets = F.broadcast(offsets) if offsets.limit(MOST_OFFSETS + 1).count() <= MOST_OFFSETS else offsets
    inner = cut.withColumn("_i", F.row_number().over(Window.partitionBy("source", "_g").orderBy("doc_id", "text")) - 1)
    ranked = inner.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & F.col("_g").eqNullSafe(F.col("_k")))
    rank = F.col("_o") + F.col("_i")
    pages = ranked.select(
        F.concat_ws("-", "source", F.floor(rank / pages_each).cast("string")).alias("doc_id"), (rank % pages_each + 1).cast("int").alias("page_no"), "text",
        F.col("doc_id").alias("number"),
    )
    return pages


def binder(docs: DataFrame, pages_each: int = 10, rows_each: int = 50_000) -> DataFrame:
    """Lines of volumes, all pages of the default size."""
    return text_lines(volumes(docs, pages_each, rows_each))


def mixed_binder(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, pages) of volumes whose sheets differ from page to page."""
    pages = volumes(docs)
    pages = pages.withColumns(sheet(F.col("number")))
    return text_lines(pages), pages.select("doc_id", "page_no", *SIZE)


def prose(docs: DataFrame) -> DataFrame:
    return text_lines(docs.select("doc_id", F.lit(1).alias("page_no"), "text"))


def partly_scanned(docs: DataFrame, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """(lines, pages) of texts as documents of two pages, the second blank.

    Documents of every ``every``-th id stand for scans: their pages are decoded and hold no text.
    """
    first = docs.select("doc_id", F.lit(1).alias("page_no"), "text").withColumns(sheet(F.col("doc_id")))
    pages = first.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page_no"), *SIZE)
    return text_lines(first.filter(F.coalesce(F.pmod("doc_id", F.lit(every)) != 0, F.lit(True)))), pages
