"""Pipe tables from cells and from outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import cell_escape, clean_line, match_key

#: Header of five-column rubric tables (fixed values).
RUBRIC = ("Categories", "Level 1", "Level 2", "Level 3", "Level 4")


def row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown_table(cells: Column, rubric_tables: bool = True) -> Column:
    """Pipe table of an array of rows; null without two rows, two columns and a body.

    Rows are padded to the widest, blank ones dropped. A five-column table whose first row isn't the
    rubric's header gets that header and keeps its first row. Further rubric headers and rows of
    dashes go.
    """
    width = F.array_max(F.transform(cells, F.size))
    padded = F.transform(cells, lambda r: F.transform(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), clean_line))
    full = F.filter(padded, lambda r: F.exists(r, lambda c: c != ""))

    def is_rubric(r: Column) -> Column:
        rest = F.lower(F.array_join(F.slice(r, 2, 4), " "))
        named = F.contains(F.lower(F.get(r, F.lit(0))), F.lit("categories"))
        return F.coalesce((F.size(r) >= 5) & named & F.contains(rest, F.lit("level 1")) & F.contains(rest, F.lit("level 4")), F.lit(False))

    dashes = lambda r: F.forall(r, lambda c: c.rlike("^(-{2,})?$"))
    first = F.get(full, F.lit(0))
    forced = (width == 5) & F.lit(rubric_tables) & ~is_rubric(first)
    head = F.when(forced, F.array(*[F.lit(x) for x in RUBRIC])).otherwise(first)
    rest = F.when(forced, full).otherwise(F.slice(full, 2, F.greatest(F.size(full), F.lit(1))))
    body = F.filter(rest, lambda r: ~is_rubric(r) & ~dashes(r))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    shown = lambda r: row(F.transform(r, cell_escape))
    lines = F.concat(F.array(shown(head), rule), F.transform(body, shown))
    return F.when((width >= 2) & (F.size(full) >= 2) & (F.size(body) > 0), F.array_join(lines, "\n"))


#: Fixed value: what a contents table begins with.
CONTENTS = "## Table of Contents\n\n| Section | Page |\n|---|---:|\n"


def contents_line(page: str) -> Column:
    """An entry's line of the contents table; null for one whose key and page came before, or without a title."""
    title = clean_line(F.col("title"))
    first = F.row_number().over(Window.partitionBy("doc_id", match_key(F.col("title")), page).orderBy("pos")) == 1
    line = F.concat(F.lit("| "), cell_escape(title), F.lit(" | "), F.col(page).cast("string"), F.lit(" |\n"))
    return F.when(first & (title != ""), line)


def outline_table(outline: DataFrame, page: str = "page_start") -> DataFrame:
    """(doc_id, md): contents table of an outline, one row for each title key and page."""
    lines = outline.withColumn("_line", contents_line(page)).filter("_line is not null")
    rows = F.array_sort(F.collect_list(F.struct("pos", "_line")))
    return lines.groupBy("doc_id").agg(F.concat(F.lit(CONTENTS), F.array_join(rows["_line"], "")).alias("md"))
