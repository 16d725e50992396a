"""Outlines: from a table of contents, or from font sizes; repair and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import LONGEST, clean_line, has_text, heading_shaped, match_key, repair_mojibake
from quirefold.operators.layout import key_type, page_size, streamed

# Words after which a heading goes on, and words with which it goes on.
TAIL_WORDS = ("for", "and", "or", "to", "in", "on", "of", "with", "program", "course", "grade")
LEAD_WORDS = ("and", "or", "for", "to", "in", "of", "the")
ENTRY = "doc_id string, pos int, level int, title string, page_start int, y0 double, source string"


def font_cutoff(lines: DataFrame) -> DataFrame:
    """(doc_id, cutoff) = max(P75, P50 + 1) of sizes. Sizes are few: value counts, not all values.

    The value at a rank is the first whose running count exceeds it, so no document's lines are
    gathered in one row.
    """
    counts = lines.filter("size > 0 and text <> ''").groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("doc_id")
    run = counts.withColumn("_run", F.sum("n").over(w.orderBy("size"))).withColumn("_all", F.sum("n").over(w))
    at = lambda p: F.min(F.when(F.col("_run") > F.floor((F.col("_all") - 1) * F.lit(p).cast("double")), F.col("size")))
    return run.groupBy("doc_id").agg(F.greatest(at(0.75), at(0.5) + 1.0).alias("cutoff"))


def heading_candidates(lines: DataFrame, cleaned: bool = False) -> DataFrame:
    """Lines large and short enough for a heading; the first of each lower-cased text.

    Only lines of the size are cleaned: the text depends on the cutoff, so no test of it moves below the join.
    Of lines that are ``cleaned`` already, those too long for a heading aren't shuffled.
    """
    own = lines.filter(has_text(F.col("text")))
    short = own.filter(F.length("text") <= LONGEST) if cleaned else own
    large = short.join(font_cutoff(own), "doc_id").filter(F.col("size") >= F.col("cutoff"))
    text = F.col("text") if cleaned else clean_line(F.col("text"))
    large = large.withColumn("text", F.when(F.col("size") >= F.col("cutoff"), text)).filter(heading_shaped(F.col("text")))
    first = Window.partitionBy("doc_id", F.lower("text")).orderBy("page_no", "block_no", "line_no")
    return large.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "cutoff")


def heading_levels(headings: DataFrame) -> DataFrame:
    """Adds level = min(3, rank of the size rounded to 0.1) and ``pos``."""
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.bround("size", 1).desc()))
    order = Window.partitionBy("doc_id").orderBy("page_no", "y0", "level", F.lower("text"), "line_no")
    h = headings.withColumn("level", F.least(F.lit(3), rank))
    return h.withColumn("pos", (F.row_number().over(order) - 1).cast("int"))


def joins(a: str, b: str) -> bool:
    """Whether heading text ``b`` continues ``a``."""
    if a[-1:] in "\\.:;!?":
        return False
    one, two = a.split(), b.split()
    led = two[0].lower() in LEAD_WORDS
    if len(one) <= 6 and len(two) <= 6 and (two[0][:1].islower() or one[-1].lower() in TAIL_WORDS or a.endswith("-") or led):
        return True
    return len(one) >= 6 and len(two) <= 8 and ("," in b or len(a) >= 35 or led)


def wrapped_headings(headings: DataFrame) -> DataFrame:
    """Joins titles that run over several lines: greedy, in reading order, per document."""
    own = headings.select("doc_id", "page_no", "y0", "size", "text", "block_no", "line_no")
    schema = f"doc_id {key_type(own, 'doc_id')}, page_no int, y0 double, size double, text string, line_no int"

    def fold(k, rows):
        now = None
        for doc, page, y0, size, text, _, line in rows:
            near = now and now[1] == page and abs(now[3] - size) <= 0.2 and abs(y0 - now[2]) <= 90.0
            if near and joins(now[4], text):
                now = (*now[:4], f"{now[4]} {text}", now[5])
            else:
                if now:
                    yield now
                now = (doc, page, y0, size, text, line)
        if now:
            yield now

    return streamed(own, ["doc_id"], ["page_no", "y0", "block_no", "line_no"], fold, schema, whole=False)


def normalized(outline: DataFrame) -> DataFrame:
    """Cleans titles, makes pages monotone, clamps levels and drops near repeats, as one fold.

    Outlines have hundreds of rows, so the fold is an aggregate() over an array and stays in the JVM.
    """
    title = clean_line(repair_mojibake(F.col("title")))
    rows = outline.withColumn("title", title).filter("title <> ''").withColumn("_key", match_key(F.col("title")))
    packed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "level", "title", "page_start", "y0", "source", "_key"))).alias("a"))
    kind = "array<struct<pos:int,level:int,title:string,page_start:int,y0:double,source:string,_key:string>>"

    def add(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        page = F.greatest(F.lit(1), x["page_start"], F.coalesce(last["page_start"], F.lit(1)))
        level = F.greatest(F.lit(1), F.when(F.size(acc) > 0, F.least(x["level"], last["level"] + 1)).otherwise(x["level"]))
        recent = F.slice(acc, F.greatest(F.size(acc) - 7, F.lit(1)), F.lit(8))
        again = F.exists(recent, lambda e: (e["_key"] == x["_key"]) & (page - e["page_start"] <= 2))
        kept = F.struct(F.size(acc).alias("pos"), level.alias("level"), x["title"].alias("title"), page.alias("page_start"), x["y0"].alias("y0"), x["source"].alias("source"), x["_key"].alias("_key"))
        return F.when(again, acc).otherwise(F.concat(acc, F.array(kept)).cast(kind))

    folded = packed.select("doc_id", F.explode(F.aggregate("a", F.array().cast(kind), add)).alias("e"))
    return folded.select("doc_id", "e.pos", "e.level", "e.title", "e.page_start", "e.y0", "e.source")


def from_toc(toc: DataFrame) -> DataFrame:
    t = toc.withColumn("title", clean_line(F.col("title"))).filter("title <> '' and level is not null and page is not null")
    one = lambda c: F.greatest(F.lit(1), F.col(c)).cast("int")
    return t.select("doc_id", F.col("toc_no").alias("pos"), one("level").alias("level"), "title", one("page").alias("page_start"), F.lit(None).cast("double").alias("y0"), F.lit("pdf-outline").alias("source"))


def anchored(outline: DataFrame, lines: DataFrame) -> DataFrame:
    """Gives entries without y0 that of the line of their page that says their title.

    A line fits that has the title's key, holds it (6 characters or more) or is held by it (8 or
    more). Entries of a page go in order: the key itself before a part, lines from the last anchor
    on before earlier ones, then the nearest to it. An entry no line fits keeps none. Only fitting
    lines are gathered, by page; the order is a fold over them in the JVM.
    """
    entries = outline.withColumn("_t", match_key(F.col("title")))
    rows = lines.select("doc_id", F.col("page_no").alias("page_start"), F.col("y0").alias("_y"), match_key(F.col("text")).alias("_n")).filter("_n <> ''")
    same = F.col("_n") == F.col("_t")
    holds = F.contains("_n", "_t") & (F.length("_t") >= 6)
    held = F.contains("_t", "_n") & (F.length("_n") >= 8)
    open_ = entries.filter("y0 is null and _t <> ''")
    fits = open_.select("doc_id", "page_start", "pos", "_t").join(rows, ["doc_id", "page_start"]).filter(same | holds | held)
    cands = fits.groupBy("doc_id", "pos").agg(F.collect_list(F.struct(F.when(same, 0).otherwise(1).alias("part"), F.col("_y").alias("y"))).alias("c"))
    pages = entries.join(cands, ["doc_id", "pos"], "left").groupBy("doc_id", "page_start").agg(F.array_sort(F.collect_list(F.struct("pos", "y0", "c"))).alias("e"))
    kind = "array<struct<pos:int,y0:double>>"

    def add(acc, e):
        last = acc["last"]
        order = lambda c: F.struct(c["part"], (c["y"] < last - 0.5).cast("int"), F.abs(c["y"] - F.greatest(last, F.lit(0.0))), c["y"].alias("y"))
        y = F.coalesce(e["y0"], F.array_min(F.transform(e["c"], order))["y"])
        return F.struct(F.coalesce(y, last).alias("last"), F.concat(acc["out"], F.array(F.struct(e["pos"].alias("pos"), y.alias("y0")))).cast(kind).alias("out"))

    folded = F.aggregate("e", F.struct(F.lit(-1e9).alias("last"), F.array().cast(kind).alias("out")), add, lambda acc: acc["out"])
    found = pages.select("doc_id", F.inline(folded))
    return outline.drop("y0").join(found, ["doc_id", "pos"]).select(*outline.columns)


def from_fonts(lines: DataFrame, cleaned: bool = False) -> DataFrame:
    h = heading_levels(wrapped_headings(heading_candidates(lines, cleaned)))
    return h.select("doc_id", "pos", "level", F.col("text").alias("title"), F.col("page_no").alias("page_start"), "y0", F.lit("text-heuristic").alias("source"))


def with_fallback(toc: DataFrame, fonts: DataFrame, docs: DataFrame) -> DataFrame:
    """Per document: its table of contents, else headings by font, else one entry."""
    rest = fonts.join(toc.select("doc_id").distinct(), "doc_id", "left_anti")
    have = toc.select("doc_id").union(rest.select("doc_id")).distinct()
    none = docs.join(have, "doc_id", "left_anti")
    return toc.unionByName(rest).unionByName(one_entry(none, F.lit("Document"), "fallback"))


def one_entry(docs: DataFrame, title: Column, source: str) -> DataFrame:
    """An outline of one entry, on page 1, for each document."""
    return docs.select(
        "doc_id", F.lit(0).alias("pos"), F.lit(1).alias("level"), title.alias("title"), F.lit(1).alias("page_start"),
        F.lit(None).cast("double").alias("y0"), F.lit(source).alias("source"),
    )


def collapsed(outline: DataFrame, titles: DataFrame) -> DataFrame:
    """For one output file: outlines found by font become one entry with the document's title."""
    by_font = outline.filter(F.col("source") == "text-heuristic").select("doc_id").distinct()
    whole = one_entry(titles.join(by_font, "doc_id", "left_semi"), F.col("title"), "single-fallback")
    return outline.join(by_font, "doc_id", "left_anti").unionByName(whole)


def document_title(lines: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Up to three long lines of the top of page 1, while they come to at most 140 characters.

    The top is a share of that page's own height. ``docs`` (doc_id): documents to name, also those
    without lines; else all that have one.
    """
    w = Window.partitionBy("doc_id").orderBy("y0", "block_no", "line_no")
    top = lines.filter((F.col("page_no") == 1) & (F.col("y0") <= 0.28 * page_size(lines, "height"))).withColumn("text", clean_line(repair_mojibake(clean_line(F.col("text")))))
    top = top.filter(F.length("text") >= 12).withColumn("_k", F.row_number().over(w)).filter("_k <= 3")
    top = top.withColumn("_len", F.sum(F.length("text") + 1).over(w) - 1)
    fits = top.filter((F.col("_len") <= 140) | (F.col("_k") == 1))
    joined = fits.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_k", "text")))["text"], " ").alias("title"))
    stems = (lines if docs is None else docs).select("doc_id").distinct()
    return stems.join(joined, "doc_id", "left").withColumn("title", F.coalesce("title", F.replace(F.col("doc_id"), F.lit("-"), F.lit(" "))))
