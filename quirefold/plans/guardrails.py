"""Rules that every written result must keep, as joins over what was read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import strip

#: Fixed value: the text of a section that is marked as one without text.
NO_TEXT = "(No extractable text in this range.)"


def faults(outline: DataFrame, segments: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, rule, id) of entries that break a rule; none in a sound result.

    Q-01: an outline entry (doc_id, id, level, page_start, title) has a level and a page of 1 at least,
    and a title. Q-02: a segment (doc_id, id, file, page_start, page_end, char_count) has a file among
    ``texts`` (doc_id, path, text without preamble), and, unless that is marked as without text, a page
    range in order and characters. Q-03: no two segments of a document share a file; each of them is told.
    """
    at_least = lambda c: F.coalesce(F.col(c) >= 1, F.lit(False))
    named = strip(F.coalesce("title", F.lit(""))) != ""
    first = outline.filter(~(at_least("level") & at_least("page_start") & named)).select("doc_id", F.lit("Q-01").alias("rule"), "id")
    there = texts.select("doc_id", F.col("path").alias("file"), (strip(F.col("text")) == NO_TEXT).alias("_blank"), F.lit(True).alias("_there"))
    own = segments.select("doc_id", "id", "file", "page_start", "page_end", "char_count").join(there.hint("merge"), ["doc_id", "file"], "left")
    sound = F.coalesce((F.col("page_start") <= F.col("page_end")) & (F.col("char_count") > 0), F.lit(False))
    second = own.filter(F.col("_there").isNull() | ~(F.col("_blank") | sound)).select("doc_id", F.lit("Q-02").alias("rule"), "id")
    many = segments.groupBy("doc_id", "file").agg(F.collect_list("id").alias("ids")).filter(F.size("ids") > 1)
    third = many.select("doc_id", F.lit("Q-03").alias("rule"), F.explode("ids").alias("id"))
    return first.unionByName(second).unionByName(third)


def report(outline: DataFrame, segments: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, n_entries, n_segments, q01, q02, q03): a document's entries, segments and faults by rule."""
    one = lambda df, c: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(c))
    found = faults(outline, segments, texts).groupBy("doc_id").agg(*[F.count(F.when(F.col("rule") == r, 1)).alias(c) for r, c in (("Q-01", "q01"), ("Q-02", "q02"), ("Q-03", "q03"))])
    out = one(outline, "n_entries").join(one(segments, "n_segments"), "doc_id", "full").join(found.hint("merge"), "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_entries", "n_segments", "q01", "q02", "q03")])
