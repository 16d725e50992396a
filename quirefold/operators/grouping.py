"""Numbering, counts and groups of sections."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.plain import paragraphs
from quirefold.operators.layout import key_type, streamed
from quirefold.operators.post import BLANK_LINES, DEFINITION, NOTHING, unrepeated


def numbered(outline: DataFrame) -> DataFrame:
    """Adds ``code``: a counter for each of 3 to 6 levels; at level L counter L goes up and deeper ones are 0.

    Outlines are short, so this is one fold per document over an array, in the JVM.
    """
    rest = [c for c in outline.columns if c != "doc_id"]
    packed = outline.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in rest if c != "pos"]))).alias("a"), F.max("level").alias("m"))
    depth = F.least(F.lit(6), F.greatest(F.lit(3), "m"))
    kind = "array<array<int>>"

    def add(acc, x):
        level = F.greatest(F.lit(1), F.least(x["level"], depth))
        last = F.coalesce(F.get(acc, F.size(acc) - 1), F.array_repeat(F.lit(0), depth))
        now = F.transform(last, lambda n, i: F.when(i + 1 < level, n).when(i + 1 == level, n + 1).otherwise(0))
        return F.concat(acc, F.array(now)).cast(kind)

    counters = F.aggregate("a", F.array().cast(kind), add)
    codes = F.transform(counters, lambda c: F.array_join(c.cast("array<string>"), "."))
    both = packed.select("doc_id", F.explode(F.arrays_zip(F.col("a").alias("a"), codes.alias("code"))).alias("e"))
    return both.select("doc_id", "e.a.*", "e.code").select(*outline.columns, "code")


def line_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n"), lambda x: x.rlike(r"(?U)\S"))).cast("long")


def major_level(outline: DataFrame) -> DataFrame:
    """(doc_id, major): the lowest level that occurs twice, else the lowest."""
    n = outline.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("n") >= 2, F.col("level"))), F.min("level")).alias("major"))


def major_groups(outline: DataFrame) -> DataFrame:
    """Adds ``grp``: pos of the latest major entry, or of the first for rows before it.

    All windows lie within a document, so rows are shuffled once.
    """
    doc = Window.partitionBy("doc_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "level"))
    major = F.coalesce(F.min(F.when(F.col("_n") >= 2, F.col("level"))).over(doc), F.min("level").over(doc))
    o = outline.withColumn("_n", n).withColumn("_major", major).withColumn("_own", F.when(F.col("level") == F.col("_major"), F.col("pos")))
    latest = F.last("_own", ignorenulls=True).over(doc.orderBy("pos"))
    return o.withColumn("grp", F.coalesce(latest, F.min("_own").over(doc))).drop("_n", "_major", "_own")


def segments(sections: DataFrame) -> DataFrame:
    """One row per group ``grp`` of sections: its entry's title, level and file, first and last page, characters.

    The entry is the row whose ``pos`` is the group's name; rows before the first one are in its group.
    """
    own = lambda c: F.max(F.when(F.col("pos") == F.col("grp"), F.col(c))).alias(c)
    return sections.groupBy("doc_id", "grp").agg(
        own("title"), own("level"), F.min_by("start", "pos").alias("page_start"), F.max_by("end", "pos").alias("page_end"),
        F.max("section_file").alias("file"), F.sum("char_count").cast("long").alias("char_count"),
    )


def viewer_groups(outline: DataFrame) -> DataFrame:
    """Adds the file that each row shows under and its depth; rows before the first file go."""
    w = Window.partitionBy("doc_id")
    base = F.min(F.when(F.col("section_file").isNotNull(), F.col("level"))).over(w)
    o = outline.withColumn("shown_in", F.last("section_file", ignorenulls=True).over(w.orderBy("pos")))
    depth = F.least(F.lit(4), F.greatest(F.lit(1), F.col("level") - base + 1))
    return o.withColumn("depth", depth).filter(F.col("shown_in").isNotNull())


DEFINED = re.compile(r"(?m)^\s*<sup>(\d{1,3})</sup>\s+")
MARKER = re.compile(r"<sup>(\d{1,3})</sup>")
EARLY = 500  # characters of a body in which a marker counts as its own


def returned(before: str, here: str) -> tuple[str, str]:
    """Moves definitions back to the section before, where their marker is and they are missing."""
    own = paragraphs(here)
    noted = [(m[1], p) for p in own if (m := DEFINITION.match(p))]
    text = "\n\n".join(p for p in own if not DEFINITION.match(p))
    defined = set(DEFINED.findall(before))

    def goes(number: str) -> bool:
        at = before.find(f"<sup>{number}</sup>")
        return at >= 0 and number not in defined and (at < EARLY or f"<sup>{number}</sup>" not in text)

    moved = [p for number, p in noted if goes(number)]
    if not moved:
        return before, here
    left = "\n\n".join(p for p in own if p not in moved).strip()
    return "\n\n".join([*paragraphs(before), *moved]).strip(), left or NOTHING


def without_orphans(before: str, here: str) -> str:
    """Removes markers whose definition is only in the section before, with the blank in front of them."""
    gone = set(MARKER.findall(here)) & set(DEFINED.findall(before)) - set(DEFINED.findall(here))
    for number in sorted(gone):
        here = re.sub(rf"\s*<sup>{number}</sup>", "", here)
    return BLANK_LINES.sub("\n\n", here).strip() or NOTHING


def by_document(sections: DataFrame, change: Callable[[list[str]], list[str]]) -> DataFrame:
    """Replaces the bodies of each document's sections, in order of ``pos``."""
    own = sections.select("doc_id", "pos", "body")
    schema = f"doc_id {key_type(own, 'doc_id')}, pos int, body string"

    def fold(k: tuple, rows: list[tuple]) -> Iterator[tuple]:
        for (doc, pos, _), body in zip(rows, change([r[2] or "" for r in rows]), strict=True):
            yield doc, pos, body

    if set(sections.columns) == set(own.columns):
        return streamed(own, ["doc_id"], ["pos"], fold, schema)
    return sections.drop("body").join(streamed(own, ["doc_id"], ["pos"], fold, schema), ["doc_id", "pos"]).select(*sections.columns)


def rebalance(bodies: list[str]) -> list[str]:
    bodies = list(bodies)
    for k in range(1, len(bodies)):
        bodies[k - 1], bodies[k] = returned(bodies[k - 1], bodies[k])
    return bodies


def unorphan(bodies: list[str]) -> list[str]:
    bodies = list(bodies)
    for k in range(1, len(bodies)):
        bodies[k] = without_orphans(bodies[k - 1], bodies[k])
    return bodies


def rebalanced(sections: DataFrame) -> DataFrame:
    """Footnote definitions go back to the section before, where their marker is.

    A fold over a document's sections, as a move changes what the next pair sees.
    """
    return by_document(sections, rebalance)


def orphan_markers(sections: DataFrame) -> DataFrame:
    """Footnote markers go whose definition is only in the section before, pair after pair."""
    return by_document(sections, unorphan)


def footnotes_settled(sections: DataFrame, autojunk: bool = True) -> DataFrame:
    """Both passes over a document's sections, then each body without repeats, in one fold."""
    return by_document(sections, lambda b: [unrepeated(x, autojunk) for x in unorphan(rebalance(b))])
