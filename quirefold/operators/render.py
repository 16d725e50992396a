"""Markdown, outline text and HTML."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def section_markdown(metadata: bool = False) -> Column:
    """Heading, optional metadata lines and body of (level, title, start, end, source, body)."""
    head = F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), F.col("level")))), F.lit(" "), F.col("title"))
    lines = F.concat(
        F.lit("\n\n- Level: "), F.col("level").cast("string"), F.lit("\n- Pages: "), F.col("start").cast("string"), F.lit("-"),
        F.col("end").cast("string"), F.lit("\n- Source: "), F.col("source"),
    )
    return F.concat(head, lines if metadata else F.lit(""), F.lit("\n\n"), F.col("body"), F.lit("\n"))


def outline_markdown(outline: DataFrame) -> DataFrame:
    """(doc_id, md): the outline (..., section_file, line_count, char_count) as an indented list in one text."""
    link = F.concat(F.lit("["), F.col("title"), F.lit("]("), F.col("section_file"), F.lit(")"))
    one = F.concat(
        F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("level") - 1)), F.lit("- L"), F.col("level").cast("string"), F.lit(" p"),
        F.col("page_start").cast("string"), F.lit(" "), F.coalesce(link, F.col("title")), F.lit(" (lines: "), F.col("line_count").cast("string"),
        F.lit(", chars: "), F.col("char_count").cast("string"), F.lit(")\n"),
    )
    rows = F.array_sort(F.collect_list(F.struct("pos", one.alias("x"))))
    return outline.groupBy("doc_id").agg(F.concat(F.lit("# Outline\n\n"), F.array_join(rows["x"], "")).alias("md"))


def outline_text(outline: DataFrame) -> DataFrame:
    """(doc_id, text): what a viewer shows without outline.md; a backslash and an n part the entries."""
    one = F.concat(F.lit("L"), F.col("level").cast("string"), F.lit(" p"), F.col("page_start").cast("string"), F.lit(" "), F.col("title"))
    rows = F.array_sort(F.collect_list(F.struct("pos", one.alias("x"))))
    return outline.groupBy("doc_id").agg(F.array_join(rows["x"], "\\n").alias("text"))


# What the lines of a Markdown text are.
HEADING = re.compile(r"(#{1,6})\s+(.*)$")
ITEM = re.compile(r"\s*[-*]\s+(.*)$")
GOES_ON = re.compile(r"\s{2,}\S|\t+\S")
RULE_CELL = re.compile(r":?-{3,}:?")
SUP = re.compile(r"&lt;sup&gt;\s*(\d{1,3})\s*&lt;/sup&gt;", re.I)


def escaped(s: str) -> str:
    """The five entities; superscript numbers keep their tags."""
    return SUP.sub(r"<sup>\1</sup>", html.escape(s).replace("&#x27;", "&#39;"))


def bare_cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]


def is_rule(line: str) -> bool:
    return all(RULE_CELL.fullmatch(c) for c in bare_cells(line))


def to_html(md: str) -> str:
    """Headings, pipe tables under a rule, lists with indented continuations; other lines are paragraphs.

    Blank lines don't end a list. Each tag of a row, and each item, is a line of its own.
    """
    lines = [x.rstrip() for x in md.split("\n")] + [""]
    out: list[str] = []
    at, listed = 0, False

    def table(at: int) -> int:
        out.extend(["<table><thead><tr>", *[f"<th>{escaped(c)}</th>" for c in bare_cells(lines[at])], "</tr></thead><tbody>"])
        at += 2
        while "|" in lines[at]:
            out.extend(["<tr>", *[f"<td>{escaped(c)}</td>" for c in bare_cells(lines[at])], "</tr>"])
            at += 1
        out.append("</tbody></table>")
        return at

    def item(at: int) -> int:
        parts = [ITEM.match(lines[at])[1].strip()]
        at += 1
        while GOES_ON.match(lines[at]) and not ITEM.match(lines[at]) and not HEADING.match(lines[at].strip()) and not heads_table(at):
            parts.append(lines[at].strip())
            at += 1
        out.append(f"<li>{escaped(' '.join(parts))}</li>")
        return at

    heads_table = lambda at: "|" in lines[at] and at + 1 < len(lines) and is_rule(lines[at + 1])
    while at < len(lines) - 1:
        line, heading = lines[at], HEADING.match(lines[at])
        is_item = bool(line) and not heading and not heads_table(at) and bool(ITEM.match(line))
        if line and listed != is_item:
            out.append("<ul>" if is_item else "</ul>")
            listed = is_item
        if not line:
            at += 1
        elif is_item:
            at = item(at)
        elif not heading and heads_table(at):
            at = table(at)
        else:
            n, text = (len(heading[1]), heading[2]) if heading else (0, line.strip())
            out.append(f"<h{n}>{escaped(text)}</h{n}>" if n else f"<p>{escaped(text)}</p>")
            at += 1
    return "\n".join(out + ["</ul>"] * listed)


@F.pandas_udf(StringType())
def markdown_html(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else to_html(x))
