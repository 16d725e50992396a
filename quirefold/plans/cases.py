"""Worked cases of single operators, filled with words of every document.

A case is a text and the result that the operator's description asks for, both with places for words:
{a} to {e} are a document's first five words of lower-case letters, {A} to {E} the same with a capital,
{id} its id. Every document gives one row a case. The SQL fills the expected texts; it never runs the
operator. Expected texts are written out here, so a wrong constant of an operator shows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import grouping, post, readback, render, tables

Query = Callable[[SparkSession, str], DataFrame]
SPARE = ("alpha", "beta", "gamma", "delta", "omega")  # words of documents that have fewer than five
PLACES = re.compile(r"\{(id|[a-eA-E])\}")

#: A paragraph long enough to be judged a repeat.
PROSE = "The quick {a} fox jumps over the {b} dog while twelve more {c} follow on to make it long enough."
NONE = "(No extractable text in this range.)"
HEAD, RULE = "| Categories | Level 1 | Level 2 | Level 3 | Level 4 |", "|---|---|---|---|---|"
META = "# {A}\n\n- Level: 1\n- Pages: 1-2\n- Source: s\n\n"
LOCKED = "Conversion failed: Output files are locked by another program. Close any open section files, folder previews, or editors for the output folder and try again."
CORRUPT = (
    'Conversion failed: The selected file "my file.pdf" could not be parsed as a valid PDF. It may be corrupt, incomplete, or not a real PDF file. '
    "Try opening it in a PDF viewer and exporting/saving a new PDF, then run conversion again.\n\nTechnical details:\nno objects found {a}"
)

#: name: (function, [(input, expected), ...])
CASES: dict[str, tuple[Callable[[Column], Column], list[tuple[str, object]]]] = {
    "case_clean_line": (T.clean_line, [("  {a}\t{b}  ", "{a} {b}"), ("{a}\x01{b}", "{a} {b}"), ("{a} \u00a0\u2003{b}", "{a} {b}"), ("{a}\ufffc{b}", "{a}{b}"), ("", "")]),
    "case_clean_paragraph": (T.clean_paragraph, [("{a} \n\n {b}", "{a} {b}"), ("\n", "")]),
    "case_console_text": (T.console_text, [("é {a}", "? {a}"), ("x" * 90, "x" * 80)]),
    "case_slugify": (T.slugify, [("{A}, {B}!", "{a}-{b}"), ("***", "section"), ("a" * 70, "a" * 64)]),
    "case_match_key": (T.match_key, [("{A} <b>{B}</b> Title!", "{a} {b} title"), ("Été {a}", "t {a}"), ("***", "")]),
    "case_margin_key": (T.margin_key, [("12 {A} 3", "{a}"), ("Page 3 {A}", "{a}"), ("Page 3", "page"), ("Page 3 of 10", "of")]),
    "mojibake": (T.repair_mojibake, [("{a}â€™s", "{a}’s"), ("{a}Â {b}", "{a} {b}"), ("{a}", "{a}"), *[(T.garbled(c, n) + "{a}", c + "{a}") for c in "•–—‘’“”…" for n in (1, 2)]]),
    "mojibake_compat": (lambda c: T.repair_mojibake(c, compat=True), [(T.garbled("•", 3) + "{a}", "â€¢{a}"), (T.garbled("–", 2) + "{a}", "â€“{a}"), (T.garbled("…", 2) + "{a}", "â€¦{a}"), ("â€¢{a}", "â€¢{a}")]),
    "page_number_lines": (T.is_page_number, [("12", True), ("Page 3 of 10", True), ("3/10", True), ("12345", False), ("{a} 3", False)]),
    "bullet_lines": (T.is_bullet, [("• {a}", True), ("- {a}", True), ("12. {a}", True), ("-{a}", False), ("{a} - {b}", False)]),
    "case_heading_shape": (T.heading_shaped, [("abc", False), ("Intro {a}", True), ("- {A}", False), ("one two three four five six seven {a} nine.", False)]),
    "case_cell_escape": (T.cell_escape, [("{a}|{b}", "{a}\\|{b}")]),
    "case_html_escape": (T.html_escape, [("<{a} href=\"x\">&'", "&lt;{a} href=&quot;x&quot;&gt;&amp;&#39;")]),
    "html_escape_sup": (lambda c: T.html_escape(c, keep_sup=True), [("{a}<SUP> 12 </sup> <b>", "{a}<sup>12</sup> &lt;b&gt;"), ("<sup>1234</sup>{a}", "&lt;sup&gt;1234&lt;/sup&gt;{a}")]),
    "section_cleanup": (
        post.step(lambda b: post.cleaned_section(b, "Qzx Scope", "Qzx Methods")),
        [
            ("Qzx Scope\n\nText of the {a} stays.\n\nQzx Methods", "Text of the {a} stays."), ("Guide {A} Affiliates 3\n\nBody text {a}.\n\nRunning {B}", "Body text {a}."),
            ("Qzx Scope", NONE), ("12 A numbered {a} line that is long enough\n\nkept {b}.", "kept {b}."), ("Extract 4 One {a}.\n\nAll in\nLower {b}", "One {a}.\n\nAll in\nLower {b}"), ("", NONE),
        ],
    ),
    "post_readability": (
        post.step(post.readability),
        [
            ("Extract 3 {A}", "{A}"), ("** EXTRACT 12\n{A}", "{A}"), ("• {a}", "- {a}"), ("*{a}", "- {a}"), ("{a} 12 {b}", "{a} <sup>12</sup> {b}"),
            ("{a}.3 {b}", "{a}.<sup>3</sup> {b}"), ("123 The {a}", "<sup>123</sup> The {a}"), ("19 | {A}", "19 | {A}"), ("{a}\n\n\n\n{b}", "{a}\n\n{b}"),
        ],
    ),
    "post_definition_breaks": (post.step(post.definition_breaks), [("<sup>1</sup> Note\n{a}", "<sup>1</sup> Note\n\n{a}"), ("{a} <sup>123</sup> {b}\n{c}", "{a} <sup>123</sup> {b}\n\n{c}"), ("{a}\n{b}", "{a}\n{b}")]),
    "post_attach_markers": (
        post.step(post.attach_markers),
        [("{A}.\n\n<sup>1</sup> {B}", "{A}. <sup>1</sup>\n\n<sup>1</sup> {B}"), ("{A}<sup>1</sup>.\n\n<sup>1</sup> {B}", "{A}<sup>1</sup>.\n\n<sup>1</sup> {B}"), ("<sup>1</sup> {A}", "<sup>1</sup> {A}")],
    ),
    "post_definitions_last": (post.step(post.definitions_last), [("<sup>1</sup> {A}\n\n{B}", "{B}\n\n<sup>1</sup> {A}"), ("{a}\n\n\n\n{b}", "{a}\n\n{b}")]),
    "post_stitch": (post.step(post.stitch), [("Open {a}\n\n{b} on", "Open {a} {b} on"), ("Done {a}.\n\n{b} on", "Done {a}.\n\n{b} on"), ("{a} <sup>1</sup>\n\nB.\n\n{b} on", "{a} <sup>1</sup> {b} on\n\nB.")]),
    "post_dot_leaders": (
        post.step(post.dot_leaders),
        [
            ("{A} .... 1\n{B} . . . . 2\n\nC|D....<sup>3</sup>\n\nend {c}", "| Section | Page |\n|---|---:|\n| {A} | 1 |\n| {B} | 2 |\n| C\\|D | 3 |\n\nend {c}"),
            ("{A} .... 1\nB .... 2", "{A} .... 1\nB .... 2"), ("{A} .... 1\nB .... 2\nC .... 1234", "{A} .... 1\nB .... 2\nC .... 1234"),
        ],
    ),
    "post_course_tables": (
        post.step(post.course_tables),
        [
            (
                "Courses\n\nGrade\nCourse Name\nCourse Type\nCourse Code\nPrerequisite\n10\nStudies {a}\nOpen\nICS2O\nNone\n11\nIntro to {b}\nUniversity\nICS3U\nNone\n12\n"
                "Science | {c}\nUniversity\nICS4U\nGrade 11 Introduction to Computer Science, University\n\nNote: end",
                "Courses\n\n| Grade | Course | Type | Code | Prerequisite |\n|---:|---|---|---|---|\n| 10 | Studies {a} | Open | ICS2O | None |\n| 11 | Intro to {b} | University | ICS3U | None |\n"
                "| 12 | Science \\| {c} | University | ICS4U | Grade 11 Introduction to Computer Science, University |\n\nNote: end",
            ),
            ("Grade\nCourse Name\nCourse Type\nCourse Code\n10\n{a}\nOpen\nICS2O", "Grade\nCourse Name\nCourse Type\nCourse Code\n10\n{a}\nOpen\nICS2O"),
        ],
    ),
    "post_as_follows": (
        post.step(post.as_follows),
        [("It is as follows:\nA. {a}\nB. {b}\n{c}", "It is as follows:\n- A. {a}\n- B. {b}\n{c}"), ("AS FOLLOWS:\n* A. {a} •\n\n- B.  {b}\n| x |\nC. y", "AS FOLLOWS:\n- A. {a}\n\n- B. {b}\n| x |\nC. y")],
    ),
    "post_redundant_table_headers": (
        post.step(post.redundant_table_headers),
        [
            ("Categories\nLevel 1\nLevel 2\nLevel 3\nLevel 4\n| {a} | b |", "| {a} | b |"), ("Intro\n\ncategories\n\nlevel 1\nLevel 2\nLevel 3\nLevel 4\n| {a} | b |", "Intro\n\n| {a} | b |"),
            ("Categories\nLevel 1\nLevel 2\nLevel 3\nLevel 4 {a}", "Categories\nLevel 1\nLevel 2\nLevel 3\nLevel 4 {a}"),
        ],
    ),
    "post_repeated_headers": (post.step(post.repeated_headers), [(f"{HEAD}\n{RULE}\n| {{a}} | b | c | d | e |\n{HEAD}\n{RULE}\n| f | g | h | i | j |", f"{HEAD}\n{RULE}\n| {{a}} | b | c | d | e |\n| f | g | h | i | j |")]),
    "post_row_prefixes": (post.step(post.row_prefixes), [("<sup>19</sup> | {a} |", "| {a} |")]),
    "post_detached_text": (post.step(post.detached_text), [("| {a} | b | {c}", "| {a} | b |\n\n{c}")]),
    "post_bullet_runs": (post.step(post.bullet_runs), [("{a} • {b} • c", "- {a}\n- {b}\n- c"), ("- {a} • b", "- {a}\n- b"), ("# {a} • b", "# {a} • b"), ("* {a} • b", "* {a} • b"), ("• {a}", "• {a}")]),
    "post_bullet_glyphs": (post.step(post.bullet_glyphs), [("{a} • {b}", "{a} {b}"), ("{a}\t\t{b}", "{a} {b}")]),
    "post_no_sup": (post.step(post.no_sup), [("{a}<sup>1</sup>", "{a}1"), ("19 | {A}", "| {A}"), ("  123 | {a}", "| {a}")]),
    "body_dedupe": (post.step(post.unrepeated), [(f"{PROSE}\n\n{{d}}\n\n{PROSE.replace('The quick', 'THE QUICK')}\n\n{{d}}", f"{PROSE}\n\n{{d}}\n\n{{d}}"), (f"{PROSE}\n\n{PROSE[:-4]}xyz", PROSE), ("***", NONE), ("", "")]),
    "md_to_html": (
        lambda c: render.markdown_html(c),
        [
            ("# {A}\n{a}", "<h1>{A}</h1>\n<p>{a}</p>"), ("- {a}\n  goes on\n\n* b<sup>2</sup>\nend", "<ul>\n<li>{a} goes on</li>\n<li>b<sup>2</sup></li>\n</ul>\n<p>end</p>"),
            ("| {a} | b |\n|---|:--:|\n| 1 | 2 |", "<p>| {a} | b |</p>\n<p>|---|:--:|</p>\n<p>| 1 | 2 |</p>"),
            ("{a} | b\n---|:---:\n| 1 | < |\n\nx", "<table><thead><tr>\n<th>{a}</th>\n<th>b</th>\n</tr></thead><tbody>\n<tr>\n<td>1</td>\n<td>&lt;</td>\n</tr>\n</tbody></table>\n<p>x</p>"),
        ],
    ),
    "error_class": (
        readback.error_class,
        [("mupdf {a}: No objects found", "corrupt"), ("FzErrorFormat: {a}", "corrupt"), ("PermissionError: {a}", "locked"), ("[WinError 32] {a}", "locked"), ("EBUSY: permission denied {a}", "other"), ("{a}", "other")],
    ),
    "failure_message": (
        lambda c: readback.failure_message(F.lit(2), c, F.lit("/x/my file.pdf")),
        [("", "Conversion failed with exit code 2."), (" {a} ", "Conversion failed with exit code 2.\n\n{a}"), ("WinError 32 {a}", LOCKED), ("no objects found {a}", CORRUPT)],
    ),
    "dropped_path": (
        readback.dropped_path,
        [("file:///C:/{a}%20b.pdf", "C:/{a} b.pdf"), ("\"/x/{a}.pdf\"", "/x/{a}.pdf"), ("file:///x/{a}+b.pdf", "/x/{a}+b.pdf"), ("file://localhost/{a}.pdf", "/{a}.pdf"), ("file://other/{a}.pdf", ""), ("/C:/{a}.pdf", "C:/{a}.pdf")],
    ),
    "path_tokens": (
        lambda c: F.array_join(readback.path_tokens(c), "¦"),
        [("see \"{a} b.PDF\"\r\nfile:/x/{b}.pdf now", "see \"{a} b.PDF\"¦{a} b.PDF¦file:/x/{b}.pdf now¦file:/x/{b}.pdf¦e:/x/{b}.pdf"), ("at C:\\d\\{a}.pdf", "at C:\\d\\{a}.pdf¦C:\\d\\{a}.pdf"), ("/C:/{a}.pdf", "/C:/{a}.pdf¦C:/{a}.pdf¦/C:/{a}.pdf"), ("", "")],
    ),
    "ellipsized_path": (
        readback.ellipsized,
        [("/home/{a}/documents/archive/2020/january/{b}.pdf", "home/{a}/.../{b}.pdf"), ("/a/{a}.pdf", "/a/{a}.pdf"), ("C:\\Users\\{a}\\Documents\\archive\\of\\all\\{b}.pdf", "C:\\Users\\...\\{b}.pdf"), ("x" * 50, "x" * 50)],
    ),
    "user_error": (
        readback.user_error,
        [
            ("Error: Bad {a}\nTechnical details: x", "Bad {a}"), ("plain {a}", "plain {a}"), ("", "An unexpected error occurred."), ("Error invoking remote method 'run': Error: No {a}\n  PROGRESS: 3", "No {a}"),
            ("y" * 500, "y" * 417 + "..."), ("x" * 416 + "  " + "y" * 9, "x" * 416 + "..."),
        ],
    ),
    "without_preamble": (readback.without_preamble, [(META + "{a}", "{a}"), ("# {A}\n\n{a}", "# {A}\n\n{a}"), ("x\n" + META + "{a}", "x\n" + META + "{a}")]),
    "without_metadata": (readback.without_metadata, [(META + "{a}", "# {A}\n\n{a}"), ("# {A}\n\n{a}", "# {A}\n\n{a}")]),
    "has_metadata": (readback.has_metadata, [(META + "{a}", True), ("# {A}\n\n- Level: 1\n\n{a}", False)]),
    "heading_offset": (lambda c: readback.heading_offset(c, F.lit("The (End)")), [("x the (end)\n\n## the (END) \n{a}", "13"), ("x the (end) {a}", "2"), ("none {a}", "-1")]),
    "local_time": (lambda c: readback.local_time(F.try_to_timestamp(c)), [("2024-03-05 06:07:08", "2024-03-05 06:07"), ("never {a}", "unknown")]),
}

#: Cells of tables, and the Markdown expected of them.
CELLS = [
    ([["{a}", "b"], ["1", "x|y"], ["--", "---"], ["", None]], "| {a} | b |\n|---|---|\n| 1 | x\\|y |"),
    ([["Some Categories", "Level 1", "Level 2", "Level 3", "Level 4 ({a})"], ["{b}", "1", "2", "3", "4"]], "| Some Categories | Level 1 | Level 2 | Level 3 | Level 4 ({a}) |\n|---|---|---|---|---|\n| {b} | 1 | 2 | 3 | 4 |"),
    ([["{a}", "1", "2", "3", "4"], ["Categories", "Level 1", "L2", "L3", "Level 4"]], f"{HEAD}\n{RULE}\n| {{a}} | 1 | 2 | 3 | 4 |"),
    ([["{a}"], ["{b}"]], None),
    ([["{a}", "b"], ["", ""]], None),
    ([["{a}", "b"], ["{c}"]], "| {a} | b |\n|---|---|\n| {c} |  |"),
]
#: Bodies of a document's sections before and after.
MOVED = (["{A}<sup>1</sup> here.", "Other {b}.\n\n<sup>1</sup> The {c}."], ["{A}<sup>1</sup> here.\n\n<sup>1</sup> The {c}.", "Other {b}."])
ORPHANS = (
    ["{A}<sup>1</sup>.\n\n<sup>1</sup> Note.", "More <sup>1</sup> {a}<sup>2</sup>.", "\n<sup>1</sup> "],
    ["{A}<sup>1</sup>.\n\n<sup>1</sup> Note.", "More {a}<sup>2</sup>.", "<sup>1</sup>"],
)
#: Files in parts: (path, text), and (stem, text) expected.
PARTS = (
    [("{id}/a-part-2.md", META + "two {a}\n"), ("{id}/A-PART-10.md", META + "ten\n"), ("{id}/a-part-1.md", META + "one {b}\n"), ("{id}/a.md", "all {c}"), ("{id}/b-part-3.md", META + "b")],
    [("{id}/a", META + "one {b}\n\n\ntwo {a}\n\n\nten\n"), ("{id}/a", "all {c}"), ("{id}/b", META + "b")],
)
#: (stage, sections, age of the newest file, idle seconds, outline is ready) and the state.
BEATS = [("Core extraction complete {a}", 0, 0, 0, False, "exit"), ("{a}", 3, 12, 12, True, "exit"), ("{a}", 3, 11, 12, True, "working"), ("{a}", 0, 50, 50, True, "working"), (None, 3, 50, 50, False, "working")]
MISSING, NOT_PDF, NOT_FOUND, NO_DROP = "Input PDF path is missing.", "Please select a .pdf file.", "The selected PDF file could not be found on disk.", "Please drop a .pdf file."
#: (paths, names, texts) of what was dropped, and the path and message expected; the files that there are.
DROPS = [
    (["/{id}/a.txt", "/{id}/b.pdf"], ["a.txt", "b.pdf"], [], "/{id}/b.pdf", None), ([], [], ["file:///{id}/gone.pdf"], None, NOT_FOUND), (["/{id}/a.txt"], ["a.txt"], [], None, NO_DROP),
    ([], [], ['see "/{id}/c.pdf" {a}'], "/{id}/c.pdf", None), ([], [], [], None, NO_DROP),
]
THERE = ["/{id}/a.txt", "/{id}/b.pdf", "/{id}/c.pdf"]
INPUTS = [("/{id}/b.pdf", None), (" ", MISSING), ("/{id}/a.txt", NOT_PDF), ("/{id}/{a}.pdf", NOT_FOUND), (None, MISSING)]
WANTED = [("Sections/{id}.md", None), ("../{id}.md", "Invalid section path."), ("Sections/{a}-no.md", "Section file not found."), ("Sections/../{id}.md", None), ("{a}/../../{id}.md", "Invalid section path.")]
SECTIONS = ["Sections/{id}.md", "Sections/../{id}.md", "../{id}.md"]


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, id, w): a document's id as text and its first five words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]{3,9}"), F.lit(0))
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("id"), F.slice(F.concat(F.slice(own, 1, 5), F.array(*[F.lit(w) for w in SPARE])), 1, 5).alias("w"))


def fill(template: str | None) -> Column:
    """A template as a Column over ``worded`` rows."""
    if template is None:
        return F.lit(None).cast("string")
    out = F.lit(template)
    for place in sorted(set(PLACES.findall(template))):
        k = "abcde".find(place.lower()) if place != "id" else 0
        word = F.col("id") if place == "id" else F.get("w", F.lit(k))
        out = F.replace(out, F.lit("{" + place + "}"), F.initcap(word) if place.isupper() else word)
    return out


def quoted(s: str | None) -> str:
    return "NULL::VARCHAR" if s is None else "'" + s.replace("'", "''") + "'"


def fill_sql(template: str | None) -> str:
    """The same as SQL over ``w`` (doc_id, id, w)."""
    out = quoted(template)
    for place in sorted(set(PLACES.findall(template or ""))):
        word = "id" if place == "id" else f"w[{'abcde'.find(place.lower()) + 1}]"
        out = f"replace({out}, '{{{place}}}', {f'upper({word}[1]) || {word}[2:]' if place.isupper() else word})"
    return out


WORDS_SQL = f"WITH w AS (SELECT doc_id, doc_id::VARCHAR AS id, list_concat(regexp_extract_all(coalesce(text, ''), '[a-z]{{3,9}}')[1:5], {list(SPARE)!r})[1:5] AS w FROM documents)"


def sql_of(rows: list[str]) -> str:
    """SELECTs over the words, one for each case."""
    return WORDS_SQL + " " + " UNION ALL ".join(f"SELECT {r} FROM w" for r in rows)


def each(rows: DataFrame, cases: list[Column], name: str = "x") -> DataFrame:
    """One row for each of the cases (columns), numbered by ``k``."""
    return rows.select("*", F.posexplode(F.array(*cases)).alias("k", name))


def case(name: str) -> Query:
    f, rows = CASES[name]
    kind = "boolean" if isinstance(rows[0][1], bool) else "string"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = each(worded(spark, sf_dir), [fill(x) for x, _ in rows])
        return given.select("doc_id", "k", f(F.col("x")).cast(kind).alias("result"))

    return run


def case_sql(name: str) -> str:
    expected = lambda y: str(y).upper() if isinstance(y, bool) else fill_sql(y)
    return sql_of([f"doc_id, {k} AS k, {expected(y)} AS result" for k, (_, y) in enumerate(CASES[name][1])])


def rubric_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [F.array(*[F.array(*[fill(c) for c in r]) for r in table]) for table, _ in CELLS]
    return each(worded(spark, sf_dir), cells, "cells").select("doc_id", "k", tables.markdown_table(F.col("cells")).alias("md"))


def bodies_of(operator: Callable[[DataFrame], DataFrame], bodies: list[str]) -> Query:
    return lambda spark, sf_dir: operator(each(worded(spark, sf_dir), [fill(b) for b in bodies], "body").select("doc_id", F.col("k").alias("pos"), "body"))


def parts_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = each(worded(spark, sf_dir), [F.struct(fill(p).alias("path"), fill(t).alias("text")) for p, t in PARTS[0]])
    return readback.combined_parts(files.select("x.path", "x.text"))


def heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("stage", "n", "age", "idle", "ready")
    rows = [F.struct(fill(b[0]).alias("stage"), *[F.lit(v).alias(c) for c, v in zip(names[1:], b[1:5], strict=True)]) for b in BEATS]
    return each(worded(spark, sf_dir), rows).select("doc_id", "k", readback.heartbeat(*[F.col(f"x.{c}") for c in names]).alias("result"))


def paths_of(spark: SparkSession, sf_dir: str, templates: list[str]) -> DataFrame:
    return each(worded(spark, sf_dir), [fill(t) for t in templates], "path").select("path")


def drop_id() -> Column:
    return F.col("doc_id") * 10 + F.col("k")


def resolved_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = lambda xs: F.array(*[fill(x) for x in xs]).cast("array<string>")
    rows = [F.struct(texts(p).alias("paths"), texts(n).alias("names"), texts(t).alias("texts")) for p, n, t, *_ in DROPS]
    drops = each(worded(spark, sf_dir), rows).select(drop_id().alias("drop_id"), "x.*")
    return readback.resolved_drop(drops, paths_of(spark, sf_dir, THERE))


def valid_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = each(worded(spark, sf_dir), [fill(p) for p, _ in INPUTS], "path").select(drop_id().alias("id"), "path")
    return readback.validated(given, paths_of(spark, sf_dir, THERE)).select("id", "ok", "message")


def resolved_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = each(worded(spark, sf_dir), [fill(p) for p, _ in WANTED], "path").select(drop_id().alias("id"), "path")
    return readback.resolved_sections(given, paths_of(spark, sf_dir, SECTIONS)).select("id", "message")


def queries() -> dict[str, Query]:
    own = {f.__name__: f for f in (rubric_tables, parts_combined, heartbeat, resolved_drop, valid_paths, resolved_sections)}
    own |= {"footnote_rebalance": bodies_of(grouping.rebalanced, MOVED[0]), "orphan_markers": bodies_of(grouping.orphan_markers, ORPHANS[0])}
    return own | {name: case(name) for name in CASES}


def oracle_sql() -> dict[str, str]:
    sql = {name: case_sql(name) for name in CASES}
    sql["rubric_tables"] = sql_of([f"doc_id, {k} AS k, {fill_sql(md)} AS md" for k, (_, md) in enumerate(CELLS)])
    for name, (_, after) in (("footnote_rebalance", MOVED), ("orphan_markers", ORPHANS)):
        sql[name] = sql_of([f"doc_id, {k} AS pos, {fill_sql(b)} AS body" for k, b in enumerate(after)])
    sql["parts_combined"] = sql_of([f"{fill_sql(p)} AS stem, {fill_sql(t)} AS text" for p, t in PARTS[1]])
    sql["heartbeat"] = sql_of([f"doc_id, {k} AS k, {quoted(b[5])} AS result" for k, b in enumerate(BEATS)])
    sql["resolved_drop"] = sql_of([f"doc_id * 10 + {k} AS drop_id, {fill_sql(p)} AS path, {quoted(m)} AS message" for k, (*_, p, m) in enumerate(DROPS)])
    sql["valid_paths"] = sql_of([f"doc_id * 10 + {k} AS id, {str(m is None).upper()} AS ok, {quoted(m)} AS message" for k, (_, m) in enumerate(INPUTS)])
    sql["resolved_sections"] = sql_of([f"doc_id * 10 + {k} AS id, {quoted(m)} AS message" for k, (_, m) in enumerate(WANTED)])
    return sql
