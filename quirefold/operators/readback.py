"""Reading results back: files in parts, dropped paths, messages, and the state of a conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import U, strip

# The lines that a section file begins with, and what messages say.
METADATA = r"- Level:[^\r\n]*\r?\n- Pages:[^\r\n]*\r?\n- Source:[^\r\n]*\r?\n\r?\n"
PREAMBLE = r"\A#{1,6}\s[^\r\n]*\r?\n\r?\n" + METADATA
BLOCK = r"\r?\n\r?\n" + METADATA
CORRUPT = ("fzerrorformat", "code=7: no objects found", "no objects found")
LOCKED = ("permissionerror", "winerror 32", "being used by another process", "output file is locked by another process")
MISSING, NOT_PDF, NOT_FOUND = "Input PDF path is missing.", "Please select a .pdf file.", "The selected PDF file could not be found on disk."
NO_DROP = "Please drop a .pdf file."
FALLBACK = "An unexpected error occurred."
LOCKED_TEXT = (
    "Conversion failed: Output files are locked by another program. "
    "Close any open section files, folder previews, or editors for the output folder and try again."
)
CORRUPT_TEXT = (
    "Conversion failed: The selected file \"", "\" could not be parsed as a valid PDF. It may be corrupt, incomplete, or not a real PDF file. "
    "Try opening it in a PDF viewer and exporting/saving a new PDF, then run conversion again.",
)
ENDING = ("waiting for subprocess exit", "Extraction pipeline complete", "Core extraction complete")
FOLDERS = ("", "Sections/", "By Major Heading/", "Per Major Headings/", "sections/", "per-major-headings/")
IDLE = 12  # seconds
PDF_NAME = r"""[^<>:"|?*\r\n]+\.pdf"""
DRIVES = (r"[A-Za-z]:\\", "[A-Za-z]:/", "/[A-Za-z]:/")  # what paths of drives begin with


def without_preamble(c: Column) -> Column:
    """A section file without its heading and metadata lines; other texts stay as they are."""
    return F.regexp_replace(c, PREAMBLE, "")


def has_metadata(c: Column) -> Column:
    return c.rlike(BLOCK)


def without_metadata(c: Column) -> Column:
    """The text with its first block of metadata lines replaced by a blank line."""
    return F.regexp_replace(c, r"(?s)\A(.*?)" + BLOCK, "$1\n\n")


def combined_parts(files: DataFrame) -> DataFrame:
    """(stem, text) of (path, text): parts ``x-part-N.md`` in order of N, later preambles dropped.

    Names of parts agree in any case of letters. Other files, and a single part, are texts by themselves.
    """
    part = r"(?i)^(.*)-part-([0-9]+)\.md$"
    is_part = F.col("path").rlike(part)
    stem = F.when(is_part, F.regexp_extract("path", part, 1)).otherwise(F.regexp_replace("path", r"(?i)\.md$", ""))
    n = F.try_to_number(F.when(is_part, F.regexp_extract("path", part, 2)), F.lit("9" * 18)).cast("long")
    f = files.select(F.lower(stem).alias("_key"), is_part.alias("_part"), stem.alias("stem"), F.coalesce(n, F.lit(0)).alias("n"), "text")
    key = F.when(F.col("_part"), F.col("_key")).otherwise(F.col("stem"))
    parts = F.array_sort(F.collect_list(F.struct("n", "stem", "text")))
    rest = F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: without_preamble(x["text"]))
    whole = f.groupBy("_part", key.alias("_key")).agg(parts.alias("p"))
    return whole.select(F.get("p", F.lit(0))["stem"].alias("stem"), F.array_join(F.concat(F.array(F.get("p", F.lit(0))["text"]), rest), "\n\n").alias("text"))


def path_tokens(c: Column) -> Column:
    """Things in a dropped text that may be paths: by line the line, quoted names, URIs and drive paths."""
    def of_line(x: Column) -> Column:
        all_of = lambda p, group=0: F.regexp_extract_all(x, F.lit("(?i)" + p), F.lit(group))
        drives = [all_of(p + PDF_NAME) for p in DRIVES]
        return F.concat(F.array(x), all_of(r'"([^"]+\.pdf)"', 1), all_of(r"file:\S+"), *drives)

    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r?\n|\x00+"), strip), lambda x: x != "")
    return F.transform(F.flatten(F.transform(lines, of_line)), strip)


def dropped_path(c: Column) -> Column:
    """A candidate as a path: quotes and controls off, local ``file:`` URIs decoded; empty if it is none."""
    s = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"[\x00-\x1f]+", " ")
    s = strip(F.regexp_replace(s, r"""^["']+|["']+$""", ""))
    uri = r"(?i)^file:(?://([^/?#]*))?/?([^?#]*)"
    host, path = F.lower(F.regexp_extract(s, uri, 1)), F.concat(F.lit("/"), F.regexp_extract(s, uri, 2))
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit(""))
    local = F.when(host.isin("", "localhost"), decoded).otherwise("")
    return F.regexp_replace(F.when(s.rlike("(?i)^file:"), local).otherwise(s), r"^/([A-Za-z]:[\\/])", "$1")


def is_pdf(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(r"(?i)[^/\\]\.pdf$"), F.lit(False))


def validated(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds ``ok`` and ``message`` to rows with ``path``: it must be there, be a .pdf and be in the listing (path)."""
    have = listing.select(F.col("path").alias("_path"), F.lit(True).alias("_have")).distinct()
    p = paths.withColumn("_own", strip(F.coalesce("path", F.lit("")))).join(have.hint("merge"), F.col("_own") == F.col("_path"), "left")
    message = F.when(F.col("_own") == "", MISSING).when(~is_pdf(F.col("_own")), NOT_PDF).when(F.col("_have").isNull(), NOT_FOUND)
    return p.withColumn("message", message).withColumn("ok", F.col("message").isNull()).drop("_own", "_path", "_have")


def resolved_drop(drops: DataFrame, listing: DataFrame) -> DataFrame:
    """(drop_id, path, message) of drops (drop_id, paths, names, texts: arrays): the first valid path wins.

    Candidates are the paths of files, what their names hold, then what the texts hold, each once.
    """
    files = F.zip_with("paths", "names", lambda p, n: F.concat(F.array(p), path_tokens(n)))
    tokens = F.concat(F.flatten(files), F.flatten(F.transform("texts", path_tokens)))
    found = F.array_distinct(F.filter(F.transform(tokens, dropped_path), lambda x: x != ""))
    rows = drops.select("drop_id", F.posexplode_outer(found).alias("k", "path"))
    seen = validated(rows, listing)
    best = seen.groupBy("drop_id").agg(
        F.min(F.when(F.col("ok"), F.struct("k", "path"))).alias("b"), F.max(F.coalesce(F.lower("path").endswith(".pdf"), F.lit(False))).alias("pdf")
    )
    message = F.when(F.col("b").isNull(), F.when(F.col("pdf"), NOT_FOUND).otherwise(NO_DROP))
    return best.select("drop_id", F.col("b.path").alias("path"), message.alias("message"))


def error_class(c: Column) -> Column:
    """corrupt, locked or other, by what a failure's text says."""
    low = F.lower(F.coalesce(c, F.lit("")))
    has = lambda marks: F.greatest(F.lit(False), *[F.contains(low, F.lit(x)) for x in marks])
    return F.when(has(CORRUPT), "corrupt").when(has(LOCKED), "locked").otherwise("other")


def failure_message(code: Column, output: Column, path: Column) -> Column:
    """What a user is told of a failed conversion: exit code, its output, and the input's path."""
    details = strip(F.coalesce(output, F.lit("")))
    name = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)[/\\]*$", 1), F.lit("")), F.lit("selected file"))
    told = lambda head: F.when(details != "", F.concat(F.lit(head), details)).otherwise("")
    corrupt = F.concat(F.lit(CORRUPT_TEXT[0]), name, F.lit(CORRUPT_TEXT[1]), told("\n\nTechnical details:\n"))
    other = F.concat(F.lit("Conversion failed with exit code "), code.cast("string"), F.lit("."), told("\n\n"))
    kind = error_class(output)
    return F.when(kind == "corrupt", corrupt).when(kind == "locked", LOCKED_TEXT).otherwise(other)


def user_error(c: Column, most: int = 420) -> Column:
    """A failure's text without its prefixes and technical part, cut to ``most``."""
    s = strip(F.coalesce(c, F.lit("")))
    s = F.regexp_replace(F.regexp_replace(s, U + r"(?i)\AError invoking remote method '[^']+':\s*", ""), U + r"(?i)\AError:\s*", "")
    cut = strip(F.regexp_replace(s, U + r"(?is)(?<=.)\n\s*(?:Technical details:|Traceback \(most recent call last\):|PROGRESS:).*", ""))
    short = F.when(F.length(cut) > most, F.concat(F.regexp_replace(F.substring(cut, 1, most - 3), U + r"\s+\z", ""), F.lit("..."))).otherwise(cut)
    return F.when(short == "", FALLBACK).otherwise(short)


def local_time(c: Column) -> Column:
    """A timestamp to the minute in the session's time zone; ``unknown`` for null."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit("unknown"))


def ellipsized(c: Column, most: int = 40) -> Column:
    """First two parts, dots and the last part of a path longer than ``most``, with its own separator."""
    parts = F.filter(F.split(c, r"[\\/]+"), lambda x: x != "")
    sep = F.when(F.contains(c, F.lit("\\")), "\\").otherwise("/")
    short = F.concat(F.get(parts, F.lit(0)), sep, F.get(parts, F.lit(1)), sep, F.lit("..."), sep, F.get(parts, F.size(parts) - 1))
    return F.when((F.length(c) <= most) | (F.size(parts) <= 1), c).otherwise(short)


def heading_offset(text: Column, title: Column) -> Column:
    """Where a viewer jumps to for a subheading: the heading's line, else the title's first place, else -1.

    In characters from 0, letters in any case; null for a blank title or text.
    """
    want = strip(F.coalesce(title, F.lit("")))
    quoted = F.concat(F.lit(r"\Q"), F.replace(want, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    line = F.regexp_instr(text, F.concat(F.lit(r"(?Uim)^#{1,6}\s+"), quoted, F.lit(r"\s*$"))) - 1
    at = F.when(line >= 0, line).otherwise(F.instr(F.lower(text), F.lower(want)) - 1)
    return F.when((want != "") & (text != ""), at)


def outline_with_files(outline: DataFrame, files: DataFrame) -> DataFrame:
    """Nulls section_file where the document's listing (doc_id, path) lacks it or it leaves the folder.

    However small a listing looks beforehand, no driver or task gets it whole.
    """
    by = ["doc_id"] if "doc_id" in files.columns else []
    have = files.select(*by, F.col("path").alias("section_file"), F.lit(True).alias("_ok")).distinct()
    o = outline.join(have.hint("merge"), [*by, "section_file"], "left")
    return o.withColumn("section_file", F.when(F.col("_ok") & inside(F.col("section_file")), F.col("section_file"))).select(*outline.columns)


def inside(c: Column) -> Column:
    """Whether a relative path stays inside its folder."""
    depth = F.aggregate(
        F.split(c, r"[\\/]+"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda acc, x: F.struct(
            (acc["at"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)).alias("at"),
            F.least(acc["low"], acc["at"] + F.when(x == "..", -1).otherwise(0)).alias("low"),
        ),
        lambda acc: acc["low"],
    )
    return ~c.rlike(r"^([\\/]|[A-Za-z]:)") & (depth >= 0)


def resolved_sections(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``message`` to rows with ``path``, null where the file is inside the folder and in the listing (path)."""
    have = files.select("path", F.lit(True).alias("_ok")).distinct()
    message = F.when(~inside(F.col("path")), "Invalid section path.").when(F.col("_ok").isNull(), "Section file not found.")
    return wanted.join(have.hint("merge"), "path", "left").withColumn("message", message).drop("_ok")


def snapshot(files: DataFrame, now: Column | None = None) -> DataFrame:
    """(doc_id, n, newest, age, outline_ready) of a listing (doc_id, path, modified), paths from the output folder.

    Markdown files of the output folders count, but outline.md doesn't. ``age`` is in whole seconds up
    to ``now``, -1 if there is no such file; of files of the same time the last by name is the newest.
    """
    folder, name = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    md = folder.isin(*FOLDERS) & F.lower(name).endswith(".md") & ~((folder == "") & (F.lower(name) == "outline.md"))
    own = files.withColumn("_md", md)
    when = F.max(F.when(F.col("_md"), F.struct("modified", "path"))).alias("_new")
    told = own.groupBy("doc_id").agg(F.count(F.when(F.col("_md"), 1)).alias("n"), when, F.max(F.col("path") == "outline.json").alias("outline_ready"))
    seconds = F.unix_seconds(F.current_timestamp() if now is None else now) - F.unix_seconds(F.col("_new.modified"))
    age = F.when(F.col("_new").isNull(), -1).otherwise(F.greatest(F.lit(0), seconds)).cast("bigint")
    return told.select("doc_id", "n", F.coalesce("_new.path", F.lit("none")).alias("newest"), age.alias("age"), "outline_ready")


def heartbeat(stage: Column, sections: Column, file_age: Column, idle: Column, outline_ready: Column) -> Column:
    """``exit`` when only the converter's end is awaited, else ``working``; ages in seconds."""
    said = F.greatest(F.lit(False), *[F.contains(F.coalesce(stage, F.lit("")), F.lit(x)) for x in ENDING])
    still = outline_ready & (sections > 0) & (file_age >= IDLE) & (idle >= IDLE)
    return F.when(said | F.coalesce(still, F.lit(False)), "exit").otherwise("working")

