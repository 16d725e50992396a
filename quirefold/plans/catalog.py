"""Queries over the test tables, and the SQL that says what each should return.

Those of ``cases`` run single operators on worked cases filled from every document, those of
``geometry`` on pages of mixed sizes, scans and web pages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import dedup, grouping, layout, outline, readback, render, sections, tables
from quirefold.plans import cases, geometry, guardrails
from quirefold.plans.convert import ConvertOptions, convert, markdown_files, outlines, segment_rows, told_files
from quirefold.plans.sinks import write_files
from quirefold.sources import written
from quirefold.sources.adapters import binder, prose
from quirefold.store import own_dir, passing, stored

Query = Callable[[SparkSession, str], DataFrame]

def table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents = table("documents")


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binder(documents(spark, sf_dir))


def kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of volumes, made once for plans that read them more than once."""
    return stored(lines_of(spark, sf_dir), "volumes")


def binder_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.from_fonts(kept_lines(spark, sf_dir))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges_of(kept_lines(spark, sf_dir))


def ranges_of(lines: DataFrame) -> DataFrame:
    counts = lines.groupBy("doc_id").agg(F.max("page_no").alias("page_count"))
    return sections.section_ranges(outline.from_fonts(lines), counts)


def q_clean_lines(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "x"))
    return rows.select("doc_id", "line_no", T.clean_line(F.col("x")).alias("line"))


def q_match_keys(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.match_key(F.col("text")).alias("norm"))


def q_slugs(spark, sf_dir):
    return table("part")(spark, sf_dir).select("p_partkey", T.slugify(F.col("p_name")).alias("slug"))


def q_line_frame(spark, sf_dir):
    d = lines_of(spark, sf_dir)
    return d.select("doc_id", "page_no", "line_no", F.round("y0", 6).alias("y0"), "x1", "size", F.length("text").cast("long").alias("chars"))


def q_font_cutoff(spark, sf_dir):
    return outline.font_cutoff(lines_of(spark, sf_dir).withColumn("text", T.clean_line(F.col("text"))))


def q_heading_levels(spark, sf_dir):
    return binder_outline(spark, sf_dir).select("doc_id", "pos", "level", "title", "page_start")


def q_outline_normalized(spark, sf_dir):
    return outlines(kept_lines(spark, sf_dir)).select("doc_id", "pos", "level", "title", "page_start", "source")


def q_wrapped_headings(spark, sf_dir):
    return outline.wrapped_headings(outline.heading_candidates(kept_lines(spark, sf_dir)))


def q_document_title(spark, sf_dir):
    return outline.document_title(lines_of(spark, sf_dir))


def q_noise_profile(spark, sf_dir):
    return sections.noise_profile(lines_of(spark, sf_dir))


def q_denoised_lines(spark, sf_dir):
    lines = kept_lines(spark, sf_dir)
    return sections.denoised(lines, sections.noise_profile(lines)).groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n"))


def q_section_ranges(spark, sf_dir):
    return ranges(spark, sf_dir).select("doc_id", "pos", "start", F.col("end").alias("finish"))


def q_section_lines(spark, sf_dir):
    lines = kept_lines(spark, sf_dir)
    own = sections.section_lines(ranges_of(lines), lines)
    return own.groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("n"))


def boxes_outside_tables(li: DataFrame) -> DataFrame:
    """Lines and tables from lineitem: an order is a page, lines 1 to 3 are text, others tables."""
    box = li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(0).alias("block_no"), F.col("l_linenumber").alias("line_no"),
        (F.col("l_quantity") * 2).alias("x0"), (F.col("l_discount") * 200).alias("y0"), (F.col("l_quantity") * 2 + 60).alias("x1"), (F.col("l_discount") * 200 + 12).alias("y1"),
    )
    return layout.outside_tables(box.filter("line_no <= 3"), box.filter("line_no > 3")).select("doc_id", "line_no")


def q_table_overlap(spark, sf_dir):
    return boxes_outside_tables(table("lineitem")(spark, sf_dir))


def q_paragraphs(spark, sf_dir):
    return layout.paragraphs(prose(documents(spark, sf_dir)))


def q_exact_dedupe(spark, sf_dir):
    p = documents(spark, sf_dir).select(F.col("source"), F.col("doc_id").alias("para"), "text")
    return dedup.exact(p, ["source"]).select("source", "para")


def q_near_dedupe(spark, sf_dir):
    p = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("para", "text"))
    return dedup.deduplicated(p, ["doc_id"]).select("doc_id", "para")


def q_md_table(spark, sf_dir):
    n = table("nation")(spark, sf_dir).join(table("region")(spark, sf_dir), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    body = F.transform("a", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    cells = F.concat(F.array(F.array(F.lit("Key"), F.lit("Name"))), body)
    return n.groupBy("r_name").agg(rows.alias("a")).select("r_name", tables.markdown_table(cells).alias("md"))


def q_toc_table(spark, sf_dir):
    return tables.outline_table(binder_outline(spark, sf_dir))


def q_numbering(spark, sf_dir):
    return grouping.numbered(binder_outline(spark, sf_dir)).select("doc_id", "pos", "level", "code")


def q_section_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", grouping.line_count(F.col("text")).alias("line_count"), F.length("text").cast("long").alias("char_count"))


def q_major_level(spark, sf_dir):
    return grouping.major_level(binder_outline(spark, sf_dir))


def q_major_groups(spark, sf_dir):
    return grouping.major_groups(binder_outline(spark, sf_dir)).select("doc_id", "pos", "grp")


def told(outline_: DataFrame) -> DataFrame:
    """An outline with files and counts made up from its rows."""
    name = F.when(F.col("level") == 1, F.concat(F.lit("Sections/"), F.col("pos").cast("string"), F.lit(".md")))
    return outline_.withColumn("section_file", name).withColumn("line_count", F.col("pos")).withColumn("char_count", F.length("title"))


def q_outline_md(spark, sf_dir):
    return render.outline_markdown(told(binder_outline(spark, sf_dir)))


def q_outline_text(spark, sf_dir):
    return render.outline_text(binder_outline(spark, sf_dir))


def q_viewer_groups(spark, sf_dir):
    return grouping.viewer_groups(told(binder_outline(spark, sf_dir))).select("doc_id", "pos", "shown_in", "depth")


def q_segments(spark, sf_dir):
    o = grouping.major_groups(told(binder_outline(spark, sf_dir))).withColumn("start", F.col("page_start")).withColumn("end", F.col("page_start") + 1)
    return grouping.segments(o).select("doc_id", "grp", "title", "level", "page_start", "page_end", F.col("char_count").alias("chars"))


def q_sections_segments(spark, sf_dir):
    return segment_rows(convert(lines_of(spark, sf_dir)), "sections")


def q_span_lines(spark, sf_dir):
    """Words of documents as spans of their lines."""
    rows = documents(spark, sf_dir).select(F.col("doc_id"), F.lit(1).alias("page_no"), F.lit(0).alias("block_no"), F.posexplode(F.split("text", "\n")).alias("line_no", "l"))
    s = rows.select("doc_id", "page_no", "block_no", "line_no", F.posexplode(F.split("l", " ")).alias("span_no", "text"))
    box = [F.lit(float(v)).alias(c) for c, v in (("x0", 72), ("y0", 40), ("x1", 300), ("y1", 50))]
    spans = s.select("*", *box, F.length("text").cast("double").alias("size"))
    return layout.lines_of_spans(spans).select("doc_id", "line_no", "size", "text")


def q_toc_outline(spark, sf_dir):
    """Nations as contents of regions; some levels, pages and titles can't be used as they are."""
    n = table("nation")(spark, sf_dir)
    toc = n.select(
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("doc_id"), F.col("n_nationkey").cast("int").alias("toc_no"), (F.col("n_nationkey") % 3).cast("int").alias("level"),
        F.when(F.col("n_nationkey") % 7 != 0, F.concat(F.lit(" "), "n_name", F.lit("\t"))).otherwise("").alias("title"), (F.col("n_nationkey") - 2).cast("int").alias("page"),
    )
    return outline.from_toc(toc).drop("y0")


def q_toc_anchors(spark, sf_dir):
    """Contents made of the first words of some lines, anchored to the lines that say them."""
    lines = kept_lines(spark, sf_dir)
    picked = lines.filter((F.col("line_no") % 3 == 0) & (F.length("text") > 0))
    title = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    pos = (F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", F.desc("line_no"))) - 1).cast("int")
    o = picked.select("doc_id", pos.alias("pos"), F.lit(1).alias("level"), title.alias("title"), F.col("page_no").alias("page_start"), F.lit(None).cast("double").alias("y0"), F.lit("pdf-outline").alias("source"))
    return outline.anchored(o, lines).select("doc_id", "pos", F.round("y0", 6).alias("y0"))


def q_html_escape(spark, sf_dir):
    return table("pages")(spark, sf_dir).select("page_id", T.html_escape(F.col("html")).alias("html"))


def q_sections(spark, sf_dir):
    return convert(lines_of(spark, sf_dir))


def q_files(mode: str) -> Query:
    return lambda spark, sf_dir: markdown_files(convert(lines_of(spark, sf_dir), options=ConvertOptions(mode=mode)), ConvertOptions(mode=mode))


def written_out(spark: SparkSession, sf_dir: str) -> str:
    """Converts volumes and writes their files, without those of every seventh entry; tells where."""
    root = f"{own_dir(spark)}/files-{uuid.uuid4().hex}"
    with passing(spark):
        with passing(spark) as lasting:  # lines and outlines go before files are written
            converted = lasting(convert(lines_of(spark, sf_dir)), "converted", "zstd")
        # No two entries share a file (their codes differ), so an entry's file is left out by its row, without a join of texts.
        write_files(markdown_files(converted.filter("pos % 7 <> 3")).unionByName(told_files(converted, "sections")), root)
    return root


def q_outline_payload(spark, sf_dir):
    """Outlines written to disk and read back; entries whose file isn't there have none."""
    found = written.outlines(spark, written_out(spark, sf_dir))
    return found.select("doc_id", "pos", "id", "level", "title", "page_start", "source", "section_file")


def q_segment_payload(spark, sf_dir):
    """Segments written to disk and read back."""
    return written.segments(spark, written_out(spark, sf_dir)).drop("char_count")


def q_integrity(spark, sf_dir):
    """Rules over what was written; files that weren't are faults of their segments."""
    root = written_out(spark, sf_dir)
    told = stored(written.outlines(spark, root), "entries"), stored(written.segments(spark, root), "segments")
    return guardrails.report(*told, written.section_texts(spark, root, plain=True))


def q_section_files(spark, sf_dir):
    """What section files on disk begin with, and whether a viewer finds their metadata."""
    texts = written.section_texts(spark, written_out(spark, sf_dir))
    head = F.regexp_extract("text", readback.PREAMBLE, 0)
    return texts.select("doc_id", "path", head.alias("head"), readback.has_metadata(F.col("text")).alias("has_metadata"), (readback.without_preamble(F.col("text")) != "").alias("has_body"))


def q_major_files(spark, sf_dir):
    """Files of the major headings, with the number of sections that each holds."""
    o = ConvertOptions(mode="major")
    made = markdown_files(convert(lines_of(spark, sf_dir), options=o), o)
    return made.select("doc_id", "file", F.regexp_count("text", F.lit(r"\n\n- Level: [1-6]\n- Pages: [0-9]+-[0-9]+\n- Source: ")).alias("sections"))


def q_single_files(spark, sf_dir):
    """One file for a document, under the title found on its first page."""
    o = ConvertOptions(mode="single")
    made = markdown_files(convert(lines_of(spark, sf_dir), options=o), o)
    return made.select("doc_id", "file", F.regexp_extract("text", r"\A[^\n]*\n\n- Level: 1\n- Pages: [^\n]*\n- Source: [^\n]*", 0).alias("head"))


def q_snapshot(spark, sf_dir):
    """The state of every document's folder on disk."""
    found = readback.snapshot(written.listed(spark, written_out(spark, sf_dir)))
    return found.select("doc_id", "n", "outline_ready", (F.col("age") >= 0).alias("is_aged"), F.col("newest").startswith("Sections/").alias("in_sections"))


def queries() -> dict[str, Query]:
    own = {k[2:]: f for k, f in globals().items() if k.startswith("q_") and k != "q_files"}
    own |= geometry.queries() | cases.queries()
    own |= {f"files_{m}": q_files(m) for m in ("single", "major", "sections")}
    return own


BINDER = geometry.lines_sql(geometry.volume_pages("612.0::DOUBLE", "792.0::DOUBLE"))
CLEAN = "trim(regexp_replace(regexp_replace({}, '[\\x01-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g'))"
KEY = "trim(regexp_replace(regexp_replace(lower(" + CLEAN + "), '<[^>]+>', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
MARGIN = KEY.format("regexp_replace(regexp_replace(regexp_replace(" + CLEAN + r", '^\d{{1,3}}\s+', ''), '\s+\d{{1,3}}$', ''), '(?i)^page\s+\d{{1,4}}\s*', '')")
HEADINGS = (
    BINDER
    + ", own AS (SELECT * REPLACE (" + CLEAN.format("text") + " AS text) FROM lines), full_ AS (SELECT * FROM own WHERE text <> ''),"
    + r"""
sizes AS (SELECT doc_id, list_sort(list(size)) AS s FROM full_ GROUP BY doc_id),
cutoff AS (SELECT doc_id, greatest(s[(floor((len(s) - 1) * 0.75))::INT + 1], s[(floor((len(s) - 1) * 0.5))::INT + 1] + 1.0) AS cutoff FROM sizes),
cand AS (SELECT full_.* FROM full_ JOIN cutoff USING (doc_id) WHERE size >= cutoff AND length(text) BETWEEN 4 AND 120
  AND NOT regexp_matches(text, '^[•*-]') AND NOT (text LIKE '%.' AND len(string_split(text, ' ')) > 8)),
firsts AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY page_no, line_no) = 1),
steps AS MATERIALIZED (SELECT doc_id, page_no, line_no, y0, size, text, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, y0, line_no) AS k FROM firsts),
fold AS (
  SELECT doc_id, k, k AS g, page_no, line_no, y0, size, text FROM steps WHERE k = 1
  UNION ALL
  SELECT doc_id, k, CASE WHEN goes THEN g ELSE k END, page_no, CASE WHEN goes THEN l0 ELSE line_no END, CASE WHEN goes THEN y00 ELSE y0 END,
    CASE WHEN goes THEN s0 ELSE size END, CASE WHEN goes THEN t0 || ' ' || text ELSE text END
  FROM (SELECT n.*, f.g, f.line_no AS l0, f.y0 AS y00, f.size AS s0, f.text AS t0,
    f.page_no = n.page_no AND abs(f.size - n.size) <= 0.2 AND abs(n.y0 - f.y0) <= 90 AND NOT regexp_matches(f.text, '[\\.:;!?]$')
    AND ((len(string_split(f.text, ' ')) <= 6 AND len(string_split(n.text, ' ')) <= 6 AND (regexp_matches(n.text, '^\p{Ll}')
        OR lower(string_split(f.text, ' ')[-1]) IN ('for', 'and', 'or', 'to', 'in', 'on', 'of', 'with', 'program', 'course', 'grade') OR f.text LIKE '%-'
        OR lower(string_split(n.text, ' ')[1]) IN ('and', 'or', 'for', 'to', 'in', 'of', 'the')))
      OR (len(string_split(f.text, ' ')) >= 6 AND len(string_split(n.text, ' ')) <= 8
        AND (contains(n.text, ',') OR length(f.text) >= 35 OR lower(string_split(n.text, ' ')[1]) IN ('and', 'or', 'for', 'to', 'in', 'of', 'the')))) AS goes
    FROM fold f JOIN steps n ON n.doc_id = f.doc_id AND n.k = f.k + 1)),
joined AS (SELECT * FROM fold QUALIFY k = max(k) OVER (PARTITION BY doc_id, g)),
levels AS (SELECT *, least(3, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC))::INT AS level FROM joined),
heads AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY page_no, y0, level, lower(text), line_no) - 1)::INT AS pos FROM levels)"""
)
RANGES = (
    HEADINGS
    + """, counts AS (SELECT doc_id, max(page_no) AS pc FROM lines GROUP BY doc_id),
nexts AS (SELECT heads.*, pc, lead(page_no) OVER w AS np, lead(y0) OVER w AS ny FROM heads JOIN counts USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
rng AS (SELECT *, page_no AS start, greatest(page_no - 1, least(CASE WHEN np IS NULL THEN pc ELSE np END, pc))::INT AS finish FROM nexts)"""
)
NOISE = (
    BINDER
    + ", banded AS (SELECT *, CASE WHEN y0 <= height * 0.1::DOUBLE THEN 'top' WHEN y0 + 10 >= height * 0.9::DOUBLE THEN 'bottom' END AS band FROM lines), normed AS (SELECT *, "
    + MARGIN.format("text")
    + """ AS norm FROM banded WHERE band IS NOT NULL),
total AS (SELECT doc_id, count(DISTINCT page_no) AS n FROM lines GROUP BY doc_id),
noise AS (SELECT doc_id, band, norm FROM normed JOIN total USING (doc_id) WHERE length(norm) >= 4
  GROUP BY doc_id, band, norm, total.n HAVING count(DISTINCT page_no) >= greatest(2, ceil(total.n * 0.15)))"""
)

NORMALIZED = f"""WITH RECURSIVE {HEADINGS}, o AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, level, text, page_no, y0, {KEY.format('text')} AS norm FROM heads), nf AS (SELECT doc_id, k, true AS kept, level, text, page_no, y0, [{{'n': norm, 'p': page_no}}] AS recent, level AS last FROM o WHERE k = 1 UNION ALL SELECT doc_id, k, NOT again, lev, text, pg, y0, CASE WHEN again THEN recent ELSE list_append(recent[-7:], {{'n': norm, 'p': pg}}) END, CASE WHEN again THEN last ELSE lev END FROM (SELECT o.doc_id, o.k, o.text, o.y0, o.norm, f.recent, f.last, least(o.level, f.last + 1) AS lev, greatest(o.page_no, f.recent[-1].p) AS pg, len(list_filter(f.recent, lambda x: x.n = o.norm AND greatest(o.page_no, f.recent[-1].p) - x.p <= 2)) > 0 AS again FROM nf f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1)), kept AS (SELECT * FROM nf WHERE kept), alld AS (SELECT doc_id, k, level, text AS title, page_no AS page_start, 'text-heuristic' AS source, y0 FROM kept UNION ALL SELECT doc_id, 0, 1, 'Front Matter', 1, 'synthetic-front-matter', 0 FROM kept GROUP BY doc_id HAVING arg_min(page_no, k) > 1 OR arg_min(y0, k) > 2 UNION ALL SELECT DISTINCT doc_id, 1, 1, 'Document', 1, 'fallback', NULL FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM kept)),
found AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS pos, level, title, page_start, source, y0 FROM alld)"""
#: Texts of one page and a blank one; a fifth of the documents have no text. The title's own lines are in its section's window.
SCANNED = f"""{NORMALIZED},
cut2 AS (SELECT *, lead(page_start) OVER w AS np, lead(y0) OVER w AS ny FROM found WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
part AS (SELECT *, page_start AS start, CASE WHEN np IS NULL THEN 2 ELSE np END AS finish, CASE WHEN np IS NULL THEN NULL ELSE ny END AS y_max FROM cut2),
shown AS (SELECT p.doc_id, p.pos FROM part p JOIN lines l USING (doc_id)
  WHERE {CLEAN.format('l.text')} <> '' AND l.y0 + 10 > coalesce(p.y0 + 0.5, 0) AND l.y0 < coalesce(p.y_max, l.height) AND coalesce(p.y_max, l.height) > coalesce(p.y0 + 0.5, 0)
    AND NOT (l.y0 + 10 >= l.height * 0.9::DOUBLE AND regexp_matches({CLEAN.format('l.text')}, '(?i)^(page\\s+)?\\d{{1,4}}(\\s*(/|of)\\s*\\d{{1,4}})?$'))
  GROUP BY ALL)
SELECT doc_id, pos, level, title, source, start, finish::INT AS finish, shown.doc_id IS NULL AS is_empty,
  CASE WHEN source = 'fallback' AND shown.doc_id IS NULL THEN '(No extractable text in this range.)' END AS fallback_body
FROM part LEFT JOIN shown USING (doc_id, pos)
UNION ALL
SELECT doc_id, 0, 1, 'Document', 'fallback', 1, 2, true, '(No extractable text in this range.)' FROM documents WHERE doc_id % 5 = 0
"""

#: Anchors of contents, one after the other on each page; every entry carries the lines that fit it.
ANCHORS = f"""WITH RECURSIVE {BINDER},
keyed AS MATERIALIZED (SELECT doc_id, page_no, line_no, y0, text, {KEY.format('text')} AS n FROM lines),
toc AS (SELECT doc_id, page_no, array_to_string(string_split(text, ' ')[1:3], ' ') AS title, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, line_no DESC) - 1 AS pos
  FROM keyed WHERE line_no % 3 = 0 AND length(text) > 0),
entries AS (SELECT *, {KEY.format('title')} AS t FROM toc),
fits AS (SELECT e.doc_id, e.pos, list({{'part': (l.n <> e.t)::INT, 'y': l.y0}}) AS c FROM entries e JOIN keyed l USING (doc_id, page_no)
  WHERE e.t <> '' AND l.n <> '' AND (l.n = e.t OR (contains(l.n, e.t) AND length(e.t) >= 6) OR (contains(e.t, l.n) AND length(l.n) >= 8)) GROUP BY ALL),
steps AS MATERIALIZED (SELECT e.doc_id, e.page_no, e.pos, c, row_number() OVER (PARTITION BY e.doc_id, e.page_no ORDER BY e.pos) AS k FROM entries e LEFT JOIN fits USING (doc_id, pos)),
fold AS (
  SELECT doc_id, page_no, 0::BIGINT AS k, NULL::BIGINT AS pos, NULL::DOUBLE AS y0, -1e9::DOUBLE AS last FROM steps GROUP BY ALL
  UNION ALL
  SELECT doc_id, page_no, k, pos, y, coalesce(y, last) FROM (
    SELECT n.doc_id, n.page_no, n.k, n.pos, f.last,
      list_sort(list_transform(n.c, lambda x: {{'part': x.part, 'early': (x.y < f.last - 0.5)::INT, 'far': abs(x.y - greatest(f.last, 0)), 'y': x.y}}))[1].y AS y
    FROM fold f JOIN steps n ON n.doc_id = f.doc_id AND n.page_no = f.page_no AND n.k = f.k + 1))
SELECT doc_id, pos::INT AS pos, round(y0, 6) AS y0 FROM fold WHERE k > 0"""
FILED = NORMALIZED + """,
g AS (SELECT *, sum((level < 2)::INT) OVER w AS g2, sum((level < 3)::INT) OVER w AS g3, sum((level = 1)::INT) OVER w AS c1 FROM found WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
coded AS (SELECT *, c1 || '.' || sum((level = 2)::INT) OVER (PARTITION BY doc_id, g2 ORDER BY pos) || '.' || sum((level = 3)::INT) OVER (PARTITION BY doc_id, g3 ORDER BY pos) AS code,
  trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug, max((source = 'synthetic-front-matter')::INT) OVER (PARTITION BY doc_id) AS extra FROM g)"""
PAYLOAD = f"""{FILED}
SELECT doc_id, pos, 'h' || (pos + 1 - extra) AS id, level, title, page_start, source,
  CASE WHEN pos % 7 <> 3 THEN 'Sections/' || code || '-' || left(CASE WHEN slug = '' THEN 'section' ELSE slug END, 64) || '.md' END AS section_file FROM coded"""
SNAPSHOT = f"{FILED} SELECT doc_id, count(*) FILTER (WHERE pos % 7 <> 3) AS n, true AS outline_ready, true AS is_aged, true AS in_sections FROM coded GROUP BY doc_id"

ENDED = FILED + """,
counts AS (SELECT doc_id, max(page_no) AS pc FROM lines GROUP BY doc_id),
named AS (SELECT *, code || '-' || left(CASE WHEN slug = '' THEN 'section' ELSE slug END, 64) || '.md' AS file,
  lead(page_start) OVER w AS np, lead(y0) OVER w AS ny FROM coded JOIN counts USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ended AS (SELECT *, greatest(page_start - 1, least(CASE WHEN np IS NULL THEN pc WHEN ny IS NOT NULL THEN np WHEN np = page_start THEN page_start - 1 ELSE np - 1 END, pc))::INT AS finish FROM named)"""
_HEAD = "repeat('#', level) || ' ' || title || chr(10) || chr(10) || '- Level: ' || level || chr(10) || '- Pages: ' || page_start || '-' || finish || chr(10) || '- Source: ' || source"
SEGMENT_PAYLOAD = f"{ENDED} SELECT doc_id, (pos + 1)::INT AS n, 's' || (pos + 1) AS id, title, level, page_start, finish AS page_end, 'Sections/' || file AS file FROM ended"
SECTION_FILES = f"{ENDED} SELECT doc_id, 'Sections/' || file AS path, {_HEAD} || chr(10) || chr(10) AS head, true AS has_metadata, true AS has_body FROM ended WHERE pos % 7 <> 3"
MAJOR_FILES = f"""{ENDED},
sizes_ AS (SELECT doc_id, level, count(*) AS many FROM ended GROUP BY doc_id, level), majors AS (SELECT doc_id, coalesce(min(level) FILTER (WHERE many >= 2), min(level)) AS major FROM sizes_ GROUP BY doc_id),
owned AS (SELECT *, CASE WHEN level = major THEN pos END AS own FROM ended JOIN majors USING (doc_id)),
groups_ AS (SELECT *, coalesce(max(own) OVER (PARTITION BY doc_id ORDER BY pos), min(own) OVER (PARTITION BY doc_id)) AS grp FROM owned)
SELECT doc_id, 'By Major Heading/' || max(file) FILTER (WHERE pos = grp) AS file, count(*)::INT AS sections FROM groups_ GROUP BY doc_id, grp"""
TITLES = f"""{BINDER}, top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, line_no) AS k FROM (SELECT * REPLACE ({CLEAN.format('text')} AS text) FROM lines WHERE page_no = 1 AND y0 <= 0.28::DOUBLE * height) WHERE length(text) >= 12), fits AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n FROM top WHERE k <= 3), named AS (SELECT doc_id, string_agg(text, ' ' ORDER BY k) AS title FROM fits WHERE n <= 140 OR k = 1 GROUP BY doc_id),
titles AS (SELECT doc_id, coalesce(title, replace(doc_id, '-', ' ')) AS title FROM (SELECT DISTINCT doc_id FROM lines) LEFT JOIN named USING (doc_id))"""
SINGLE_FILES = f"""WITH RECURSIVE {TITLES}, {HEADINGS.removeprefix(BINDER + ',')},
pages_ AS (SELECT doc_id, max(page_no) AS pc FROM lines GROUP BY doc_id)
SELECT doc_id, doc_id || '.md' AS file, CASE WHEN doc_id IN (SELECT doc_id FROM heads) THEN '# ' || title ELSE '# Document' END || chr(10) || chr(10) || '- Level: 1' || chr(10) || '- Pages: 1-' || pc || chr(10)
  || '- Source: ' || CASE WHEN doc_id IN (SELECT doc_id FROM heads) THEN 'single-fallback' ELSE 'fallback' END AS head
FROM titles JOIN pages_ USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    sql = cases.oracle_sql()
    clean, key = CLEAN.format, KEY.format
    sql |= {
        "clean_lines": f"SELECT doc_id, (i - 1)::INT AS line_no, {clean('l[i]')} AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
        "match_keys": f"SELECT doc_id, {key('text')} AS norm FROM documents",
        "slugs": "SELECT p_partkey, left(CASE WHEN s = '' THEN 'section' ELSE s END, 64) AS slug FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)",
        "line_frame": f"WITH {BINDER} SELECT doc_id, page_no, line_no, round(y0, 6) AS y0, x1, size, length(text)::BIGINT AS chars FROM lines",
        "font_cutoff": f"WITH RECURSIVE {HEADINGS} SELECT doc_id, cutoff FROM cutoff",
        "heading_levels": f"WITH RECURSIVE {HEADINGS} SELECT doc_id, pos, level, text AS title, page_no AS page_start FROM heads",
        "noise_profile": f"WITH {NOISE} SELECT * FROM noise",
        "denoised_lines": f"WITH {NOISE} SELECT doc_id, page_no, count(*) AS n FROM banded b WHERE NOT (coalesce(band, '') = 'bottom' AND regexp_matches({clean('text')}, '(?i)^(page\\s+)?\\d{{1,4}}(\\s*(/|of)\\s*\\d{{1,4}})?$')) AND NOT EXISTS (SELECT 1 FROM noise WHERE noise.doc_id = b.doc_id AND noise.band = b.band AND noise.norm = {MARGIN.format('b.text')}) GROUP BY doc_id, page_no",
        "section_ranges": f"WITH RECURSIVE {RANGES} SELECT doc_id, pos, start, finish FROM rng",
        "section_lines": f"WITH RECURSIVE {RANGES} SELECT r.doc_id, r.pos, count(*) AS n FROM rng r JOIN lines l ON l.doc_id = r.doc_id AND l.page_no BETWEEN r.start AND r.finish WHERE l.y0 + 10 > (CASE WHEN l.page_no = r.start THEN r.y0 + 0.5 ELSE 0 END) AND l.y0 < (CASE WHEN l.page_no = r.finish AND r.np = r.finish THEN r.ny ELSE l.height END) AND (CASE WHEN l.page_no = r.finish AND r.np = r.finish THEN r.ny ELSE l.height END) > (CASE WHEN l.page_no = r.start THEN r.y0 + 0.5 ELSE 0 END) GROUP BY r.doc_id, r.pos",
        "table_overlap": "WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_quantity * 2 AS x0, l_discount * 200 AS y0, l_quantity * 2 + 60 AS x1, l_discount * 200 + 12 AS y1 FROM lineitem) SELECT doc_id, line_no FROM b l WHERE line_no <= 3 AND NOT EXISTS (SELECT 1 FROM b t WHERE t.doc_id = l.doc_id AND t.line_no > 3 AND (greatest(least(l.x1, t.x1) - greatest(l.x0, t.x0), 0::DOUBLE) / greatest(l.x1 - l.x0, 1)) * (greatest(least(l.y1, t.y1) - greatest(l.y0, t.y0), 0::DOUBLE) / greatest(l.y1 - l.y0, 1)) >= 0.45)",
        "exact_dedupe": f"WITH c AS (SELECT source, doc_id AS para, {key('text')} AS norm, length(text) >= 80 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 12 AND NOT regexp_matches(text, '^(\\||#|- (Level|Pages|Source):)') AS cand FROM documents) SELECT source, para FROM c WHERE norm <> '' QUALIFY NOT cand OR row_number() OVER (PARTITION BY source, norm, cand ORDER BY para) = 1",
        "md_table": "SELECT r_name, '| Key | Name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        "toc_table": f"WITH RECURSIVE {HEADINGS}, f AS (SELECT doc_id, min(pos) AS pos, arg_min(text, pos) AS title, page_no FROM heads GROUP BY doc_id, {key('text')}, page_no) SELECT doc_id, '## Table of Contents' || chr(10) || chr(10) || '| Section | Page |' || chr(10) || '|---|---:|' || chr(10) || string_agg('| ' || replace(title, '|', '\\|') || ' | ' || page_no || ' |' || chr(10), '' ORDER BY pos) AS md FROM f GROUP BY doc_id",
        "numbering": f"WITH RECURSIVE {HEADINGS}, g AS (SELECT doc_id, pos, level, sum((level < 2)::INT) OVER w AS g2, sum((level < 3)::INT) OVER w AS g3, sum((level = 1)::INT) OVER w AS c1 FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), c AS (SELECT *, sum((level = 2)::INT) OVER (PARTITION BY doc_id, g2 ORDER BY pos) AS c2, sum((level = 3)::INT) OVER (PARTITION BY doc_id, g3 ORDER BY pos) AS c3 FROM g) SELECT doc_id, pos, level, c1 || '.' || c2 || '.' || c3 AS code FROM c",
        "section_counts": "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS line_count, length(text)::BIGINT AS char_count FROM documents",
        "major_level": f"WITH RECURSIVE {HEADINGS}, n AS (SELECT doc_id, level, count(*) AS n FROM heads GROUP BY doc_id, level) SELECT doc_id, coalesce(min(level) FILTER (WHERE n >= 2), min(level)) AS major FROM n GROUP BY doc_id",
        "major_groups": f"WITH RECURSIVE {HEADINGS}, n AS (SELECT doc_id, level, count(*) AS n FROM heads GROUP BY doc_id, level), m AS (SELECT doc_id, coalesce(min(level) FILTER (WHERE n >= 2), min(level)) AS major FROM n GROUP BY doc_id), o AS (SELECT heads.doc_id, pos, CASE WHEN level = major THEN pos END AS own FROM heads JOIN m USING (doc_id)) SELECT doc_id, pos, coalesce(max(own) OVER (PARTITION BY doc_id ORDER BY pos), min(own) OVER (PARTITION BY doc_id)) AS grp FROM o",
        "outline_md": f"WITH RECURSIVE {HEADINGS} SELECT doc_id, '# Outline' || chr(10) || chr(10) || string_agg(repeat('  ', level - 1) || '- L' || level || ' p' || page_no || ' ' || (CASE WHEN level = 1 THEN '[' || text || '](Sections/' || pos || '.md)' ELSE text END) || ' (lines: ' || pos || ', chars: ' || length(text) || ')' || chr(10), '' ORDER BY pos) AS md FROM heads GROUP BY doc_id",
        "outline_text": f"WITH RECURSIVE {HEADINGS} SELECT doc_id, string_agg('L' || level || ' p' || page_no || ' ' || text, '\\n' ORDER BY pos) AS text FROM heads GROUP BY doc_id",
        "viewer_groups": f"WITH RECURSIVE {HEADINGS}, v AS (SELECT doc_id, pos, level, last_value(CASE WHEN level = 1 THEN 'Sections/' || pos || '.md' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS shown_in FROM heads) SELECT doc_id, pos, shown_in, least(4, greatest(1, level))::INT AS depth FROM v WHERE shown_in IS NOT NULL",
        "segments": f"WITH RECURSIVE {HEADINGS}, n AS (SELECT doc_id, level, count(*) AS n FROM heads GROUP BY doc_id, level), m AS (SELECT doc_id, coalesce(min(level) FILTER (WHERE n >= 2), min(level)) AS major FROM n GROUP BY doc_id), o AS (SELECT heads.*, CASE WHEN level = major THEN pos END AS own FROM heads JOIN m USING (doc_id)), g AS (SELECT *, coalesce(max(own) OVER (PARTITION BY doc_id ORDER BY pos), min(own) OVER (PARTITION BY doc_id)) AS grp FROM o) SELECT doc_id, grp, max(text) FILTER (WHERE pos = grp) AS title, max(level) FILTER (WHERE pos = grp) AS level, arg_min(page_no, pos) AS page_start, arg_max(page_no, pos) + 1 AS page_end, sum(length(text))::BIGINT AS chars FROM g GROUP BY doc_id, grp",
        "wrapped_headings": f"WITH RECURSIVE {HEADINGS} SELECT doc_id, page_no, y0, size, text, line_no FROM joined",
        "document_title": f"WITH {TITLES} SELECT doc_id, title FROM titles",
        "span_lines": f"WITH w AS (SELECT doc_id, i - 1 AS line_no, string_split(l[i], ' ') AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))), p AS (SELECT doc_id, line_no, length(s[j])::DOUBLE AS size, {clean('s[j]')} AS t, j FROM (SELECT doc_id, line_no, s, unnest(range(1, len(s) + 1)) AS j FROM w)) SELECT doc_id, line_no::INT AS line_no, max(size) AS size, string_agg(t, ' ' ORDER BY j) AS text FROM p WHERE t <> '' GROUP BY doc_id, line_no",
        "toc_outline": "SELECT 'r' || n_regionkey AS doc_id, n_nationkey::INT AS pos, greatest(1, n_nationkey % 3)::INT AS level, n_name AS title, greatest(1, n_nationkey - 2)::INT AS page_start, 'pdf-outline' AS source FROM nation WHERE n_nationkey % 7 <> 0",
        "outline_normalized": f"{NORMALIZED} SELECT doc_id, pos, level, title, page_start, source FROM found",
        "paragraphs": f"WITH RECURSIVE cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), flat AS (SELECT doc_id, len(l) AS n, unnest(range(0, len(l))) AS i, l FROM cut), ln AS (SELECT doc_id, i, CASE WHEN n > 1 THEN 40.0::DOUBLE + 700.0::DOUBLE * i / (n - 1) ELSE 40.0::DOUBLE END AS y0, {clean('l[i + 1]')} AS text FROM flat), own AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, y0, text, regexp_matches(text, '^([•*-]|\\d+\\.)\\s') AS b FROM ln WHERE text <> ''), fold AS (SELECT doc_id, k, y0, b AS inside, 0 AS para, text FROM own WHERE k = 1 UNION ALL SELECT doc_id, k, y0, CASE WHEN fresh THEN b ELSE inside END, para + fresh::INT, CASE WHEN fresh THEN text WHEN regexp_matches(t0, '\\p{{L}}-$') AND regexp_matches(text, '^\\p{{L}}') THEN left(t0, length(t0) - 1) || text ELSE t0 || ' ' || text END FROM (SELECT n.*, f.inside, f.para, f.text AS t0, n.b OR (n.y0 - (f.y0 + 10) > 4 AND NOT (f.inside AND n.y0 - (f.y0 + 10) <= 10)) AS fresh FROM fold f JOIN own n ON n.doc_id = f.doc_id AND n.k = f.k + 1)) SELECT doc_id, 1 AS page_no, para, text FROM fold QUALIFY k = max(k) OVER (PARTITION BY doc_id, para)",
        "html_escape": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM pages",
    }
    # The same over pages of mixed sizes, and over conversations as pages.
    other = geometry.lines_sql(geometry.MIXED_PAGES)
    for name in ("noise_profile", "denoised_lines", "document_title"):
        sql[f"mixed_{name}"] = sql[name].replace(BINDER, other)
    sql["mixed_section_lines"] = sql["section_lines"].replace(BINDER, other).replace("count(*) AS n FROM rng", "count(*) AS n, max(l.height) AS height FROM rng")
    sql["page_tables"] = geometry.PAGE_TABLES
    sql["mixed_pages"] = f"SELECT doc_id, page_no, width, height FROM ({geometry.MIXED_PAGES})"
    sql["reading_order"], sql["mixed_reading_order"] = geometry.order_sql(geometry.PLAIN_TALK), geometry.order_sql(geometry.MIXED_TALK)
    sql["toc_anchors"] = ANCHORS
    sql["integrity"] = f"{FILED} SELECT doc_id, count(*) AS n_entries, count(*) AS n_segments, 0::BIGINT AS q01, count(*) FILTER (WHERE pos % 7 = 3) AS q02, 0::BIGINT AS q03 FROM coded GROUP BY doc_id"
    sql |= {"segment_payload": SEGMENT_PAYLOAD, "section_files": SECTION_FILES, "major_files": MAJOR_FILES, "single_files": SINGLE_FILES}
    sql["outline_payload"], sql["snapshot"] = PAYLOAD, SNAPSHOT
    sql["scanned_sections"] = SCANNED.replace(BINDER, geometry.lines_sql(geometry.SCANNED_PAGES))
    return sql
