"""Queries over pages of mixed sizes, pages without text, and their SQL.

Volumes of documents get sheets by the id of each page's text (``adapters.mixed_binder``); the page
frame is joined by document and page. Conversations are pages of two columns, of widths by their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators import bodies, layout, outline, sections
from quirefold.plans.convert import convert
from quirefold.sources.adapters import SHEETS, mixed_binder, partly_scanned, sheet
from quirefold.sources.decoded import frames
from quirefold.sources.web import decoded_web


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.sized(*mixed_binder(documents(spark, sf_dir)))


def q_mixed_pages(spark, sf_dir):
    return mixed_binder(documents(spark, sf_dir))[1]


def q_mixed_noise_profile(spark, sf_dir):
    return sections.noise_profile(mixed(spark, sf_dir))


def q_mixed_denoised_lines(spark, sf_dir):
    lines = mixed(spark, sf_dir)
    return sections.denoised(lines, sections.noise_profile(lines)).groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n"))


def q_mixed_section_lines(spark, sf_dir):
    lines = mixed(spark, sf_dir)
    ranges = sections.section_ranges(outline.from_fonts(lines), lines.groupBy("doc_id").agg(F.max("page_no").alias("page_count")))
    return sections.section_lines(ranges, lines).groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("n"), F.max("height").alias("height"))


def q_mixed_document_title(spark, sf_dir):
    return outline.document_title(mixed(spark, sf_dir))


def talk_lines(spark: SparkSession, sf_dir: str, plain: bool) -> DataFrame:
    """Conversations as pages: the user on the left, the assistant on the right.

    ``plain`` pages have the default size. Others have sheets by conv_id, columns at parts of their
    width, every turn of the system over the full width, and lines 30 points apart.
    """
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "text"))
    c = c.withColumns({s: F.lit(layout.SIZE[s]) for s in layout.SIZE} if plain else sheet(F.col("conv_id")))
    if plain:
        x0 = F.when(F.col("role") == "user", 72.0).otherwise(324.0)
        x1, y0 = x0 + F.least(F.lit(216.0), 5.5 * F.length("text")), 40.0 + 12.0 * F.col("turn") + 3.0 * F.col("k")
    else:
        full = F.col("role") == "system"
        x0 = F.when((F.col("role") == "assistant"), F.col("width") / 2 + 18.0 * (F.col("turn") % 2)).otherwise(36.0)
        x1 = F.when(full, F.col("width") - 36.0).otherwise(x0 + F.least(F.col("width") / 2 - 54.0, 5.5 * F.length("text")))
        y0 = 40.0 + 30.0 * F.col("turn") + 3.0 * F.col("k")
    return c.select(
        F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_no"), F.col("turn").cast("int").alias("block_no"), F.col("k").alias("line_no"), x0.alias("x0"),
        y0.alias("y0"), x1.alias("x1"), (y0 + 10).alias("y1"), "text", *layout.SIZE,
    )


def q_reading_order(spark, sf_dir):
    return layout.reading_order(talk_lines(spark, sf_dir, True)).select("doc_id", "block_no", "line_no", "seq")


def q_mixed_reading_order(spark, sf_dir):
    return layout.reading_order(talk_lines(spark, sf_dir, False)).select("doc_id", "block_no", "line_no", "seq")


def q_scanned_sections(spark, sf_dir):
    """Sections of every document, a fifth of which are scans without a text layer."""
    lines, pages = partly_scanned(documents(spark, sf_dir))
    s = convert(lines, pages=pages)
    empty = F.when((F.col("source") == "fallback") & F.col("is_empty"), F.col("body"))
    return s.select("doc_id", "pos", "level", "title", "source", "start", F.col("end").alias("finish"), "is_empty", empty.alias("fallback_body"))


def web_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return frames(decoded_web(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def q_page_tables(spark, sf_dir):
    """Tables found on web pages, with their places."""
    return bodies.page_tables(web_frames(spark, sf_dir)[2]).drop("height")


def q_page_blocks(spark, sf_dir):
    """Web pages on sheets, back to paragraphs and tables in reading order."""
    lines, _, cells, _ = web_frames(spark, sf_dir)
    return bodies.page_blocks(lines, bodies.page_tables(cells))


def q_web_sections(spark, sf_dir):
    """Web pages through the whole plan: outline by font, bodies with their tables."""
    lines, _, cells, pages = web_frames(spark, sf_dir)
    return convert(lines, cells=cells, pages=pages)


def side_sql(number: str, side: int) -> str:
    """A sheet's width (0) or height (1) by a text's number."""
    return f"CASE (({number}) % 4 + 4) % 4 " + " ".join(f"WHEN {k} THEN {s[side]}" for k, s in enumerate(SHEETS)) + " END::DOUBLE"


def lines_sql(pages: str) -> str:
    """``lines`` of a query that gives (doc_id, page_no, text, width, height)."""
    return f"""
pages AS ({pages}),
cut AS (SELECT doc_id, page_no, width, height, string_split(coalesce(text, ''), chr(10)) AS l FROM pages),
flat AS (SELECT *, len(l) AS n, unnest(range(0, len(l))) AS line_no FROM cut),
lines AS (SELECT doc_id, page_no, line_no::INT AS line_no, l[line_no + 1] AS text, width, height,
  CASE WHEN n > 1 THEN 40.0::DOUBLE + (height - 92) * line_no / (n - 1) ELSE 40.0::DOUBLE END AS y0,
  72.0::DOUBLE + least(width - 144, 5.5::DOUBLE * length(l[line_no + 1])) AS x1,
  CASE WHEN line_no = 0 AND length(l[line_no + 1]) <= 60 THEN 18.0::DOUBLE WHEN length(l[line_no + 1]) <= 40 THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END AS size
  FROM flat)"""


def volume_pages(width: str, height: str) -> str:
    return f"""SELECT source || '-' || ((r - 1) // 10)::VARCHAR AS doc_id, ((r - 1) % 10 + 1)::INT AS page_no, text, {width} AS width, {height} AS height
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)"""


MIXED_PAGES = volume_pages(side_sql("doc_id", 0), side_sql("doc_id", 1))
SCANNED_PAGES = f"SELECT doc_id, 1 AS page_no, text, {side_sql('doc_id', 0)} AS width, {side_sql('doc_id', 1)} AS height FROM documents WHERE doc_id % 5 <> 0"


def order_sql(lines: str) -> str:
    """Reading order of ``t`` (doc_id, block_no, line_no, x0, x1, y0, width): clusters by a recursive sweep."""
    return f"""
WITH RECURSIVE t AS ({lines}),
narrow AS MATERIALIZED (SELECT doc_id, width, x0, row_number() OVER (PARTITION BY doc_id ORDER BY x0, block_no, line_no) AS k FROM t WHERE x1 - x0 <= 0.62::DOUBLE * width),
sweep AS (
  SELECT doc_id, width, k, [x0] AS c, [1::BIGINT] AS n FROM narrow WHERE k = 1
  UNION ALL
  SELECT doc_id, width, k, CASE WHEN joins THEN list_transform(c, lambda v, i: CASE WHEN i = near THEN (v * n[i] + x0) / (n[i] + 1) ELSE v END) ELSE list_append(c, x0) END,
    CASE WHEN joins THEN list_transform(n, lambda v, i: CASE WHEN i = near THEN v + 1 ELSE v END) ELSE list_append(n, 1::BIGINT) END
  FROM (SELECT *, abs(c[near] - x0) <= greatest(18, 0.08::DOUBLE * width) AS joins
    FROM (SELECT m.doc_id, m.width, m.k, m.x0, s.c, s.n, list_position(list_transform(s.c, lambda v: abs(v - m.x0)), list_min(list_transform(s.c, lambda v: abs(v - m.x0)))) AS near
      FROM sweep s JOIN narrow m ON m.doc_id = s.doc_id AND m.k = s.k + 1))),
ends AS (SELECT * FROM sweep QUALIFY k = max(k) OVER (PARTITION BY doc_id)),
each AS (SELECT doc_id, width, k AS narrows, i, c[i] AS c, n[i] AS n FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM ends)),
strong AS (SELECT * FROM each WHERE n >= greatest(3, floor(narrows * 0.12::DOUBLE)) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) <= 2),
two AS (SELECT doc_id, min(c) AS lo, max(c) AS hi FROM strong WHERE narrows >= 6 GROUP BY doc_id, width HAVING count(*) = 2 AND max(c) - min(c) >= 0.18::DOUBLE * width),
big AS (SELECT doc_id FROM t GROUP BY doc_id HAVING count(*) >= 10),
ext AS (SELECT doc_id, min(y0) AS a, max(y0) AS b FROM t WHERE x1 - x0 < 0.72::DOUBLE * width GROUP BY doc_id),
ranked AS (SELECT t.*, CASE WHEN lo IS NULL OR big.doc_id IS NULL THEN 0 WHEN x1 - x0 < 0.72::DOUBLE * width THEN 1 + 2 * (abs(x0 - lo) > abs(x0 - hi))::INT
    WHEN y0 < a - 4 THEN 0 WHEN y0 > b + 4 THEN 4 ELSE 2 END AS r
  FROM t LEFT JOIN two USING (doc_id) LEFT JOIN big ON big.doc_id = t.doc_id LEFT JOIN ext ON ext.doc_id = t.doc_id)
SELECT doc_id, block_no, line_no, (row_number() OVER (PARTITION BY doc_id ORDER BY r, y0, x0, block_no, line_no) - 1)::INT AS seq FROM ranked
"""


_TALK = "SELECT *, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations"
_TALKS = f"SELECT conv_id, turn, role, l[i + 1] AS text, i::INT AS k, {{0}} AS width FROM (SELECT *, unnest(range(0, len(l))) AS i FROM ({_TALK}))"
PLAIN_TALK = f"""
SELECT conv_id AS doc_id, turn::INT AS block_no, k AS line_no, x0, x0 + least(216, 5.5::DOUBLE * length(text)) AS x1, 40 + 12.0::DOUBLE * turn + 3 * k AS y0, width
FROM (SELECT *, CASE WHEN role = 'user' THEN 72.0::DOUBLE ELSE 324.0::DOUBLE END AS x0 FROM ({_TALKS.format('612.0::DOUBLE')}))"""
MIXED_TALK = f"""
SELECT conv_id AS doc_id, turn::INT AS block_no, k AS line_no, x0, CASE WHEN role = 'system' THEN width - 36 ELSE x0 + least(width / 2 - 54, 5.5::DOUBLE * length(text)) END AS x1,
  40 + 30.0::DOUBLE * turn + 3 * k AS y0, width
FROM (SELECT *, CASE WHEN role = 'assistant' THEN width / 2 + 18 * (turn % 2) ELSE 36.0::DOUBLE END AS x0 FROM ({_TALKS.format(side_sql('conv_id', 0))}))"""


#: The list of links heads each page, so its table starts at the top margin; named entities as letters.
_TEXT = "{}"
for _name, _letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_name}', '{_letter}')"
_CELL = f"replace(trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g')), '|', '\\|')"
PAGE_TABLES = f"""
WITH nav AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>.*?</nav>', 0), '<a href="([^"]*)">', 1) AS h,
  regexp_extract_all(regexp_extract(html, '<nav>.*?</nav>', 0), '<a href="[^"]*">([^<]*)</a>', 1) AS t, {side_sql('page_id', 0)} AS width FROM pages),
cells AS (SELECT page_id, width, len(t) AS n, i, t[i] AS t, h[i] AS h FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM nav)),
rows_ AS (SELECT page_id, width, n, i, '| ' || {_CELL.format('t')} || ' | ' || {_CELL.format('h')} || ' |' AS line FROM cells)
SELECT page_id::VARCHAR AS doc_id, 1 AS page_no, 72.0::DOUBLE AS x0, 100.0::DOUBLE AS y0, CASE WHEN page_id % 2 = 1 THEN 72 + (width - 180) / 2 ELSE width - 72 END AS x1,
  100 + 14.0::DOUBLE * n AS y1, string_agg(line || CASE WHEN i = 1 THEN chr(10) || '|---|---|' ELSE '' END, chr(10) ORDER BY i) AS md, width
FROM rows_ GROUP BY page_id, width, n HAVING n > 1
"""


def queries() -> dict:
    return {k[2:]: f for k, f in globals().items() if k.startswith("q_")}
