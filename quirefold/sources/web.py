"""Web pages as decoded documents: HTML to placed lines and table cells, in Arrow batches.

Each page is a document. Its blocks flow over sheets from top to bottom, in one column or two. A list
of links inside ``nav`` is a table of texts and targets; tables are tables. As in a decoded PDF, the
text of a table's rows is there as lines too.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quirefold.functions.plain import clean
from quirefold.operators.layout import SIZE
from quirefold.sources.adapters import sheet
from quirefold.sources.decoded import DECODED

BLOCKS = frozenset("address article aside blockquote body div dd dl dt figure footer form header hr html li main nav ol p pre section ul".split())
HEADINGS = {f"h{k}": size for k, size in zip(range(1, 7), (18.0, 16.0, 14.0, 12.0, 11.0, 11.0), strict=True)}
UNSEEN = frozenset(("script", "style", "title", "template"))
SIDE, EDGE, GUTTER = 72.0, 100.0, 36.0  # margins at the sides, at the top and bottom, and between columns
ADVANCE, LEADING, APART, ROW = 0.55, 1.2, 8.0, 14.0  # a letter and a line in sizes, space after a block, a table's row
PLAIN = 10.0


class Tokens(HTMLParser):
    """(size, text) blocks and (None, rows) tables, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.text: list[str] = []
        self.size, self.unseen, self.href = PLAIN, 0, ""
        self.rows: list[list[str]] | None = None
        self.by_links = False

    def flush(self) -> None:
        text = clean("".join(self.text))
        self.text = []
        if text and self.rows is None:
            self.out.append((self.size, text))
        elif text and self.by_links:
            self.rows.append([text, self.href])
        elif text:
            self.rows[-1:] = [[*(self.rows[-1] if self.rows else []), text]]

    def end_table(self) -> None:
        self.flush()
        if self.rows:
            self.out.append((None, self.rows))
        self.rows, self.by_links = None, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in UNSEEN:
            self.unseen += 1
        elif tag in HEADINGS or tag in BLOCKS or tag == "br":
            self.flush()
            self.size = HEADINGS.get(tag, PLAIN)
            if tag == "nav" and self.rows is None:
                self.rows, self.by_links = [], True
        elif tag == "table" and self.rows is None:
            self.flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None and not self.by_links:
            self.flush()
            self.rows.append([])
        elif tag in ("td", "th"):
            self.flush()
        elif tag == "a":
            self.href = dict(attrs).get("href") or ""

    def handle_endtag(self, tag: str) -> None:
        if tag in UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif tag == ("nav" if self.by_links else "table") and self.rows is not None:
            self.end_table()
        elif tag in HEADINGS or tag in BLOCKS:
            self.flush()
            self.size = PLAIN
        elif tag in ("td", "th") and self.rows is not None:
            if not "".join(self.text).strip():
                self.rows[-1:] = [[*(self.rows[-1] if self.rows else []), ""]]
                self.text = []
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.text.append(data)


def tokens(html: str | None) -> list[tuple]:
    t = Tokens()
    t.feed(html or "")
    t.close()
    t.end_table()
    return t.out


def wrapped(text: str, most: int) -> Iterator[str]:
    """Lines of at most ``most`` characters; a longer word is cut."""
    now = ""
    for word in text.split(" "):
        while len(word) > most:
            if now:
                yield now
                now = ""
            yield word[:most]
            word = word[most:]
        if now and len(now) + 1 + len(word) > most:
            yield now
            now = word
        else:
            now = f"{now} {word}" if now else word
    if now:
        yield now


class Flow:
    """Where the next line goes on a document's sheets."""

    def __init__(self, width: float, height: float, columns: int):
        self.page, self.column, self.top, self.y = 1, 0, EDGE, EDGE
        self.columns, self.bottom = columns, height - EDGE
        self.full = width - 2 * SIDE
        self.wide = (self.full - GUTTER * (columns - 1)) / columns

    @property
    def x(self) -> float:
        return SIDE + self.column * (self.wide + GUTTER)

    def room(self, need: float) -> None:
        """Goes to the next column or sheet if ``need`` points don't fit any more."""
        if self.y > self.top and self.y + need > self.bottom:
            self.column += 1
            if self.column == self.columns:
                self.page, self.column, self.top = self.page + 1, 0, EDGE
            self.y = self.top


def placed(blocks: list[tuple], width: float, height: float, columns: int) -> Iterator[tuple]:
    """(kind, page, block, line, x0, y0, x1, y1, size, text, cells) of blocks in flow. A heading of the
    first size at the head of the columns goes over all of them."""
    at = Flow(width, height, columns)
    for n, (size, value) in enumerate(blocks):
        if size is None:
            rows = list(value)
            while rows:
                at.room(min(len(rows), 2) * ROW)
                fit = max(1, int((at.bottom - at.y) // ROW))
                some, rows = rows[:fit], rows[fit:]
                yield "table", at.page, n, 0, at.x, at.y, at.x + at.wide, at.y + ROW * len(some), None, None, some
                for k, cells in enumerate(some):
                    yield "span", at.page, n, k, at.x, at.y + 2.0, at.x + at.wide, at.y + 2.0 + PLAIN, PLAIN, " ".join(cells), None
                    at.y += ROW
            at.y += APART
            continue
        over = size == HEADINGS["h1"] and at.column == 0
        wide = at.full if over else at.wide
        for k, line in enumerate(wrapped(value, max(1, int(wide / (size * ADVANCE))))):
            at.room(size)
            yield "span", at.page, n, k, at.x, at.y, at.x + size * ADVANCE * len(line), at.y + size, size, line, None
            at.y += size * LEADING
        at.y += APART
        if over:
            at.top = at.y
    yield "sheets", at.page, 0, 0, None, None, None, None, None, None, None


def decoded_web(pages: DataFrame, columns: Column | None = None) -> DataFrame:
    """DECODED rows of (page_id, html), a document for each page_id; sheets and columns go by the id.

    Null html makes one blank sheet.
    """
    columns = F.when(F.pmod("page_id", F.lit(2)) == 1, 2).otherwise(1) if columns is None else columns
    own = pages.select(F.col("page_id").cast("string").alias("doc_id"), "html", F.coalesce(columns, F.lit(1)).alias("columns"), *[F.coalesce(c, F.lit(SIZE[s])).alias(s) for s, c in sheet(F.col("page_id")).items()])
    arrow = to_arrow_schema(StructType.fromDDL(DECODED))

    def rows_of(doc: str, html: str | None, columns: int, width: float, height: float) -> Iterator[tuple]:
        for kind, page, block, line, x0, y0, x1, y1, size, text, cells in placed(tokens(html), width, height, columns):
            if kind == "sheets":
                for k in range(1, page + 1):
                    yield (doc, "page", k, 0, 0, 0, 0.0, 0.0, width, height, None, None, None, None, page, width, height)
            else:
                yield (doc, kind, page, block, line, 0, x0, y0, x1, y1, size, text, cells, None, None, width, height)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in ("doc_id", "html", "columns", "width", "height")], strict=True):
                for row in rows_of(*r):
                    out.append(row)
                    if len(out) >= 5000:
                        yield batch(out)
                        out = []
        if out:
            yield batch(out)

    return own.mapInArrow(run, DECODED)
