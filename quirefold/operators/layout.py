"""Lines, reading order, paragraphs and blocks of pages.

``LINE`` frames hold one row per decoded line. Order within a page and the joining of lines are
folds over some tens of rows, so they run on sorted partitions, one Arrow batch after another, and
hold one page or section at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quirefold.functions.plain import has_text as has_text_in
from quirefold.functions.text import clean_line, has_text

BULLET = re.compile(r"([•\-*]|\d+\.)\s+")
# Shares of the page's width, counts and distances in points.
NARROW, FULL, APART, NEAR, NEAR_LEAST = 0.62, 0.72, 0.18, 0.08, 18.0
LEAST_LINES, LEAST_NARROW, LEAST_CLUSTER, CLUSTER_SHARE = 10, 6, 3, 0.12
#: Points of a page whose size isn't told.
SIZE = {"width": 612.0, "height": 792.0}


def page_size(rows: DataFrame, side: str) -> Column:
    """Width or height of the page that a row is on: its own column, else the default."""
    return F.coalesce(F.col(side), F.lit(SIZE[side])) if side in rows.columns else F.lit(SIZE[side])


def sized(rows: DataFrame, pages: DataFrame | None) -> DataFrame:
    """Rows with the ``width`` and ``height`` of their page of ``pages`` (doc_id, page_no, width, height).

    Rows that carry both from decoding need no join; a page that isn't told has the default size.
    """
    if pages is not None and not set(SIZE) <= set(rows.columns):
        told = pages.select("doc_id", "page_no", *SIZE).dropDuplicates(["doc_id", "page_no"])
        rows = rows.drop(*SIZE).join(told, ["doc_id", "page_no"], "left")
    return rows.withColumns({side: page_size(rows, side) for side in SIZE})


class Line(NamedTuple):
    x0: float
    y0: float
    x1: float
    y1: float
    text: str


class Table(NamedTuple):
    x0: float
    y0: float
    x1: float
    y1: float
    md: str


def differs(c: pa.Array) -> np.ndarray:
    """Whether each value but the first is another one than that before it; two nulls are the same."""
    a, b = c.slice(1), c.slice(0, len(c) - 1)
    other = pc.fill_null(pc.not_equal(a, b), True)
    return pc.and_not(other, pc.and_(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def span_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that follow each other in a line and in a batch as one row: all columns but (span_no, size, text)
    are the same, ``first`` and ``count`` are its numbers, which have no gap, ``text`` its texts parted by \\n.
    """
    for b in batches:
        if not b.num_rows:
            continue
        b = pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in b.columns], names=b.schema.names)
        kept = [c for c in b.schema.names if c not in ("span_no", "size", "text")]
        number = b.column("span_no")
        goes_on = pc.fill_null(pc.equal(number.slice(1), pc.add(number.slice(0, len(number) - 1), 1)), False).to_numpy(zero_copy_only=False)
        new = np.ones(b.num_rows, dtype=bool)
        new[1:] = np.any([~goes_on, *[differs(b.column(c)) for c in kept]], axis=0)
        at = np.flatnonzero(new)
        ends = np.append(at, b.num_rows)
        size = np.maximum.reduceat(b.column("size").to_numpy(zero_copy_only=False), at)  # NaN is the largest, as in Spark
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), b.column("text").cast(pa.string())), "\n")
        columns = [*[b.column(c).take(pa.array(at)) for c in kept], number.take(pa.array(at)), pa.array(np.diff(ends), pa.int32()), pa.array(size), text]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, "first", "count", "size", "text"])


def lines_of_spans(spans: DataFrame) -> DataFrame:
    """Lines of spans (doc_id, page_no, block_no, line_no, span_no, x0, y0, x1, y1, size, text).

    A line's text is its cleaned spans joined by spaces, its size the largest of spans with text;
    lines without text go. The box is the line's, so any span's (x0 ... y1) tells it. The page's
    width and height stay with the line if the spans have them.

    Spans that come one after the other, as decoded ones do, meet as runs before the shuffle, which
    then moves little more than texts; in any other order there are only more runs. Spans joined by
    blanks and then cleaned are the cleaned spans joined, so a line is cleaned once; \\n is a blank anyway.
    """
    by = ["doc_id", "page_no", "block_no", "line_no"]
    sides = ["x0", "y0", "x1", "y1", *[c for c in SIZE if c in spans.columns]]
    own = spans.filter(has_text(F.col("text")))
    s = own.select(*by, *sides, "span_no", F.coalesce("size", F.lit(0.0)).cast("double").alias("size"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    kinds = [f"{c} {key_type(s, c)}" for c in (*by, *sides)]
    runs = s.mapInArrow(span_runs, ", ".join([*kinds, f"first {key_type(s, 'span_no')}, count int, size double, text string"]))
    box = [f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))]
    box += [F.max(c).alias(c) for c in SIZE if c in spans.columns]
    parts = F.array_sort(F.collect_list(F.struct("first", "count", "text")))
    packed = runs.groupBy(*by).agg(*box, F.max("size").alias("size"), parts.alias("_r"))
    r = F.col("_r")
    # Runs in order: each begins after the one before it has ended. Else their spans are sorted one by one.
    apart = F.forall(F.sequence(F.lit(1), F.size(r) - 1), lambda k: F.get(r, k)["first"] >= F.get(r, k - 1)["first"] + F.get(r, k - 1)["count"])
    spread = F.flatten(F.transform(r, lambda x: F.transform(F.split(x["text"], "\n"), lambda t, k: F.struct((x["first"] + k).alias("span_no"), clean_line(t).alias("text")))))
    text = F.when(F.size(r) == 1, r[0]["text"]).when(apart, F.array_join(r["text"], "\n")).otherwise(F.array_join(F.array_sort(spread)["text"], "\n"))
    return packed.select(*by, *sides, "size", clean_line(text).alias("text"))


#: A grid over pages, in points: its cells, how many of them a side has, and the largest lines that it takes.
CELL, CELLS, WIDEST, HIGHEST = 100.0, 64, 1000.0, 200.0


def celled(lines: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and tables with a ``cell``: what covers 45 % of a line has a row in the line's cell.

    It covers as much of the line's width and of its height, so it comes within a twentieth of them
    to the line's middle, whose cell is the line's. Boxes with an edge that is null or not finite cover
    nothing and aren't covered. A table has a row for each cell that it or that
    margin reaches. Beyond the grid the outer cells go on, and lines too large for the margin meet
    all tables of their page, in a cell of their own.
    """
    place = lambda v: F.floor(F.greatest(F.lit(-CELL), F.least(F.lit(CELL * CELLS), v)) / CELL).cast("int")
    key = lambda x, y: x * F.lit(2 * CELLS) + y
    large = (F.col("x1") - F.col("x0") > WIDEST) | (F.col("y1") - F.col("y0") > HIGHEST)
    middle = key(place((F.col("x0") + F.col("x1")) / 2), place((F.col("y0") + F.col("y1")) / 2))
    reach = lambda a, b, most: F.sequence(place(F.col(a) - most / 20), place(F.greatest(F.col(a), F.col(b)) + most / 20))
    across, down_ = reach("x0", "x1", WIDEST), reach("y0", "y1", HIGHEST)
    cells = F.flatten(F.transform(across, lambda x: F.transform(down_, lambda y: key(x, y))))
    every = F.lit(-10 * CELLS * CELLS)
    sound = reduce(lambda p, q: p & q, [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in ("x0", "y0", "x1", "y1")])
    own = F.when(sound, F.when(large, every).otherwise(middle))
    return lines.withColumn("cell", own), tables.filter(sound).withColumn("cell", F.explode(F.concat(cells, F.array(every))))


def outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines that no table of the page covers by 45 % of their area.

    A line covered by 60 % of its width and 80 % of its height is covered by 48 % of its area. Lines
    meet only tables of their cell, so a page of very many boxes isn't compared with itself.
    """
    own, there = celled(lines, tables)
    line, t = own.alias("l"), there.alias("t")
    col = lambda side, c: F.col(f"{side}.{c}")

    def share(a: str, b: str) -> Column:
        common = F.least(col("l", b), col("t", b)) - F.greatest(col("l", a), col("t", a))
        return F.greatest(common, F.lit(0.0)) / F.greatest(col("l", b) - col("l", a), F.lit(1.0))

    by = ["doc_id", "page_no", "cell", *(["pos"] if "pos" in lines.columns and "pos" in tables.columns else [])]
    same = reduce(lambda p, q: p & q, [col("l", c) == col("t", c) for c in by])
    return line.join(t, same & (share("x0", "x1") * share("y0", "y1") >= 0.45), "left_anti").drop("cell")


def clusters(edges: Iterable[float], reach: float) -> list[tuple[float, int]]:
    """(center, count) of values, by a sweep with running means."""
    found: list[list[float]] = []
    for a in sorted(edges):
        near = min(found, key=lambda c: abs(c[0] - a), default=None)
        if near is not None and abs(near[0] - a) <= reach:
            near[0] = (near[0] * near[1] + a) / (near[1] + 1)
            near[1] += 1
        else:
            found.append([a, 1])
    return [(c, int(n)) for c, n in found]


def centers(lines: list[Line], width: float) -> tuple[float, float] | None:
    """Left edges of a page's two columns, or None."""
    narrow = [x.x0 for x in lines if x.x1 - x.x0 <= NARROW * width]
    if len(lines) < LEAST_LINES or len(narrow) < LEAST_NARROW:
        return None
    need = max(LEAST_CLUSTER, int(len(narrow) * CLUSTER_SHARE))
    strong = sorted((c for c in clusters(narrow, max(NEAR_LEAST, NEAR * width)) if c[1] >= need), key=lambda c: -c[1])
    left, right = (sorted(c for c, _ in strong[:2]) + [0.0, 0.0])[:2]
    return (left, right) if len(strong) > 1 and right - left >= APART * width else None


def down(x: Line | Table) -> tuple[float, float]:
    return x.y0, x.x0


def side(x: Line | Table, two: tuple[float, float]) -> int:
    return int(abs(x.x0 - two[0]) > abs(x.x0 - two[1]))


def is_full(x: Line | Table, width: float) -> bool:
    return x.x1 - x.x0 >= FULL * width


def ordered(lines: list[Line], width: float) -> list[Line]:
    """Top full-width lines, the left column, full-width lines between, the right column, the rest."""
    two = centers(lines, width)
    if two is None:
        return sorted(lines, key=down)
    tops = [x.y0 for x in lines if not is_full(x, width)]

    def rank(x: Line) -> int:
        if not is_full(x, width):
            return 1 + 2 * side(x, two)
        return 0 if x.y0 < min(tops) - 4.0 else 4 if x.y0 > max(tops) + 4.0 else 2

    return sorted(lines, key=lambda x: (rank(x), *down(x)))


def joined_lines(lines: list[Line]) -> list[str]:
    """Paragraphs of lines in reading order; hyphens at line ends are undone.

    Only whether the paragraph began with a bullet is carried along.
    """
    out: list[str] = []
    prev, inside = None, False
    for x in lines:
        bullet = bool(BULLET.match(x.text))
        new = prev is None or bullet or x.y0 < prev.y0 - 2.0
        if not new:
            step, gap = x.x0 - prev.x0, x.y0 - prev.y1
            goes_on = inside and step >= -1.0 and gap <= 10.0
            new = not goes_on and (gap > 4.0 or step > 8.0)
        if new:
            out.append(x.text)
            inside = bullet
        elif out[-1][-1:] == "-" and out[-1][-2:-1].isalpha() and x.text[:1].isalpha():
            out[-1] = out[-1][:-1] + x.text
        else:
            out[-1] += f" {x.text}"
        prev = x
    return [p.strip() for p in out]


def between(lines: list[Line], tables: list[Table], arrange: Callable[[list[Line]], list[Line]]) -> Iterator[str]:
    """Paragraphs of the lines above each table, the table, and so on; both sorted downwards."""
    tops, at = [x.y0 for x in lines], 0
    for t in tables:
        cut = max(at, bisect_left(tops, t.y0))
        yield from joined_lines(arrange(lines[at:cut]))
        yield t.md
        at = cut
    yield from joined_lines(arrange(lines[at:]))


def page_blocks(lines: list[Line], tables: list[Table], width: float) -> list[str]:
    """A page's paragraphs and tables in reading order."""
    lines, tables = sorted(lines, key=down), sorted(tables, key=down)
    two = centers(lines, width) if tables else None
    if not tables:
        blocks: Iterable[str] = joined_lines(ordered(lines, width))
    elif two is None:
        blocks = between(lines, tables, lambda part: ordered(part, width))
    else:
        wide = [x for x in lines if is_full(x, width)]
        blocks = [*joined_lines(wide), *[t.md for t in tables if is_full(t, width)]]
        for k in (0, 1):
            own = lambda xs, k=k: [x for x in xs if not is_full(x, width) and side(x, two) == k]
            blocks += between(own(lines), own(tables), lambda part: part)
    return [b for b in blocks if has_text_in(b)]


def values(c: pa.Array) -> list:
    """A column's values as Python's own; numbers go over whole, and of structs only those that aren't null."""
    if pa.types.is_struct(c.type) and c.null_count:
        out: list = [None] * len(c)
        at = np.flatnonzero(c.is_valid().to_numpy(zero_copy_only=False))
        for i, x in zip(at.tolist(), c.take(pa.array(at)).to_pylist(), strict=True):
            out[i] = x
        return out
    if c.null_count or not (pa.types.is_integer(c.type) or pa.types.is_floating(c.type)):
        return c.to_pylist()
    return c.to_numpy(zero_copy_only=False).tolist()


def streamed(
    df: DataFrame, by: list[str], order: list[str], fold: Callable[[tuple, Iterable[tuple]], Iterator[tuple]], schema: str | StructType, whole: bool = True
) -> DataFrame:
    """Folds each group of rows, in ``order``, into rows of ``schema``; one group is held at a time.

    ``fold`` gets the group's key and its rows as tuples of df's columns: a list, or, if not ``whole``,
    an iterator that holds no row which was passed. Groups are dealt by key and stream through one
    Python worker per partition, with no start-up cost per group.
    """
    columns, at = df.columns, [df.columns.index(c) for c in by]
    dealt = df.repartition(*by).sortWithinPartitions(*by, *order)
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[values(b.column(c)) for c in columns], strict=True))
        out: list[tuple] = []
        for k, group in groupby(rows, key=lambda r: tuple(r[i] for i in at)):
            out.extend(fold(k, list(group) if whole else group))
            if len(out) >= 5000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(run, schema)


def key_type(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def reading_order(lines: DataFrame) -> DataFrame:
    """Adds ``seq``, the place of a line in the reading order of its page, whose own width decides."""
    own = lines.select("doc_id", "page_no", "block_no", "line_no", "x0", "y0", "x1", "y1", F.coalesce("text", F.lit("")).alias("text"), page_size(lines, "width").alias("width"))
    schema = f"doc_id {key_type(own, 'doc_id')}, page_no int, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, seq int"

    def fold(k: tuple, rows: list[tuple]) -> Iterator[tuple]:
        boxes = [Line(*r[4:8], n) for n, r in enumerate(rows)]
        for seq, x in enumerate(ordered(boxes, rows[0][9])):
            yield (*rows[x.text][:9], seq)

    return streamed(own, ["doc_id", "page_no"], ["block_no", "line_no"], fold, schema)


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, para, text): lines, in the order in which they were decoded, as paragraphs."""
    own = lines.select("doc_id", "page_no", "block_no", "line_no", "x0", "y0", "x1", "y1", clean_line(F.col("text")).alias("text"))
    schema = f"doc_id {key_type(own, 'doc_id')}, page_no int, para int, text string"

    def fold(k: tuple, rows: list[tuple]) -> Iterator[tuple]:
        for n, p in enumerate(joined_lines([Line(*r[4:]) for r in rows])):
            yield (*k, n, p)

    return streamed(own.filter("text <> ''"), ["doc_id", "page_no"], ["block_no", "line_no"], fold, schema)
