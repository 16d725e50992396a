"""Web pages on sheets, and page assembly against plain loops over each page."""

import re

from quirefold.operators import bodies
from quirefold.sources import web
from quirefold.sources.decoded import frames

PAGES = "page_id bigint, html string"
TABLE = "<table><tr><th>Name</th><th>Of | it</th></tr><tr><td>a</td><td></td></tr><tr><td>b &amp; c</td><td>2</td></tr></table>"


def test_tokens():
    html = f"<html><head><title>no</title><style>p{{}}</style></head><body><nav><ul><li><a href='/x'>One</a></li><li><a>Two</a></li></ul></nav><h1>Head <b>it</h1><p>a<p>b<br>c<script>var p='</p>';</script>{TABLE}tail &copy;"
    assert web.tokens(html) == [
        (None, [["One", "/x"], ["Two", ""]]), (18.0, "Head it"), (10.0, "a"), (10.0, "b"), (10.0, "c"),
        (None, [["Name", "Of | it"], ["a", ""], ["b & c", "2"]]), (10.0, "tail ©"),
    ]
    assert web.tokens(None) == web.tokens("") == web.tokens("<nav></nav><table></table><p> </p>") == []
    assert [t for _, t in web.tokens("<td>x</td></table></nav></p>y<nav>z")][0] == "x"


def test_wrapped_lines():
    assert list(web.wrapped("aa bb cc", 5)) == ["aa bb", "cc"] and list(web.wrapped("x " + "y" * 7, 3)) == ["x", "yyy", "yyy", "y"]


def down(x):
    return x["y0"], x["x0"]


def two_columns(lines, width):
    narrow = sorted(x["x0"] for x in lines if x["x1"] - x["x0"] <= 0.62 * width)
    if len(lines) < 10 or len(narrow) < 6:
        return None
    found = []
    for a in narrow:
        near = sorted(range(len(found)), key=lambda k: abs(found[k][0] / found[k][1] - a))[:1]
        if near and abs(found[near[0]][0] / found[near[0]][1] - a) <= max(18, 0.08 * width):
            found[near[0]][0] += a
            found[near[0]][1] += 1
        else:
            found.append([a, 1])
    best = sorted((c for c in found if c[1] >= max(3, int(0.12 * len(narrow)))), key=lambda c: -c[1])[:2]
    ends = sorted(s / n for s, n in best)
    return ends if len(ends) == 2 and ends[1] - ends[0] >= 0.18 * width else None


def in_order(lines, width):
    lines, two = sorted(lines, key=down), two_columns(lines, width)
    if not two:
        return lines
    wide = [x for x in lines if x["x1"] - x["x0"] >= 0.72 * width]
    rest = [x for x in lines if x not in wide]
    a, b = min(x["y0"] for x in rest), max(x["y0"] for x in rest)
    columns = [[x for x in rest if (abs(x["x0"] - two[0]) <= abs(x["x0"] - two[1])) == left] for left in (True, False)]
    top, end = [x for x in wide if x["y0"] < a - 4], [x for x in wide if x["y0"] > b + 4]
    return top + columns[0] + [x for x in wide if x not in top and x not in end] + columns[1] + end


def joined(lines):
    out, last, bulleted = [], None, False
    for x in lines:
        bullet = bool(re.match(r"([•\-*]|\d+\.)\s", x["text"]))
        if last:
            gap, step = x["y0"] - last["y1"], x["x0"] - last["x0"]
            on = bulleted and not bullet and step >= -1 and gap <= 10
        if not last or x["y0"] < last["y0"] - 2 or (gap > 4 and not on) or bullet or (step > 8 and not on):
            out.append(x["text"])
            bulleted = bullet
        elif re.search(r"[^\W\d_]-$", out[-1]) and x["text"][0].isalpha():
            out[-1] = out[-1][:-1] + x["text"]
        else:
            out[-1] += " " + x["text"]
        last = x
    return out


def mingled(lines, tables, arrange):
    out, lines = [], sorted(lines, key=down)
    for t in sorted(tables, key=down):
        above = [x for x in lines if x["y0"] < t["y0"]]
        lines = lines[len(above) :]
        out += [*joined(arrange(above)), t["md"]]
    return out + joined(arrange(lines))


def assembled(lines, tables, width):
    def covered(x):
        w, h = max(1, x["x1"] - x["x0"]), max(1, x["y1"] - x["y0"])
        common = lambda t, a, b: max(0, min(x[b], t[b]) - max(x[a], t[a]))
        return any(common(t, "x0", "x1") * common(t, "y0", "y1") / (w * h) >= 0.45 for t in tables)

    lines = [x for x in lines if not covered(x)]
    two = two_columns(lines, width)
    if not tables:
        return joined(in_order(lines, width))
    if not two:
        return mingled(lines, tables, lambda part: in_order(part, width))
    full = lambda x: x["x1"] - x["x0"] >= 0.72 * width
    out = joined(sorted(filter(full, lines), key=down)) + [t["md"] for t in sorted(filter(full, tables), key=down)]
    for left in (True, False):
        own = lambda rows, left=left: [x for x in rows if not full(x) and (abs(x["x0"] - two[0]) <= abs(x["x0"] - two[1])) == left]
        out += mingled(own(lines), own(tables), list)
    return out


def by_page(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.doc_id, r.page_no), []).append(r.asDict())
    return out


def compare(pages):
    lines, _, cells, sheets = frames(web.decoded_web(pages))
    tables = bodies.page_tables(cells)
    got = {k: [r["text"] for r in sorted(v, key=lambda r: r["seq"])] for k, v in by_page(bodies.page_blocks(lines, tables)).items()}
    a, b, size = by_page(lines), by_page(tables), by_page(sheets)
    for rows in a.values():
        rows.sort(key=lambda r: (r["block_no"], r["line_no"]))
    want = {k: assembled(a.get(k, []), b.get(k, []), size[k][0]["width"]) for k in a.keys() | b.keys()}
    assert got == {k: v for k, v in want.items() if v}
    return got, a, b, size


def test_page_blocks_of_whole_pages(spark):
    got, lines, tables, size = compare(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    both = [k for k in tables if two_columns(lines[k], size[k][0]["width"])]
    assert len(got) > 50 and both and len(tables) > len(both)  # all three ways to put a page together
    assert {v[0]["height"] for v in size.values()} == {792.0, 842.0, 612.0, 595.0}


def test_page_blocks_with_tables_anywhere(spark):
    text = " ".join(f"word{k}" for k in range(160))
    html = f"<h1>Top of it</h1><p>{text}</p>{TABLE}<p>- {text}</p><ol><li>1. one</li></ol>{TABLE}{TABLE}<p>{text}</p>"
    rows = [(k, html if k < 8 else None if k == 8 else f"<p>only</p>{TABLE}") for k in range(10)]
    got, *_ = compare(spark.createDataFrame(rows, PAGES))
    assert ("8", 1) not in got and got["9", 1] == ["only", "| Name | Of \\| it |\n|---|---|\n| a |  |\n| b & c | 2 |"]


def test_long_tables_go_on_over_sheets(spark):
    html = "<table>" + "".join(f"<tr><td>{k}</td><td>x{k}</td></tr>" for k in range(200)) + "</table>"
    _, _, cells, sheets = frames(web.decoded_web(spark.createDataFrame([(0, html)], PAGES)))
    found = cells.orderBy("page_no").collect()
    assert sum(len(r.cells) for r in found) == 200 and len(found) == sheets.count() > 4
