"""Hand-written cases of the catalog against their expected rows, and properties of the plan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import layout, outline, post, sections
from quirefold.plans import cases, catalog
from quirefold.plans.convert import ConvertOptions

LINE = "doc_id string, page_no int, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double, size double, text string"


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """Three documents, one without text and one with too few words, as a folder of tables."""
    path = tmp_path_factory.mktemp("few")
    rows = [(7, "Some ünusual words come, and then others follow."), (8, None), (-9, "only A FEW x1")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    return str(path), {7: ["ome", "nusual", "words", "come", "and"], 8: [*cases.SPARE], -9: ["only", *cases.SPARE[:4]]}


def filled(template, doc, words):
    if not isinstance(template, str):
        return template
    of = {p: w for p, w in zip("abcde", words, strict=True)}
    of |= {p.upper(): w.capitalize() for p, w in of.items()} | {"id": str(doc)}
    return re.sub(r"\{(id|[a-eA-E])\}", lambda m: of[m[1]], template)


@pytest.mark.parametrize("name", sorted(cases.CASES))
def test_case(spark, few, name):
    path, words = few
    got = {(r.doc_id, r.k): r.result for r in cases.case(name)(spark, path).collect()}
    assert got == {(d, k): filled(y, d, w) for d, w in words.items() for k, (_, y) in enumerate(cases.CASES[name][1])}


def test_cases_of_rows(spark, few):
    path, words = few
    q = cases.queries()
    rows = lambda name, *c: {tuple(r[x] for x in c) for r in q[name](spark, path).collect()}
    each = lambda templates, f: {f(d, w, k, t) for d, w in words.items() for k, t in enumerate(templates)}
    assert rows("rubric_tables", "doc_id", "k", "md") == each(cases.CELLS, lambda d, w, k, t: (d, k, filled(t[1], d, w)))
    for name, (_, after) in (("footnote_rebalance", cases.MOVED), ("orphan_markers", cases.ORPHANS)):
        assert rows(name, "doc_id", "pos", "body") == each(after, lambda d, w, k, t: (d, k, filled(t, d, w)))
    assert rows("parts_combined", "stem", "text") == each(cases.PARTS[1], lambda d, w, k, t: (filled(t[0], d, w), filled(t[1], d, w)))
    assert rows("heartbeat", "doc_id", "k", "result") == each(cases.BEATS, lambda d, w, k, t: (d, k, t[5]))
    assert rows("resolved_drop", "drop_id", "path", "message") == each(cases.DROPS, lambda d, w, k, t: (10 * d + k, filled(t[3], d, w), t[4]))
    assert rows("valid_paths", "id", "ok", "message") == each(cases.INPUTS, lambda d, w, k, t: (10 * d + k, t[1] is None, t[1]))
    assert rows("resolved_sections", "id", "message") == each(cases.WANTED, lambda d, w, k, t: (10 * d + k, t[1]))


def test_course_rows():
    flat = "Course Name Course Type Course Code Prerequisite 10 Art Open AVI1O None 11 University ICS3U Some words 12 Nothing 11 Art, Open x AVI2O"
    assert list(post.course_rows(flat)) == [
        ("10", "Art", "Open", "AVI1O", "None"), ("11", "Some words 12 Nothing 11 Art, Open x", "University", "ICS3U", "(unspecified)"), ("11", "Art,".strip(","), "Open", "AVI2O", "(unspecified)"),
    ]
    assert list(post.course_rows("AVI1O 10 AVI2O Open AVI3O")) == [] and list(post.course_rows("")) == []
    assert list(post.course_rows("Open 12 AVI1O")) == [("12", "(unknown)", "Open", "AVI1O", "(unspecified)")]
    need = "Grade 11 Introduction to Computer Programming, College"
    assert list(post.course_rows(f"12 College ICS4C {need} Last one 10 More words Open")) == [("12", "Last one", "College", "ICS4C", need)]


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_bad_options():
    with pytest.raises(ValueError):
        ConvertOptions(decoder="other")
    with pytest.raises(ValueError):
        ConvertOptions(mode="pages")


def test_paragraphs_and_hyphens(spark):
    rows = [("a", 1, 0, 0, 72.0, 40.0, 300.0, 50.0, 10.0, "an exam-"), ("a", 1, 0, 1, 72.0, 51.0, 300.0, 61.0, 10.0, "ple goes"), ("a", 1, 0, 2, 72.0, 90.0, 300.0, 100.0, 10.0, "next")]
    got = layout.paragraphs(spark.createDataFrame(rows, LINE)).orderBy("para").collect()
    assert [r["text"] for r in got] == ["an example goes", "next"]


def test_noise_needs_two_pages(spark):
    rows = [("a", p, 0, 0, 72.0, 20.0, 300.0, 30.0, 10.0, "Guide" if p < 3 else "Other") for p in range(1, 5)]
    got = sections.noise_profile(spark.createDataFrame(rows, LINE)).collect()
    assert {(r["band"], r["norm"]) for r in got} == {("top", "guide"), ("top", "other")}


def test_empty_section_ends_before_its_start(spark):
    rows = [("a", 0, 1, "x", 2, None, "s"), ("a", 1, 1, "y", 2, None, "s")]
    o = spark.createDataFrame(rows, outline.ENTRY)
    counts = spark.createDataFrame([("a", 4)], "doc_id string, page_count int")
    got = [(r["start"], r["end"]) for r in sections.section_ranges(o, counts).orderBy("pos").collect()]
    assert got == [(2, 1), (2, 4)]


def test_normalized_is_stable(spark):
    rows = [("a", 0, 3, "One", 2, None, "s"), ("a", 1, 9, "Two", 1, None, "s"), ("a", 2, 1, "one", 3, None, "s")]
    once = outline.normalized(spark.createDataFrame(rows, outline.ENTRY))
    assert [(r["level"], r["title"], r["page_start"]) for r in once.orderBy("pos").collect()] == [(3, "One", 2), (4, "Two", 2)]
    assert sorted(outline.normalized(once).collect()) == sorted(once.collect())


def test_keys_are_idempotent(spark):
    df = spark.createDataFrame([("A <i>b</i> C-d",), (None,), ("  ",)], "x string").select(T.match_key(F.col("x")).alias("k"))
    assert df.select(T.match_key(F.col("k")).alias("k")).collect() == df.collect()


def test_table_overlap_judges_every_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(o, n, float(rng.randrange(1, 51)), float(rng.randrange(11)) / 100) for o in range(1, 41) for n in range(1, 8)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    box = lambda q, d: (q * 2, d * 200, q * 2 + 60, d * 200 + 12)

    def share(x, y):
        w, h = (max(min(x[k + 2], y[k + 2]) - max(x[k], y[k]), 0) / max(x[k + 2] - x[k], 1) for k in (0, 1))
        return w * h

    boxes = {(o, n): box(q, d) for o, n, q, d in rows}
    want = {k for k, x in boxes.items() if k[1] <= 3 and not any(share(x, boxes[k[0], n]) >= 0.45 for n in range(4, 8))}
    got = {tuple(r) for r in catalog.queries()["table_overlap"](spark, str(tmp_path)).collect()}
    assert got == want and any(o % 10 for o, _ in got)


BOX = "doc_id string, page_no int, line_no int, x0 double, y0 double, x1 double, y1 double"


def covered(x, t):
    common = [max(0.0, min(x[b], t[b]) - max(x[a], t[a])) / max(1.0, x[b] - x[a]) for a, b in ((3, 5), (4, 6))]
    return common[0] * common[1] >= 0.45


def test_covered_lines_of_any_size_and_place(spark):
    rng = random.Random(4)
    inf, nan = float("inf"), float("nan")
    side = lambda: rng.choice([0.0, 0.5, 9.0, 30.0, 120.0, 199.0, 400.0, 999.0, 2500.0])
    place = lambda: rng.choice([rng.uniform(-300, 900), rng.uniform(6000, 7000), rng.uniform(90, 110)])

    def box(k):
        x, y = place(), place()
        return ("d", rng.randrange(2), k, x, y, x + side(), y + side())

    lines, tables = [box(k) for k in range(700)], [box(k) for k in range(60)]
    lines += [("d", 0, 700, nan, 1.0, nan, 2.0), ("d", 0, 701, -inf, 0.0, inf, 9.0), ("d", 0, 702, None, 1.0, 2.0, 3.0)]
    lines += [("d", 0, 703 + k, t[3] + 0.54 * (t[5] - t[3]), t[4], t[5] + 0.17 * (t[5] - t[3]), t[6]) for k, t in enumerate(tables)]  # just covered or just not
    got = {r.line_no for r in layout.outside_tables(spark.createDataFrame(lines, BOX), spark.createDataFrame(tables + [("d", 0, 0, None, nan, 1.0, 2.0)], BOX)).collect()}
    plain = {x[2] for x in lines if not (700 <= x[2] <= 702) and any(x[1] == t[1] and covered(x, t) for t in tables)}
    assert got == {x[2] for x in lines} - plain and len(plain) > 60


def test_page_of_very_many_boxes(spark):
    """Ten thousand lines and tables on one page: few pairs are tried."""
    n = 100
    lines = [("d", 1, r * n + c, 60.0 * c, 20.0 * r, 60.0 * c + 50, 20.0 * r + 10) for r in range(n) for c in range(n)]
    tables = [(*x[:5], x[5] - 26.0, x[6]) for x in lines if (x[2] * 7) % 3]  # cover 48 % of two lines of three
    own, there = layout.celled(spark.createDataFrame(lines, BOX), spark.createDataFrame(tables, BOX))
    tried = own.join(there, ["doc_id", "page_no", "cell"]).count()
    assert tried <= len(lines) * len(tables) / 200
    left = layout.outside_tables(spark.createDataFrame(lines, BOX), spark.createDataFrame(tables, BOX))
    assert left.count() == len(lines) - len(tables) and left.columns == own.columns[:-1]


def test_line_functions_over_odd_white_space(spark):
    odd = ["\u3000a\x00\x01 \u2028b\ufffc\x85", "\x00\ufffc \t\x1f\u00a0", None, "12\u00a0Page 3 x\u2003 7", "a\u200bb"]
    df = spark.createDataFrame([(x,) for x in odd], "x string").select(T.clean_line(F.col("x")).alias("c"), T.margin_key(F.col("x")).alias("m"), T.has_text(F.col("x")).alias("h"))
    assert [tuple(r) for r in df.collect()] == [("a b", "a b", True), ("", "", False), ("", "", False), ("12 Page 3 x 7", "x", True), ("a\u200bb", "a b", True)]
