"""The whole plan on small documents, with results worked out by hand."""

import json
import random
import re
import sys
import types

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quirefold import store
from quirefold.functions import plain
from quirefold.functions import text as T
from quirefold.operators import bodies, dedup, layout, outline, post, sections
from quirefold.plans.convert import ConvertOptions, convert, files, markdown_files
from quirefold.plans.sinks import write_files
from quirefold.streaming.ingest import convert_stream
from quirefold.sources import adapters, decoded

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test
LINE = "doc_id string, page_no int, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double, size double, text string"


def line(doc, page, n, y, text, size=10.0, x=72.0, width=None):
    return (doc, page, 0, n, x, y, x + (width or 5.0 * len(text)), y + 10.0, size, text)


def guide():
    """Three pages: a title page, two parts by contents table, running headers and page numbers."""
    rows = [line("guide", 1, 0, 200.0, "The Complete Guide", 18.0), line("guide", 1, 1, 260.0, "Some words before the parts.")]
    for p in (2, 3):
        rows += [line("guide", p, 0, 20.0, f"{p} Guide header"), line("guide", p, 9, 770.0, f"Page {p} of 3")]
    rows += [
        line("guide", 2, 1, 100.0, "The Scope", 14.0), line("guide", 2, 2, 130.0, "This part tells what is in-"), line("guide", 2, 3, 142.0, "cluded and 3 things more."),
        line("guide", 2, 4, 300.0, "Methods", 14.0), line("guide", 2, 5, 340.0, "First we look;2 then we act."), line("guide", 2, 6, 380.0, "2 The note of it."),
        line("guide", 3, 1, 100.0, "Done as follows:"), line("guide", 3, 2, 140.0, "A. one"), line("guide", 3, 3, 180.0, "B. two"),
    ]
    return rows


TOC = [("guide", 0, 1, "The Scope", 2), ("guide", 1, 2, "Methods", 2)]
SCOPE = "This part tells what is included and 3 things more."
TOC_SCHEMA = "doc_id string, toc_no int, level int, title string, page int"


@pytest.fixture(scope="module")
def converted(spark):
    return convert(spark.createDataFrame(guide(), LINE).repartition(3), spark.createDataFrame(TOC, TOC_SCHEMA)).persist()


def test_sections(converted):
    got = [tuple(r) for r in converted.orderBy("pos").select("code", "title", "source", "start", "end", "line_count", "file", "body").collect()]
    methods = "First we look;2 then we act.\n\nDone as follows:\n\n- A. one\n\n- B. two\n\n2 The note of it."
    assert got == [
        ("1.0.0", "Front Matter", "synthetic-front-matter", 1, 2, 2, "1.0.0-front-matter.md", "The Complete Guide\n\nSome words before the parts."),
        ("2.0.0", "The Scope", "pdf-outline", 2, 2, 1, "2.0.0-the-scope.md", SCOPE),
        ("2.1.0", "Methods", "pdf-outline", 2, 3, 5, "2.1.0-methods.md", methods),
    ]


def test_footnotes_kept(spark):
    rows = [
        line("d", 1, 0, 1.0, "Alpha", 14.0), line("d", 1, 1, 60.0, "It says;1 so."), line("d", 1, 2, 200.0, "Beta", 14.0), line("d", 1, 3, 260.0, "1 The note."), line("d", 1, 4, 300.0, "Other text."),
    ]
    toc = spark.createDataFrame([("d", 0, 1, "Alpha", 1), ("d", 1, 1, "Beta", 1)], TOC_SCHEMA)
    got = [r.body for r in convert(spark.createDataFrame(rows, LINE), toc, ConvertOptions(keep_footnotes=True)).orderBy("pos").collect()]
    assert got == ["It says;<sup>1</sup> so.\n\n<sup>1</sup> The note.", "Other text."]


def test_files(spark, converted, tmp_path):
    written = write_files(files(converted), str(tmp_path)).collect()
    names = sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*.*"))
    assert names == sorted(["guide/outline.md", "guide/outline.json", "guide/segments.json", *[f"guide/Sections/{x}.md" for x in ("1.0.0-front-matter", "2.0.0-the-scope", "2.1.0-methods")]])
    assert len(written) == 6
    scope = (tmp_path / "guide/Sections/2.0.0-the-scope.md").read_text()
    assert scope == f"# The Scope\n\n- Level: 1\n- Pages: 2-2\n- Source: pdf-outline\n\n{SCOPE}\n"
    entries = json.loads((tmp_path / "guide/outline.json").read_text())
    assert [(e["id"], e["level"], e["section_file"], e["y0"]) for e in entries] == [
        ("h0", 1, "Sections/1.0.0-front-matter.md", 0.0), ("h1", 1, "Sections/2.0.0-the-scope.md", 100.0), ("h2", 2, "Sections/2.1.0-methods.md", 300.0),
    ]
    segments = json.loads((tmp_path / "guide/segments.json").read_text())
    assert [(s["id"], s["title"], s["page_start"], s["page_end"]) for s in segments] == [("s1", "Front Matter", 1, 2), ("s2", "The Scope", 2, 2), ("s3", "Methods", 2, 3)]
    md = (tmp_path / "guide/outline.md").read_text().split("\n")
    assert md[:2] == ["# Outline", ""] and md[3] == f"- L1 p2 [The Scope](Sections/2.0.0-the-scope.md) (lines: 1, chars: {len(SCOPE)})" and md[-1] == ""
    # A later run of the mode replaces its Markdown files.
    write_files(files(converted.filter("pos = 1")), str(tmp_path)).collect()
    assert [p.name for p in (tmp_path / "guide/Sections").iterdir()] == ["2.0.0-the-scope.md"]


def test_modes(spark, converted):
    one = lambda mode: {r.file: r.text for r in markdown_files(converted, ConvertOptions(mode=mode, metadata=False)).collect()}
    single = one("single")["guide.md"]
    assert single.startswith("## Table of Contents\n\n| Section | Page |\n|---|---:|\n| Front Matter | 1 |\n| The Scope | 2 |\n| Methods | 2 |\n\n# Front Matter\n\nThe Complete Guide")
    assert single.endswith("\n") and not single.endswith("\n\n")
    major = one("major")
    assert set(major) == {"By Major Heading/1.0.0-front-matter.md", "By Major Heading/2.0.0-the-scope.md"}
    assert major["By Major Heading/2.0.0-the-scope.md"].startswith("# The Scope\n\nThis part") and "\n\n## Methods\n\nFirst" in major["By Major Heading/2.0.0-the-scope.md"]


def test_single_mode_has_one_titled_entry_without_contents(spark):
    rows = spark.createDataFrame(guide(), LINE)
    got = convert(rows, None, ConvertOptions(mode="single")).collect()
    assert [(r.title, r.source, r.start, r.end) for r in got] == [("The Complete Guide", "single-fallback", 1, 3)]


def test_tables_between_columns(spark):
    """Two columns of six lines and a table in the right one, whose own text lines go."""
    rows = [line("t", 1, k, 100.0 + 30 * k, f"Left {k}.", x=72.0, width=150.0) for k in range(6)]
    rows += [line("t", 1, 10 + k, 100.0 + 30 * k, f"Right {k}.", x=330.0, width=150.0) for k in range(6)]
    rows += [line("t", 1, 20, 262.0, "in table", x=330.0, width=60.0)]
    cells = [("t", 1, 325.0, 258.0, 480.0, 275.0, [["a", "b"], ["1", "2"]]), ("t", 1, 325.0, 258.0, 480.0, 275.0, [["a", "b"], ["1", "2"]]), ("t", 1, 0.0, 5.0, 9.0, 9.0, [["x"]])]
    boxes = spark.createDataFrame(cells, "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double, cells array<array<string>>")
    assert bodies.page_tables(boxes).count() == 1
    body = convert(spark.createDataFrame(rows, LINE), cells=boxes).first().body
    md = "| a | b |\n|---|---|\n| 1 | 2 |"
    assert body == "\n\n".join([*[f"Left {k}." for k in range(6)], *[f"Right {k}." for k in range(6)], md])


def test_reading_order(spark):
    """Full-width lines above, between and below two columns."""
    rows = [line("p", 1, 0, 50.0, "top", width=500.0), line("p", 1, 1, 160.0, "mid", width=500.0), line("p", 1, 2, 400.0, "end", width=500.0)]
    rows += [line("p", 1, 10 + k, 100.0 + 20 * k, f"l{k}", width=150.0) for k in range(5)]
    rows += [line("p", 1, 20 + k, 100.0 + 20 * k, f"r{k}", x=330.0, width=150.0) for k in range(5)]
    random.Random(1).shuffle(rows)
    got = [r.text for r in layout.reading_order(spark.createDataFrame(rows, LINE)).orderBy("seq").collect()]
    assert got == ["top", *[f"l{k}" for k in range(5)], "mid", *[f"r{k}" for k in range(5)], "end"]
    assert layout.clusters([10.0, 12.0, 50.0, 14.0], 18.0) == [(12.0, 3), (50.0, 1)]


def test_anchors(spark):
    rows = [line("a", 1, 0, 50.0, "Results and more"), line("a", 1, 1, 90.0, "Results"), line("a", 1, 2, 130.0, "Results"), line("a", 1, 3, 170.0, "An appendix of tables")]
    titles = ["Results", "Results", "Appendix", "An appendix of tables and figures", "abc"]
    entries = [("a", k, 1, t, 1, None, "pdf-outline") for k, t in enumerate(titles)]
    found = outline.anchored(spark.createDataFrame(entries, outline.ENTRY), spark.createDataFrame(rows, LINE)).orderBy("pos").collect()
    # The second "Results" may take its line again: it isn't before the last anchor, and the nearest.
    assert [r.y0 for r in found] == [90.0, 90.0, 170.0, 170.0, None]


def test_near_repeats_against_a_plain_scan(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta omega sigma".split()) for _ in range(n))
    first = [say(30) for _ in range(4)]
    paras = first + [p[:-3] + "xyz" for p in first] + [p[:70] + say(10) for p in first] + ["short", "short", "***"]
    df = spark.createDataFrame([("d", k, p) for k, p in enumerate(paras)], "doc_id string, para int, text string")
    got = [r.para for r in dedup.deduplicated(df, ["doc_id"]).orderBy("para").collect()]
    assert "\n\n".join(paras[k] for k in got) == post.unrepeated("\n\n".join(paras))


class Page:
    """A stand-in for a page of an open document: (text, size) spans, a table or none, its sheet."""

    def __init__(self, spans=(), table=None, width=612.0, height=792.0):
        self.spans, self.table, self.rect = spans, table, types.SimpleNamespace(width=width, height=height)

    def get_text(self, kind):
        spans = [{"text": t, "size": z} for t, z in self.spans]
        return {"blocks": [{"type": 1}, {"type": 0, "lines": [{"bbox": (72, 40, 300, 50), "spans": spans}]}]}

    def find_tables(self):
        if self.table is None:
            raise ValueError("no tables here")
        return types.SimpleNamespace(tables=[types.SimpleNamespace(bbox=(1, 2, 3, 4), extract=lambda: self.table)])


class Document:
    """A stand-in for an open document: pages made from numbers; ``bad`` ones can't be loaded."""

    def __init__(self, count, make, toc=(), bad=()):
        self.page_count, self.make, self.toc, self.bad = count, make, toc, bad

    def get_toc(self, simple):
        return list(self.toc)

    def load_page(self, k):
        if k in self.bad:
            raise ValueError("code=7: no objects found")
        return self.make(k)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def test_decoded_documents(spark):
    """Spans to lines, contents, tables, and pages with their sizes, also those without text."""
    pages = [Page([("A ", 10), (" ", 30), ("title", 12)], [["a", None]]), Page([(" ", 9)], width=842.0, height=595.0)]
    doc = Document(2, pages.__getitem__, [[1, "A title", 1], [2]])
    rows = spark.createDataFrame(list(decoded.decoded_rows("d", doc)), decoded.DECODED)
    lines, toc, cells, sheets = decoded.frames(rows)
    assert [(r.text, r["size"], r.y1, r.width) for r in lines.collect()] == [("A title", 12.0, 50.0, 612.0)]
    assert toc.count() == 1 and cells.first().cells == [["a", None]]
    assert sorted(map(tuple, sheets.collect())) == [("d", 1, 612.0, 792.0), ("d", 2, 842.0, 595.0)]


def opened(path):
    """Opens a test file: its first line is a number of pages; other content is corrupt."""
    with open(path.removeprefix("file:")) as f:
        count = int(f.readline())
    return Document(count, lambda k: Page([(f"page {k + 1}", 10)] if k % 2 == 0 else ()), [[1, "All", 1]], bad=(4,) if "torn" in path else ())


def test_files_are_read_in_parts(spark, tmp_path):
    for name, text in (("long.pdf", "1000\n" + "x" * 10_000), ("short.PDF", "3"), ("bad.pdf", "no number"), ("torn.pdf", "6"), ("notes.txt", "5")):
        (tmp_path / name).write_text(text)
    rows = decoded.read_documents(spark, str(tmp_path), opened, part_bytes=1500).withColumn("task", F.spark_partition_id()).persist()
    pages = rows.filter("kind = 'page'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_no").alias("m"), F.countDistinct("task").alias("t"))
    got = {r.doc_id: (r.n, r.m) for r in pages.collect()}
    assert got == {"long": (1000, 1000), "short": (3, 3), "torn": (5, 5)}
    assert {r.doc_id: r.t for r in pages.collect()}["long"] > 1
    assert {(r.doc_id, r.n) for r in rows.filter("kind = 'toc'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {("long", 1), ("short", 1), ("torn", 1)}
    wrong = {(r.doc_id, r.page_no, r["class"]) for r in decoded.failures(rows).collect()}
    assert wrong == {("bad", None, "other"), ("torn", 5, "corrupt")}
    lines, toc, cells, sheets = decoded.frames(rows)
    out = convert(lines, toc, cells=cells, pages=sheets).collect()
    assert {(r.doc_id, r.start, r.end) for r in out} == {("long", 1, 1000), ("short", 1, 3), ("torn", 1, 6)}


def test_document_reader_lists_parts(tmp_path):
    with pytest.raises(FileNotFoundError):
        decoded.DocumentReader({"path": "/nowhere/x"}).partitions()
    with pytest.raises(ValueError):
        decoded.DocumentReader({"decoder": "other"})
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.pdf").write_text("4\n" + "x" * 100)
    (tmp_path / "y.pdf").write_text("2")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        reader = decoded.DocumentReader({"path": path, "part_bytes": "40"})
        reader.opener = opened
        parts = reader.partitions()
        assert [(p.value[0].endswith("a/x.pdf"), *p.value[1:]) for p in parts] == [(True, 0, 3), (True, 1, 3), (True, 2, 3), (False, 0, 1)]
    reader = decoded.DocumentReader({"path": str(tmp_path), "part_bytes": "40"})
    reader.opener = opened
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[2] for r in rows if r[:2] == ("x", "page")] == [1, 2, 3, 4] and sum(r[1] == "toc" for r in rows) == 2


SHEET = "doc_id string, page_no int, width double, height double"


def test_pages_of_other_sizes(spark):
    """A lying page between two standing ones: its margins, columns, clip and title are its own."""
    pages = spark.createDataFrame([("m", 1, 842.0, 595.0), ("m", 2, 612.0, 792.0), ("m", 3, 842.0, 595.0), ("s", 1, 300.0, 200.0)], SHEET)
    foot = [line("m", p, 30, y, "Running foot") for p, y in ((1, 560.0), (2, 760.0), (3, 560.0))]
    body = [line("m", 1, 0, 150.0, "A title for the whole"), line("m", 2, 0, 560.0, "Running foot of no margin here."), line("s", 1, 0, 60.0, "Too low for a title")]
    # Columns 200 points apart: enough on a page of 842 points; lines of 500 points are full on neither.
    rows = foot + body + [line("m", 3, k, 100.0 + 30 * k, f"Left {k}.", width=100.0) for k in range(6)]
    rows += [line("m", 3, 10 + k, 100.0 + 30 * k, f"Right {k}.", x=272.0, width=100.0) for k in range(6)]
    rows += [line("m", 3, 20, 90.0, "Wide on a page of 612 points only.", width=480.0)]
    lines = layout.sized(spark.createDataFrame(rows, LINE), pages)
    assert {(r.band, r.norm) for r in sections.noise_profile(lines).collect()} == {("bottom", "running foot")}
    assert sections.denoised(lines, sections.noise_profile(lines)).filter("text like 'Running%'").count() == 1
    assert {(r.doc_id, r.title) for r in outline.document_title(lines).collect()} == {("m", "A title for the whole"), ("s", "s")}
    order = [r.text for r in layout.reading_order(lines.filter("page_no = 3 and line_no < 30")).orderBy("seq").collect()]
    assert order == ["Wide on a page of 612 points only.", *[f"Left {k}." for k in range(6)], *[f"Right {k}." for k in range(6)]]
    narrow = [r.text for r in layout.reading_order(lines.filter("page_no = 3 and line_no < 30").drop("width").withColumn("width", F.lit(1200.0))).orderBy("seq").collect()]
    assert narrow[1:3] == ["Left 0.", "Right 0."]  # too near to be two columns there
    toc = spark.createDataFrame([("m", 0, 1, "All", 1)], TOC_SCHEMA)
    got = convert(spark.createDataFrame(rows, LINE), toc, pages=pages).filter("doc_id = 'm'").first()
    assert got.body.startswith("A title for the whole\n\nRunning foot of no margin here.") and got.body.count("foot") == 1


def test_documents_without_text(spark):
    """Scans have an entry with the text that says so; a section whose pages are blank is empty too."""
    pages = [("scan", p, 595.0, 842.0) for p in (1, 2)] + [("part", p, 595.0, 842.0) for p in (1, 2, 3)]
    rows = [line("part", 1, 0, 60.0, "First words of it.")]
    toc = spark.createDataFrame([("part", 0, 1, "One", 1), ("part", 1, 1, "Two", 3), ("listed", 0, 1, "Alone", 1)], TOC_SCHEMA)
    frame = spark.createDataFrame(pages + [("listed", 1, 595.0, 842.0)], SHEET)
    got = convert(spark.createDataFrame(rows, LINE), toc, pages=frame).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.title, r.source, r.start, r.end, r.is_empty) for r in got] == [
        ("listed", "Alone", "pdf-outline", 1, 1, True), ("part", "One", "pdf-outline", 1, 2, False), ("part", "Two", "pdf-outline", 3, 3, True), ("scan", "Document", "fallback", 1, 2, True),
    ]
    assert [r.body for r in got if r.is_empty] == ["(No extractable text in this range.)"] * 3
    single = convert(spark.createDataFrame(rows, LINE), None, ConvertOptions(mode="single"), pages=frame).collect()
    assert {(r.doc_id, r.title, r.end) for r in single} == {("listed", "Document", 1), ("part", "Document", 3), ("scan", "Document", 2)}
    told = {r.doc_id: r.text for r in markdown_files(convert(spark.createDataFrame([], LINE), pages=frame)).collect()}
    assert set(told) == {"listed", "part", "scan"} and told["scan"].endswith("- Pages: 1-2\n- Source: fallback\n\n(No extractable text in this range.)\n")


def test_binder_ranks_in_ranges(spark):
    docs = spark.createDataFrame([(k * 7 % 101, f"t{k}", "ab"[k % 2]) for k in range(101)], "doc_id bigint, text string, source string")
    one, many = (sorted(map(tuple, adapters.binder(docs, rows_each=n).select("doc_id", "page_no", "text").collect())) for n in (1000, 9))
    assert one == many and len(one) == 101


def test_empty_input(spark):
    none = spark.createDataFrame([], LINE)
    assert convert(none).count() == 0 and files(convert(none)).count() == 0
    blank = spark.createDataFrame([line("b", 1, 0, 40.0, " ")], LINE)
    assert [(r.title, r.body) for r in convert(blank).select("title", F.col("body")).collect()] == [("Document", post.NOTHING)]


def test_kept_keys_against_a_plain_scan():
    """Every key that the scan finds alike is found, with and without junk, at any length and ratio."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz "
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 30, 120, 199, 230, 400]))) for _ in range(60)]

    def edited(s):
        for _ in range(rng.choice([1, 2, 5, 12, 30])):
            at = rng.randrange(len(s) + 1)
            s = rng.choice([s[:at] + s[at + 1 :], s[:at] + rng.choice(letters) + s[at:], s[:at] + rng.choice(letters) + s[at + 1 :]])
        return s

    keys = base + [edited(rng.choice(base)) for _ in range(240)]
    rng.shuffle(keys)
    for autojunk in (True, False):
        for ratio in (0.94, 0.8, 0.99):
            kept, plain = post.Kept(autojunk, ratio), []
            for k in keys:
                want = k in plain or any(post.alike(x, k, autojunk, ratio) for x in plain)
                assert kept.like(k) == want
                if not want:
                    kept.add(k)
                    plain.append(k)


def test_large_bucket_needs_few_matches():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    head = " ".join(words[:10])
    texts = [f"{head} " + " ".join(rng.choice(words) for _ in range(rng.randrange(60, 70))) for _ in range(4000)]
    kept, again = post.Kept(True, 0.94), 0
    for t in texts + [t[:-4] + "zzzz" for t in texts[:400]]:
        if kept.like(t):
            again += 1
        else:
            kept.add(t)
    assert again == 400 and len(kept.keys) == 4000
    assert kept.matched <= 2 * 4400  # of nine million pairs


def test_long_sections_stream_by_page(spark):
    """A document without headings is one section, however long."""
    n = 1500
    rows = spark.range(n).select(F.lit("long").alias("doc_id"), (F.col("id") + 1).cast("int").alias("page_no"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("line_no"))
    y = 100.0 + 30.0 * F.col("line_no")
    lines = rows.select("doc_id", "page_no", F.lit(0).alias("block_no"), "line_no", F.lit(72.0).alias("x0"), y.alias("y0"), F.lit(300.0).alias("x1"), (y + 10.0).alias("y1"), F.lit(10.0).alias("size"), F.concat(F.lit("Page "), F.col("page_no").cast("string"), F.lit(" line "), F.col("line_no").cast("string"), F.lit(" ends.")).alias("text"))
    got = convert(lines).collect()
    assert len(got) == 1 and got[0].end == n
    assert got[0].body == "\n\n".join(f"Page {p} line {k} ends." for p in range(1, n + 1) for k in range(10))


def test_an_application_clears_its_own_tables(spark):
    from pathlib import Path

    df = store.stored(spark.range(3), "mine")
    other = Path(store.shared_dir(spark).removeprefix("file:")) / "quirefold" / "another-application" / "theirs"
    other.mkdir(parents=True, exist_ok=True)
    files_ = df.inputFiles()
    store.clear(spark)
    assert other.exists() and files_ and not any(Path(f.removeprefix("file://")).exists() for f in files_)


def test_a_batch_that_runs_again_is_there_once(spark, tmp_path):
    """Two runs over the same new files, the second without the first's checkpoint, as after a lost commit."""
    spark.createDataFrame(guide(), LINE).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for k in (1, 2):
        convert_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / f"state{k}"), schema).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("doc_id", "pos").distinct().count() > 0 and "batch" in got.columns


def test_small_buckets_are_not_signed(monkeypatch):
    signed = []
    own = post.Kept.signature
    monkeypatch.setattr(post.Kept, "signature", lambda self, k: signed.append(k) or own(self, k))
    text = lambda n: f"one two three four five six seven eight nine ten {chr(97 + n) * 60} end of {n * 7919} words"
    few = "\n\n".join(text(n) for n in range(post.Kept.FEW))
    assert post.unrepeated(few) == few and signed == []
    many = "\n\n".join(text(n) for n in range(20))
    assert post.unrepeated(many + "\n\n" + many) == many and signed


def test_twelve_words_make_a_candidate(spark):
    rows = [(0, "\u3000" + " ".join(["x" * 9] * 12)), (1, " ".join(["x" * 9] * 11) + " \u2003"), (2, "x" * 5000), (3, "\n".join(["x" * 9] * 40)), (4, " ".join("x" * 12))]
    found = dedup.candidates(spark.createDataFrame(rows, "para int, text string")).filter("candidate")
    assert sorted(r.para for r in found.collect()) == [0, 3]


def test_plain_lines_are_left_as_they_are_and_others_cleaned(spark):
    from quirefold.functions.text import clean_line, is_page_number, margin_key

    texts = ["plain é “words”", "two  blanks", " ends ", "tab\there", "nul\x00", "no break", "wide　blank", " ", "ob￼ject", None, "", "\x85", "12 page 3", "1 2 3", "12 34", "Page 7 x", " 3 of 4 "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(*[f(c) for f in (clean_line, margin_key, is_page_number) for c in ("t", F.col("t"))]).collect()
    assert [r[0] for r in got] == [r[1] for r in got] and [r[2] for r in got] == [r[3] for r in got] and [r[4] for r in got] == [r[5] for r in got]
    assert [r[2] for r in got][-5:] == ["page", "2", "34", "x", "of"]


def test_texts_of_lines_are_shuffled_for_pages_and_sections_alone(spark):
    """Bodies aren't joined to their sections again, and only lines of a band meet the noise."""
    from quirefold.operators import sections

    lines = spark.createDataFrame([("d", 1, 0, n, 72.0, 40.0 + 50 * n, 300.0, 50.0 + 50 * n, 10.0, "some text") for n in range(12)], LINE)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    made = plan(convert(lines))
    assert "Join" not in made.split("MapInArrow")[0]
    quiet = plan(sections.denoised(lines, sections.noise_profile(lines)))
    assert quiet.index("Union") < quiet.index("Join LeftAnti")


def test_steps_find_nothing_where_their_tests_fail():
    """Each guarded step against its pattern alone."""
    from quirefold.operators import post

    bodies = ["- a\n* b\n• c", "see 12 of\n3 men; x.4 \n5 | 6", "Extract 3 here\n\n\n\nEXTRACT 4 there", "<sup>3</sup>  | a |\n| b |  c", "a\r\n\n\n b", "\n", "", "as follows:\nA. one\n\nB. two", "٣ of\n٤ x"]
    for b in bodies:
        whole = b
        for pattern, put in ((post.EXTRACT, ""), (post.BULLETED, "- "), (post.INLINE_NUMBER, r" <sup>\1</sup>"), (post.LINE_NUMBER, r"<sup>\1</sup> "), (post.STOP_NUMBER, r"\1<sup>\2</sup>")):
            whole = pattern.sub(put, whole)
        assert post.readability(b) == post.BLANK_LINES.sub("\n\n", whole)
        assert post.no_sup(b) == post.ROW_NUMBER.sub("", b.replace("<sup>", "").replace("</sup>", ""))
        assert post.row_prefixes(b) == post.ROW_PREFIX.sub("", b) and post.detached_text(b) == post.ROW_TAIL.sub(r"\1\n\n\2", b)
        assert post.repeated_headers(b) == "\n".join(b.splitlines())


def test_spans_meet_as_runs_before_the_shuffle(spark):
    """In order, out of order, with gaps and with numbers given twice; a line's spans are one row of the shuffle."""
    words = [f"w{k}" for k in range(60)]
    told = [("d", 1, 0, 0, k, w) for k, w in enumerate(words)]
    told += [("d", 1, 0, 1, k, w) for k, w in reversed(list(enumerate(words)))]
    told += [("d", 1, 0, 2, k, w) for k, w in enumerate(words) if k % 7] + [("d", 1, 0, 2, k, w) for k, w in enumerate(words) if k % 7 == 0]
    told += [("d", 1, 0, 3, 1, "b c"), ("d", 1, 0, 3, 1, "a"), ("d", 1, 0, 3, 0, " "), ("d", 1, 0, 4, 0, "")]
    rows = [(*r[:5], 1.0, 2.0, 3.0, None, None if r[4] % 2 else float(r[4]), r[5]) for r in told]
    spans = spark.createDataFrame(rows, "doc_id string, page_no int, block_no int, line_no int, span_no int, x0 double, y0 double, x1 double, y1 double, size double, text string")
    got = {r.line_no: r for r in layout.lines_of_spans(spans.coalesce(1)).collect()}
    assert set(got) == {0, 1, 2, 3} and got[3].text == "a b c" and got[3].size == 0.0
    for n in range(3):
        assert got[n].text == " ".join(words) and got[n].size == 58.0 and (got[n].x0, got[n].y0, got[n].x1, got[n].y1) == (1.0, 2.0, 3.0, None)
    s = spans.filter("line_no = 0").withColumns({"size": F.coalesce("size", F.lit(0.0))}).coalesce(1)
    runs = s.mapInArrow(layout.span_runs, "doc_id string, page_no int, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double, first int, count int, size double, text string")
    assert [(r["first"], r["count"], r["text"]) for r in runs.collect()] == [(0, 60, "\n".join(words))]


def test_keys_are_made_of_beginnings(monkeypatch):
    """Prose whose first ten words are its own never has its whole key made."""
    made = []
    monkeypatch.setattr(post, "key", lambda s: made.append(len(s)) or plain.key(s))
    body = "\n\n".join(" ".join(f"{w}{k}" for w in ("Lorem", "ipsum", "dolor", "sit") * 30) for k in range(20))
    assert post.unrepeated(body) == body
    assert max(made) <= 160
    twice = f"{body}\n\n{body[:500]}\n\n{body.split(chr(10))[0].upper()}"
    assert post.unrepeated(twice).count("\n\n") < twice.count("\n\n")


def test_shortcuts_of_clean_up(monkeypatch):
    """Keys and tests agree with their plain forms."""
    for s in ("", "a B", "ÀB-c 9", "İx Kb", "x<b C>y<", "\x00￼A b", "ß 12 Ⅷ"):
        low = re.sub("<[^>]+>", " ", s.replace("\x00", "").replace("￼", "").lower())
        assert plain.key(s) == " ".join(re.sub("[^a-z0-9]+", " ", low).split())
        assert plain.has_text(s) == bool(plain.clean(s))
    rng = random.Random(7)
    for _ in range(3000):
        s = "".join(rng.choice("a Z1\n2.,٣é\t)") for _ in range(rng.randint(0, 14)))
        args = f"{s}\n\nB b b.\n\nB b.", rng.choice(("a", "z1", "A z", "2"))
        told = post.cleaned_section(*args)
        with monkeypatch.context() as m:
            m.setattr(post, "KEY_START", re.compile("(?!)"))
            assert told == post.cleaned_section(*args)


def test_margin_keys_tested_first(spark):
    """A column by name is tested before it is cut; its key is that of the expression."""
    odd = [None, "", " 12 Page", "Page 12 of", "page 3 x", "Pa", "p", "a 12", "12 b", "Quarterly Report 7", "Äb <i>c</i> d.", "x", " ab ", "a\x00b", "￼ab", "ab٣", "٣ ab", "(a) b!", "<b>x</b> y", "日本 abc", "a￼b c"]
    d = spark.createDataFrame([(x,) for x in odd], "text string")
    for r in d.select("text", T.margin_key("text").alias("a"), T.margin_key(F.col("text")).alias("b")).collect():
        assert r["a"] == r["b"], r["text"]
