"""Files written and read back: places, tries that fail or run twice, listings, outlines and texts."""

import datetime as dt
import json
import pathlib
import re
import sys
import time
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quirefold import store
from quirefold.operators import readback
from quirefold.plans import catalog, guardrails, sinks
from quirefold.plans.convert import ConvertOptions, convert, files
from quirefold.sources import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])
FILES = "doc_id string, file string, text string"
NAMES = ["a", "b/c", "b-c", "..", ".", "_x", "%", "", None, "A b", "é%2F", "c\\d", "x" * 300, "x" * 299 + "y", "a\nb", "_staging"]


def tree(path):
    return {p.relative_to(path).as_posix(): p.read_text() for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_every_document_has_its_own_folder(spark, tmp_path):
    names = [sinks.folder_name(n) for n in NAMES]
    assert len(set(names)) == len(names) and not any(n in (".", "..") or "/" in n or n[0] in "._" for n in names)
    assert sinks.folder_name("Guide 1.2-b") == "Guide 1.2-b"
    (tmp_path / "Sections").mkdir()
    (tmp_path / "Sections/keep.md").write_text("mine")
    rows = [(n, "Sections/1.md", f"text of {n!r}") for n in NAMES]
    root = tmp_path / "out"
    done = sinks.write_files(spark.createDataFrame(rows, FILES).repartition(4), str(root))
    assert done.count() == len(NAMES)
    assert sorted(tree(root).values()) == sorted(t for *_, t in rows) and (tmp_path / "Sections/keep.md").read_text() == "mine"
    back = {r.doc_id for r in written.listed(spark, str(root)).select("doc_id").collect()}
    assert {n for n in NAMES if n is None or len(n) < 200} <= back
    for bad in ("../x.md", "/x.md", "a//b.md", "a/./b", "a\\..\\b", ""):
        with pytest.raises(Exception, match="not a place"):
            sinks.write_files(spark.createDataFrame([("a", bad, "x")], FILES), str(root))
    time.sleep(2)  # other tasks of failed jobs may still have been writing
    sinks.clear_staging(str(root))
    assert not (root / "_staging").exists() and len(tree(root)) == len(NAMES)


def test_tasks_that_run_twice_leave_one_set(spark, tmp_path):
    rows = [(f"d{k % 5}", f"Sections/{k}.md", f"text {k}") for k in range(40)]
    df = spark.createDataFrame(rows, FILES).repartition(4)
    job = uuid.uuid4().hex
    first = sinks.staged(df, str(tmp_path), job).collect()
    second = sinks.stored(sinks.staged(df, str(tmp_path), job), "staged")  # another try: the first's files stay behind
    assert len(tree(tmp_path)) == 80 and {r.staged for r in first}.isdisjoint(r.staged for r in second.collect())
    sinks.published(second.filter("doc_id < 'd3'"), str(tmp_path), "sections").collect()  # a try that was cut off
    for _ in range(2):
        sinks.published(second, str(tmp_path), "sections").collect()
    want = {f"{d}/{f}": t for d, f, t in rows}
    assert {p: t for p, t in tree(tmp_path).items() if not p.startswith("_staging")} == want
    sinks.write_files(df.filter("doc_id = 'd1'").limit(2), str(tmp_path))
    now = tree(tmp_path)
    assert sum(p.startswith("d1/") for p in now) == 2 and sum(p.startswith("d2/") for p in now) == 8


def test_a_failure_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("d", "Sections/1.md", "old")], FILES)
    sinks.write_files(df, str(tmp_path))
    bad = spark.createDataFrame([("d", "Sections/1.md", "new"), ("d", "../2.md", "x")], FILES)
    with pytest.raises(Exception, match="not a place"):
        sinks.write_files(bad, str(tmp_path))
    assert tree(tmp_path) == {"d/Sections/1.md": "old"}
    twice = spark.createDataFrame([("d", "Sections/1.md", "one"), ("d", "Sections/1.md", "one")], FILES).repartition(2)
    assert sinks.write_files(twice, str(tmp_path)).count() == 1 and tree(tmp_path) == {"d/Sections/1.md": "one"}


LINE = "doc_id string, page_no int, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double, size double, text string"


def two_guides(spark):
    rows = []
    for doc in ("guide one", "a/b"):
        for k, (y, size, text) in enumerate([(100.0, 18.0, "First part"), (130.0, 10.0, "Words of it."), (300.0, 18.0, "Second part"), (330.0, 10.0, "More of them.")] + [(400.0 + 20 * k, 10.0, f"Line {k}.") for k in range(8)]):
            rows.append((doc, 1, 0, k, 72.0, y, 300.0, y + 10.0, size, text))
    return spark.createDataFrame(rows, LINE)


@pytest.mark.parametrize("mode", ["sections", "single", "major"])
def test_outlines_come_back(spark, tmp_path, mode):
    options = ConvertOptions(mode=mode)
    made = files(convert(two_guides(spark), options=options), options).persist()
    root = f"file://{tmp_path}/out"
    sinks.write_files(made, root, mode)
    want = {}
    for r in made.filter("file = 'outline.json'").collect():
        for pos, e in enumerate(json.loads(r.text)):
            want[r.doc_id, pos] = e
    got = {(r.doc_id, r.pos): {k: v for k, v in r.asDict().items() if k not in ("doc_id", "pos")} for r in written.outlines(spark, root).collect()}
    assert got == want and any(e["section_file"] for e in want.values())
    texts = {(r.doc_id, r.path): r.text for r in written.section_texts(spark, root).collect()}
    assert texts == {(r.doc_id, r.file): r.text for r in made.filter("file like '%.md' and file <> 'outline.md'").collect()}
    told = {r.doc_id: (r.outline_markdown, r.n_entries, r.message) for r in written.payloads(spark, root).collect()}
    assert told == {r.doc_id: (r.text, sum(d == r.doc_id for d, _ in want), None) for r in made.filter("file = 'outline.md'").collect()}


def test_deleted_files_and_damaged_outlines(spark, tmp_path):
    made = files(convert(two_guides(spark)))
    sinks.write_files(made, str(tmp_path))
    gone = sorted((tmp_path / "a%2Fb/Sections").glob("*.md"))[1]
    gone.unlink()
    got = {(r.doc_id, r.pos): r.section_file for r in written.outlines(spark, str(tmp_path)).collect()}
    assert [k for k, v in got.items() if v is None] == [("a/b", 1)]
    for name, text in (("cut", "[{"), ("other", '{"level": 1}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "outline.json").write_text(text)
    (tmp_path / "none").mkdir()
    (tmp_path / "none/x.md").write_text("x")
    (tmp_path / "a%2Fb/outline.md").unlink()
    told = {r.doc_id: r for r in written.payloads(spark, str(tmp_path)).collect()}
    assert told["none"].message == "outline.json not found. Run conversion first." and told["other"].message == "outline.json holds no list."
    assert told["a/b"].outline_markdown == "" and told["a/b"].n_entries == 3 and told["other"].n_entries == 0
    assert written.outlines(spark, str(tmp_path)).filter("doc_id = 'other'").count() == 0


def test_parts_are_one_text(spark, tmp_path):
    head = "# A\n\n- Level: 1\n- Pages: 1-2\n- Source: s\n\n"
    (tmp_path / "d/Sections").mkdir(parents=True)
    for n, text in ((2, "two"), (10, "ten"), (1, "one")):
        (tmp_path / f"d/Sections/a-part-{n}.md").write_text(head + text)
    (tmp_path / "d/Sections/b.md").write_text(head + "b")
    got = {r.path: r.text for r in written.section_texts(spark, str(tmp_path)).collect()}
    assert got == {"Sections/a.md": head + "one\n\ntwo\n\nten", "Sections/b.md": head + "b"}
    assert written.section_texts(spark, str(tmp_path), plain=True).filter("path = 'Sections/b.md'").first().text == "b"


def test_snapshots(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [("d", p, at(s)) for p, s in (("Sections/a.md", 5), ("By Major Heading/b.MD", 9), ("outline.md", 50), ("outline.json", 3), ("Sections/deep/c.md", 40), ("whole.md", 1))]
    rows += [("e", "outline.md", at(1)), ("f", "x.md", at(59))]
    df = spark.createDataFrame(rows, "doc_id string, path string, modified timestamp")
    got = {r.doc_id: tuple(r)[1:] for r in readback.snapshot(df, F.lit(at(21))).collect()}
    assert got == {"d": (3, "By Major Heading/b.MD", 12, True), "e": (0, "none", -1, False), "f": (1, "x.md", 0, False)}
    sinks.write_files(spark.createDataFrame([("d", "Sections/a.md", "x")], FILES), str(tmp_path))
    real = readback.snapshot(written.listed(spark, str(tmp_path))).first()
    assert (real.n, real.newest, real.outline_ready) == (1, "Sections/a.md", False) and 0 <= real.age < 600


def test_listings_and_texts_stay_with_the_tasks(spark, tmp_path):
    rows = [(f"d{k}", f"Sections/{n}.md", "x") for k in range(3) for n in range(5)] + [("d0", "outline.json", "[]"), ("d0", "Sections/outline.json", "[]")]
    sinks.write_files(spark.createDataFrame(rows, FILES), str(tmp_path))
    (tmp_path / "d1/.hidden.md").write_text("no")
    (tmp_path / "_other/Sections").mkdir(parents=True)
    (tmp_path / "_other/Sections/a.md").write_text("no")
    (tmp_path / "top.md").write_text("no")
    listing = written.listed(spark, str(tmp_path))
    assert listing.inputFiles() == []  # the driver holds no file of the folder
    assert {(r.doc_id, r.path) for r in listing.collect()} == {(d, f) for d, f, _ in rows}
    texts = written.section_texts(spark, str(tmp_path))
    assert texts.inputFiles() == [] and texts.count() == 15
    assert [tuple(r) for r in written.texts_of(spark, str(tmp_path), name="outline.json").collect()] == [("d0", "outline.json", "[]")]


def test_moves_are_dealt_out(spark, tmp_path):
    """Files are moved by as many tasks as the session deals to, however short their rows are."""
    d = spark.createDataFrame([(f"d{k}", "a.md", "x") for k in range(40)], "doc_id string, file string, text string")
    staged = sinks.staged(d, str(tmp_path), "j").cache()
    assert sinks.published(staged, str(tmp_path), "single").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def plans(df, capsys):
    """A table's plans before and after its run."""
    df.explain()
    df.collect()
    df.explain()
    return capsys.readouterr().out


def test_listings_are_not_sent_whole(spark, tmp_path, capsys):
    """Plans don't know the size of listings and texts: no join may take them for small, before or at the run."""
    sinks.write_files(files(convert(two_guides(spark))), str(tmp_path))
    for df in (written.outlines(spark, str(tmp_path)), written.payloads(spark, str(tmp_path))):
        told = plans(df, capsys)
        assert "isFinalPlan=true" in told and "SortMergeJoin" in told and "BroadcastExchange" not in told


def test_rules_send_no_texts_whole(spark, tmp_path, capsys):
    sinks.write_files(files(convert(two_guides(spark))), str(tmp_path))
    root = str(tmp_path)
    rules = guardrails.report(written.outlines(spark, root), written.segments(spark, root), written.section_texts(spark, root, plain=True))
    told = plans(rules, capsys)
    assert "isFinalPlan=true" in told and "SortMergeJoin" in told and "BroadcastExchange" not in told
    assert {tuple(r)[1:] for r in rules.collect()} == {(3, 3, 0, 0, 0)}


def shuffles(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return set(re.findall(r"shuffle_(\d+)_", blocks))


def test_stored_tables_leave_no_shuffle_files(spark):
    before = shuffles(spark)
    kept = store.stored(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    left = None
    for _ in range(40):  # they go in the background
        if not (left := shuffles(spark) - before):
            break
        time.sleep(0.25)
    assert not left and kept.count() == 7 and spark.conf.get(store.TIDY, None) is None


def test_passing_tables_go(spark):
    home = pathlib.Path(store.own_dir(spark).removeprefix("file:"))
    names = lambda: {p.name.rpartition("-")[0] for p in home.iterdir()} if home.exists() else set()
    with store.passing(spark) as outer:
        one = store.stored(spark.range(3), "t-outer")
        with store.passing(spark) as inner:
            two = inner(store.stored(spark.range(3), "t-inner").unionByName(one), "t-lasting")
            three = outer(spark.range(5), "t-lasts")
        assert {"t-outer", "t-lasting", "t-lasts"} <= names() and "t-inner" not in names() and two.count() == 6
    assert "t-lasts" in names() and not {"t-outer", "t-lasting", "t-inner"} & names() and three.count() == 5
    with pytest.raises(ZeroDivisionError), store.passing(spark):
        store.stored(spark.range(3), "t-failed")
        1 / 0  # noqa: B018
    assert "t-failed" not in names()


def test_conversions_leave_their_files_alone(spark, monkeypatch):
    """Of a conversion whose files are written and read back nothing but the files stays."""
    home = pathlib.Path(store.own_dir(spark).removeprefix("file:"))
    names = lambda: {p.name for p in home.iterdir()} if home.exists() else set()
    monkeypatch.setattr(catalog, "lines_of", lambda spark, sf_dir: two_guides(spark))
    before = names()
    found = catalog.q_segment_payload(spark, "")
    assert [n.partition("-")[0] for n in names() - before] == ["files"]
    assert {(r.doc_id, r.n) for r in found.collect()} == {(d, n) for d in ("guide one", "a/b") for n in (1, 2, 3)}
    assert {tuple(r)[1:] for r in catalog.q_integrity(spark, "").collect()} == {(3, 3, 0, 0, 0)}


def test_texts_are_written_without_a_shuffle(spark, monkeypatch):
    """Leaving out files of some entries takes no join of texts."""
    monkeypatch.setattr(catalog, "lines_of", lambda spark, sf_dir: two_guides(spark))
    given = []
    monkeypatch.setattr(catalog, "write_files", lambda files, root: given.append(files))
    catalog.written_out(spark, "")
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and {"outline.json", "segments.json", "outline.md"} <= {w for w in re.findall(r"[a-z]+\.[a-z]+", plan)}
