from quirefold.plans import guardrails

OUTLINE = "doc_id string, id string, level int, page_start int, title string"
SEGMENTS = "doc_id string, id string, file string, page_start int, page_end int, char_count bigint"
TEXTS = "doc_id string, path string, text string"


def test_every_rule_finds_its_faults(spark):
    outline = [("d", "h1", 1, 1, "Fine"), ("d", "h2", 0, 1, "x"), ("d", "h3", 1, 0, "x"), ("d", "h4", 1, 1, "  "), ("d", "h5", None, 1, "x"), ("d", "h6", 1, 1, None), ("e", "h1", 3, 9, "Fine")]
    segments = [
        ("d", "s1", "a.md", 1, 2, 5), ("d", "s2", "gone.md", 1, 2, 5), ("d", "s3", "b.md", 3, 2, 5), ("d", "s4", "blank.md", 3, 2, 36), ("d", "s5", "c.md", 1, 1, 0),
        ("d", "s6", "a.md", 1, 1, 5), ("d", "s7", None, 1, 1, 5), ("e", "s1", "a.md", 1, 1, None),
    ]
    texts = [("d", p, "text") for p in ("a.md", "b.md", "c.md")] + [("d", "blank.md", "(No extractable text in this range.)\n"), ("e", "a.md", "text")]
    frames = [spark.createDataFrame(r, s) for r, s in ((outline, OUTLINE), (segments, SEGMENTS), (texts, TEXTS))]
    got = {tuple(r) for r in guardrails.faults(*frames).collect()}
    assert got == {("d", "Q-01", f"h{k}") for k in (2, 3, 4, 5, 6)} | {("d", "Q-02", f"s{k}") for k in (2, 3, 5, 7)} | {("e", "Q-02", "s1")} | {("d", "Q-03", "s1"), ("d", "Q-03", "s6")}
    told = {r.doc_id: tuple(r)[1:] for r in guardrails.report(*frames).collect()}
    assert told == {"d": (6, 7, 5, 4, 2), "e": (1, 1, 0, 1, 0)}
    assert guardrails.report(*[f.limit(0) for f in frames]).count() == 0
