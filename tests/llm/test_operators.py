"""Methods against plain versions, and awkward tables: empty, clashing names, many labels, long texts."""

import collections
import hashlib
import itertools
import random
import string

import numpy as np
import pytest

import corpus_pipeline
from quirefold.llm import chat, decontam, hashing, langid, lm, mixing, neardup, quality, secrets, substring, toxicity

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# Hashes


def test_words_hash_alike_in_any_pieces(monkeypatch):
    texts = [b"a bb ccc", b"", b" x " + b"y" * 700 + b"\tz ", b"q w e " * 300]
    one = hashing.Words(texts)
    monkeypatch.setattr(hashing, "CHUNK", 64)
    two = hashing.Words(texts)
    assert one.counts.tolist() == [3, 0, 3, 900] and (one.hashes == two.hashes).all() and (one.last_bytes == two.last_bytes).all()
    x = np.random.default_rng(0).integers(0, 1 << 63, 60, dtype=np.uint64)
    for k in (1, 3, 5, 20, 50, 60, 61):
        want = [sum(int(v) * pow(77, j, 1 << 64) for j, v in enumerate(x[i : i + k])) % (1 << 64) for i in range(max(61 - k, 0))]
        assert hashing.runs(x, k, 77).tolist() == want


# Quality


def mcd(x, share, floors):
    """Plain concentration steps from medians, means and all sixths of the rows, then the reweighting."""
    f = np.diag(np.square(floors))
    moments = lambda r: (r.mean(axis=0), np.cov(r.T, bias=True) + f)
    far = lambda m, c, r: np.einsum("ij,jk,ik->i", r - m, np.linalg.inv(c), r - m)
    scale = lambda d: max(np.median(d) / quality.CHI2_MEDIAN, 1)
    best = None
    for m, c in [(np.median(x, axis=0), moments(x)[1]), moments(x), *[moments(x[k::6]) for k in range(6)]]:
        for _ in range(20):
            m, c = moments(x[np.argsort(far(m, c, x), kind="stable")[: int(np.ceil(share * len(x)))]])
        if best is None or np.linalg.det(c) < np.linalg.det(best[1]) - 1e-15:
            best = m, c
    d = far(*best, x)
    m, c = moments(x[d <= quality.CHI2_NEAR * scale(d)])
    return lambda r: far(m, c, r) / scale(far(m, c, x))


def prose(rng, n, lines=8):
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    cut = max(n // lines, 1)
    return "\n".join(" ".join(words[k : k + cut]) for k in range(0, n, cut))


def test_each_statistic_alone_rejects_and_clean_stay(spark):
    rng = random.Random(4)
    good = [prose(rng, int(rng.lognormvariate(5.5, 0.5)) + 50) for _ in range(300)]
    line = prose(rng, 40, 1)
    odd = [
        " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(60_000)),  # length
        " ".join("".join(rng.choice("abcdefg") for _ in range(30)) for _ in range(200)),  # word length
        " ".join(w + "#$" * 2 for w in prose(rng, 200).split()),  # symbols
        "\n".join(["x"] * 400 + [prose(rng, 9, 1) for _ in range(300)]),  # lines of one word: no window repeats within the base rule
        prose(rng, 200, 1) + " " + " ".join([line] * 4),  # repeats, under the base rule's half
    ]
    odd[3] = "\n".join(itertools.chain.from_iterable((prose(rng, 9, 1), "x") for _ in range(100)))
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(good + odd)]
    found = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, DOC)).collect()}
    assert [k for k in range(300) if not found[k].kept] == []
    assert not any(found[300 + k].base_failed or found[300 + k].kept for k in (0, 1, 2))
    assert not found[303].kept and not found[304].kept


def test_estimate_against_plain_steps(spark):
    rng = random.Random(6)
    texts = [prose(rng, int(rng.lognormvariate(5.2, 0.6)) + 50) for _ in range(150)]
    texts += [" ".join(w + "##" for w in prose(rng, 120).split()) for _ in range(12)]
    d = spark.createDataFrame([(k, t, "en", None, 0) for k, t in enumerate(texts)], DOC)
    v = quality.vector(quality.measured(d)).orderBy("doc_id").collect()
    x = np.array([[r[c] for c in quality.STATS] for r in v], float) / quality.SCALE
    want = mcd(x, 0.75, (0.2, 0.06, 0.03, 0.12, 0.12))(x)
    got = np.array([r.distance2 for r in quality.quality(d).orderBy("doc_id").collect()])
    assert (got[150:] > quality.CHI2_FAR).all() and (got[:150] < quality.CHI2_FAR).all()
    assert np.abs(np.log(got / want)).max() < 0.5  # ranks in bins of a sixteenth of a doubling
    assert np.corrcoef(got, want)[0, 1] > 0.99


def test_small_pools_are_judged_by_wider_ones(spark):
    rng = random.Random(7)
    rows = [(k, prose(rng, 120), "en", f"s{k % 40}", 0) for k in range(160)]
    rows.append((999, " ".join(w + "####" for w in prose(rng, 120).split()), "xx", "alone", 0))
    found = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, DOC)).collect()}
    assert not found[999].kept and found[999].distance2 > 100 and all(found[k].kept for k in range(160))


# Mixing


def test_mix_meets_targets_and_writes_shards(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, prose(rng, rng.randint(1, 150)), "en", None if k % 7 == 0 else f"s{k % 3}", k) for k in range(600)]
    docs = spark.createDataFrame(rows, DOC)
    mixed = mixing.mix(docs, block_docs=8, shards=4, with_text=True).persist()
    own = mixed.collect()
    total = collections.Counter()
    for r in own:
        total[r.source] += r["size"]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([total[s] for s in names], [1 + k % 3 for k in range(len(names))]), strict=True))
    for s in names:
        assert abs(sum(r.taken for r in own if r.source == s) - want[s]) <= 100
        assert all(abs(r.target - want[s]) < 1e-6 for r in own if r.source == s)
    mixing.write_shards(mixed, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    times = {r.doc_id: r.times for r in own}
    assert collections.Counter(r.doc_id for r in back) == {k: n for k, n in times.items() if n}
    assert {r.doc_id: r.text for r in back}.items() <= {r[0]: r[1] for r in rows}.items()
    place = [r.doc_id for r in sorted(back, key=lambda r: (r.shard, r.place)) if r.shard == 0]
    assert place != sorted(place) and len({r.shard for r in back}) == 4
    assert sorted(map(str, mixing.digest(mixing.mix(docs, block_docs=8, shards=4)).collect())) == sorted(map(str, mixing.digest(mixed).collect()))


def test_mix_plans_little_on_the_driver(spark):
    docs = spark.createDataFrame([(k, "a b c", "en", f"s{k % 3}", 5) for k in range(60)], DOC)
    sc = spark.sparkContext
    sc.setJobGroup("mix", "rows of sources take no jobs")
    try:
        assert mixing.mix(docs, with_text=True).count() == 60
        assert len(sc.statusTracker().getJobIdsForGroup("mix")) <= 26
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


# Secrets


def test_planted_random_strings(spark):
    """Recall and precision of the models on what the base patterns miss."""
    rng = random.Random(9)
    alphabet = string.ascii_letters + string.digits
    planted = ["".join(rng.choice(alphabet) for _ in range(rng.choice((24, 32, 40)))) for _ in range(150)]
    parts = secrets.PARTS
    plain = [rng.choice("_-/").join(rng.choice(parts) for _ in range(rng.randint(2, 6))) + rng.choice(["", "2", "2024"]) for _ in range(150)]
    plain += ["".join(rng.choice(parts).capitalize() for _ in range(4)) for _ in range(50)]
    rows = [(k, f"the {x} is here") for k, x in enumerate(planted + plain)]
    d = secrets.scanned(spark.createDataFrame(rows, "doc_id bigint, text string"), secrets.trained(secrets.labelled_samples(spark)))
    hit = {r.doc_id for r in d.filter("size(spans) > 0").collect()}
    recall = sum(k in hit for k in range(150)) / 150
    false = sum(k >= 150 for k in hit)
    assert recall >= 0.98 and false <= 2, (recall, false)


def test_clashing_names(spark):
    rows = [(1, "token = abcdefgh1", "b", "s", "m", 5)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, base string, spans string, _a string, _left int")
    got = secrets.scanned(d, secrets.trained(secrets.labelled_samples(spark))).first()
    assert got._a == "m" and got._left == 5 and len(got.base) == 1
    clean = corpus_pipeline.secrets_stage(spark, d, "")
    assert clean.columns == d.columns and tuple(clean.first()) == (1, "[secret]", "b", "s", "m", 5)


# Language


def test_language_without_labels_and_with_one(spark):
    rows = [(k, "some words here", None, "s", 0) for k in range(8)]
    got = langid.language(spark.createDataFrame(rows, DOC)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    rows = [(k, "some words here", "en", "s", 0) for k in range(8)]
    assert {r.lang_pred for r in langid.language(spark.createDataFrame(rows, DOC)).collect()} == {"en"}


def test_140_languages():
    rng = random.Random(10)
    letters = [chr(0x4E00 + k * 5) for k in range(140)]  # a letter of its own for each
    model = langid.learned([("".join(letters[k]) * 3 + " " + letters[k] * 2, f"l{k:03}") for k in range(140)])
    found = [f[0] for f in langid.label_texts([f"{letters[k] * 2} {letters[k] * 3}" for k in range(140)], model, 6.0)]
    assert found == [f"l{k:03}" for k in range(140)]
    scores = np.zeros((3, 140), np.float32)
    scores[:, 139] = 1
    assert langid.viterbi(scores, np.array([3]), 1.0).tolist() == [139] * 3
    assert rng


def test_long_texts_in_pieces(monkeypatch):
    model = langid.learned([("the cat sat on the mat", "en"), ("der hund ist nicht da", "de")])
    text = "the cat sat " * 40 + "der hund ist " * 60
    want = list(langid.label_texts([text, "der hund"], model, 6.0))
    monkeypatch.setattr(langid, "PART", 50)
    assert list(langid.label_texts([text, "der hund"], model, 6.0)) == want and want[0][0] == "de"


# Toxicity


def toxic_sample(n=400, seed=3):
    rng = random.Random(seed)
    say = lambda bad: " ".join([rng.choice("alpha beta gamma delta omega sigma kappa lambda".split()) + rng.choice("abcdef") for _ in range(30)] + ["vilehorror"] * bad)
    y = [int(k % 4 == 0) for k in range(n)]
    return [say(b) for b in y], y


def test_index_equals_a_full_scan():
    texts, y = toxic_sample(1200)
    index = toxicity.fitted(list(range(len(y))), texts, y, per_label=300)
    assert len(index.blocks) > 3 and len(index.ids) == 600 - 75  # three quarters of the toxic ones at most
    rows = {i: k for k, i in enumerate(index.ids.tolist())}
    vector = [index.vector(*f) for f in toxicity.text_features([texts[i] for i in index.ids])]
    for g, c in toxicity.text_features([texts[5], texts[8], "omegaa vilehorrors never seen", "zzz"]):
        f, w = index.vector(g, c)
        full = np.array([sum(float(a) * dict(zip(of.tolist(), ow.tolist(), strict=True)).get(n, 0.0) for n, a in zip(f.tolist(), w, strict=True)) for of, ow in vector])
        best = index.nearest(f, w, 15)
        want = np.sort(full[full > 0])[::-1][:15]
        assert np.allclose([x for x, _ in best], want, atol=1e-5) and len(rows) == len(full)
        assert all(abs(full[k] - x) < 1e-5 for x, k in best)


def test_toxic_query(spark):
    texts, y = toxic_sample()
    texts += [None, "", "ALPHAA VILEHORROR", "x " * 200_000 + "vilehorror"]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOC)
    labels = spark.createDataFrame([(k, v) for k, v in enumerate(y)] + [(7, None), (None, 1), (5, 2), (6, -1)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[k].predicted == v for k, v in enumerate(y)) and got[402].predicted == 1
    assert got[400].score == got[401].score and 0.1 < got[400].score < 0.4 and got[8].evidence
    none = toxicity.toxicity(docs, labels.filter("false")).collect()
    assert {r.score for r in none} == {0.0}


def test_calibration_rises_and_pools():
    v, p = toxicity.rising(np.array([0.1, 0.2, 0.2, 0.5, 0.9]), np.array([0, 1, 0, 0, 1.0]), np.ones(5))
    assert (np.diff(p) > 0).all() and abs(p[1] - 1 / 3) < 1e-9 and p[-1] == 1
    pieces = list(toxicity.cut(b"ab cd" * 10))
    assert b"".join(pieces) == b"ab cd" * 10


def test_long_toxic_text_in_pieces(monkeypatch):
    text = "alpha beta gamma " * 50
    (want,) = toxicity.text_features([text])
    monkeypatch.setattr(toxicity, "PART", 64)
    (got,) = toxicity.text_features([text])
    assert [x.tolist() for x in got] == [x.tolist() for x in want]


# Chat


def test_templates_render_whole_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (2, 0, "assistant", "b")]
    c = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turn = chat.TEMPLATE
    around = "{% set who = 'x' %}<s>" + turn + "end{{ who }}"
    plain, framed = ({r.conv_id: r for r in chat.formatted(c, t).collect()} for t in (turn, around))
    assert chat.streams(turn) and chat.streams(around)
    for k in (1, 2):
        assert framed[k].formatted_chars == plain[k].formatted_chars + len("<s>endx") and framed[k].turns_sha256 == plain[k].turns_sha256
    twice = turn + "{% for m in messages %}.{% endfor %}"
    assert not chat.streams(twice)
    assert {r.conv_id: r.formatted_chars for r in chat.formatted(c, twice).collect()} == {1: plain[1].formatted_chars + 3, 2: plain[2].formatted_chars + 1}


# Near copies


def test_groups_with_large_sets_are_cut(spark, monkeypatch):
    rng = random.Random(12)
    base = [rng.choice(string.ascii_letters) + str(rng.randint(0, 999)) for _ in range(80)]
    texts = [" ".join([*base[:k], "new", *base[k:]]) for k in range(40)] + [prose(rng, 60) for _ in range(5)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole = sorted(map(tuple, neardup.near_duplicates(d).collect()))
    monkeypatch.setattr(neardup, "SET", 1)  # every group counts as large
    assert sorted(map(tuple, neardup.near_duplicates(d, most=64).collect())) == whole
    assert sum(r[3] for r in whole) == 6


# All of them


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], DOC)
    items = spark.createDataFrame([(1, "x y")], "item_id bigint, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    for got in (
        decontam.decontaminate(none, items), quality.quality(none), mixing.mix(none), lm.score(none), langid.language(none), substring.dedup(none),
        neardup.near_duplicates(none), toxicity.toxicity(none, labels),
        chat.formatted(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")),
    ):
        assert got.count() == 0


@pytest.mark.parametrize("name", ["lm", "substring", "quality", "neardup"])
def test_a_very_long_text(spark, name):
    rng = random.Random(13)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    long = " ".join(rng.choice(vocab) for _ in range(300_000))
    rows = [(0, long, "en", "s", 0), (1, long, "en", "s", 0), (2, "a b c", "en", "s", 0), (3, None, None, None, None)]
    d = spark.createDataFrame(rows, DOC)
    run = {"lm": lambda: lm.score(d, most=2), "substring": lambda: substring.dedup(d), "quality": lambda: quality.quality(d), "neardup": lambda: neardup.near_duplicates(d)}[name]
    got = {r.doc_id: r for r in run().collect()}
    n = len(long.split())
    if name == "lm":
        assert got[0].n_tokens == n + 1 and got[3].n_tokens == 1 and got[0].score == pytest.approx(got[1].score)
    elif name == "substring":
        assert got[1].n_removed == n and got[0].n_removed == 0 and got[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    elif name == "quality":
        assert got[0].n_words == n and got[3].n_words == 0
    else:
        assert got[1].component_id == 0 and got[2].component_id == 2
