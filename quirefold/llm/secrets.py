"""Secret scans: three base patterns, and character Markov models for other random strings.

Only DataFrame functions are used, with no shuffle on the documents. Two first-order Markov models
of characters, one of random strings and one of ordinary identifiers, are counted from a bounded
table of labelled samples; their log-likelihood ratio decides on runs of ``[A-Za-z0-9+/_=-]`` in what
the base matches leave. A long run, or a long part of one between ``/_=-``, that mixes letters and
digits is found by its ratio per step. In any other run so is each stretch whose summed ratio, less
the threshold per step, reaches ``STRETCH``, whatever ordinary words it is joined to; it is taken with
the rest of the parts it ends in, which must mix letters and digits too. The model is one array of len(ALPHABET)^2 ratios, a fixed size, and
goes into the plan as a literal.

Spans are code points, end exclusive. Those of the models don't overlap base spans or one another.

Edge cases: null text counts as empty and has no spans; repeated rows are scanned one by one;
very long texts are scanned whole; extra columns pass through ``scanned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET)
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"  # 16+ in all: a run that is too short has no later, longer match in it
HEX = "[0-9a-f]{32,}"  # likewise: the leftmost match starts where the maximal run starts
CANDIDATE = "[A-Za-z0-9+/_=-]{12,}"
PART = "[A-Za-z0-9+]{20,}"
LONG = 20  # characters of a run that its ratio per step decides on
#: Sum that a stretch must reach; up to 12 ordinary words in a run reach 10.4 in 3000 trials.
STRETCH = 11.0
KINDS = ("assign", "access", "hex", "markov")
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Labelled identifiers are joined from these ordinary words (fixed values).
PARTS = (
    "access account action array base batch block buffer build byte cache call chain channel class client code "
    "column command config connect content control count create current data debug default delete device domain "
    "driver element engine entry error event field file filter format frame function global group handle header "
    "index input item kernel label layer length level line list load local lock logger main manager map match "
    "memory message method model module name network node number object offset option order output package page "
    "parent parse path pattern point process property query queue random range read record request reset result "
    "return root route row scale schema scope script search section select server service session shape signal "
    "size socket source stack start state status stream string system table target task test text thread time "
    "total transaction type update user value vector version view volume width window worker write"
).split()


def labelled_samples(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """(text, random): ``rows`` random strings (hex, base 64, capitals) and as many identifiers."""
    ids = spark.range(rows)
    raw = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")).cast("binary"), 256)
    base64 = F.base64(F.unhex(raw))
    random = ids.select(
        F.when(F.col("id") % 3 == 0, raw).when(F.col("id") % 3 == 1, base64).otherwise(F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", ""))).alias("text"),
        F.lit(1).alias("random"),
    )
    words = F.array(*[F.lit(x) for x in PARTS])
    pick = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))).cast("int"))
    digits = F.when(F.col("id") % 4 == 0, (F.col("id") % 100).cast("string")).otherwise("")
    plain = ids.select(
        F.when(F.col("id") % 3 == 0, F.concat(pick(1), F.lit("_"), pick(2), F.lit("_"), pick(3), digits))
        .when(F.col("id") % 3 == 1, F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3)), digits))
        .otherwise(F.concat(pick(1), F.lit("-"), pick(2), F.lit("/"), pick(3), F.lit("-"), digits))
        .alias("text"),
        F.lit(0).alias("random"),
    )
    return random.unionByName(plain)


def codes(text: Column) -> Column:
    """Array of places in ALPHABET, from 1, of a text's characters."""
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def trained(samples: DataFrame) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for all a, b, row by row; add-one smoothing."""
    c = samples.withColumn("c", codes(F.col("text")))
    steps = c.select("random", F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c") - 1).alias("b"))).alias("s"))
    seen = steps.select("random", "s.a", "s.b").filter("a > 0 and b > 0").groupBy("random", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    cells = samples.sparkSession.range(SIZE * SIZE).select(
        (F.floor(F.col("id") / SIZE) + 1).cast("int").alias("a"), (F.col("id") % SIZE + 1).cast("int").alias("b")
    )
    for kind in (0, 1):
        own = seen.filter(F.col("random") == kind).select("a", "b", F.col("n").alias("k"))
        row = Window.partitionBy("a")
        cells = cells.join(own, ["a", "b"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
        cells = cells.withColumn(f"p{kind}", F.log((F.col("k") + 1) / (F.sum("k").over(row) + SIZE))).drop("k")
    return [r[0] for r in cells.orderBy("a", "b").select(F.round(F.col("p1") - F.col("p0"), 6)).collect()]


def ratio(text: Column, model: Column) -> Column:
    """Mean log-likelihood ratio per step of a run of ALPHABET."""
    total = F.aggregate(
        codes(text),
        F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(
            c.alias("last"),
            (acc["sum"] + F.when((acc["last"] > 0) & (c > 0), F.get(model, (acc["last"] - 1) * SIZE + c - 1)).otherwise(0.0)).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return total / F.greatest(F.length(text) - 1, F.lit(1))


def located(text: Column, pattern: str, rank: int, needed: Column) -> Column:
    """Spans of a pattern's matches, as SPAN, in order; nothing is searched unless ``needed``.

    Matches and the pieces between them alternate, so each start is the length of all before it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    spans = F.aggregate(
        F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(F.length(b).alias("b"), F.length(m).alias("m"))),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["b"] + x["m"]).alias("at"),
            F.concat(
                acc["out"],
                F.array(F.struct((acc["at"] + x["b"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + x["b"] + x["m"]).alias("end"), F.lit(KINDS[rank]).alias("kind"))),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(needed & text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def cut(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def stretches(run: Column, span: Column, model: Column, threshold: float) -> Column:
    """Spans of the stretches of a run whose sum of (ratio - threshold) reaches STRETCH.

    A stretch ends when its sum is used up, or falls by STRETCH from its highest.
    """
    ends = lambda acc: F.when(acc["top"] >= STRETCH, F.concat(acc["out"], F.array(F.struct(acc["first"].alias("a"), acc["end"].alias("b"))))).otherwise(acc["out"])

    def step(acc: Column, c: Column) -> Column:
        gain = F.when((acc["last"] > 0) & (c > 0), F.get(model, (acc["last"] - 1) * SIZE + c - 1) - threshold).otherwise(0.0)
        now = acc["sum"] + gain
        over = (now <= 0) | (now < acc["top"] - STRETCH)
        better = ~over & (now > acc["top"])
        return F.struct(
            c.alias("last"),
            (acc["at"] + 1).alias("at"),
            F.when(over, 0.0).otherwise(now).alias("sum"),
            F.when(over, acc["at"]).otherwise(acc["first"]).alias("first"),
            F.when(over, 0.0).when(better, now).otherwise(acc["top"]).alias("top"),
            F.when(better, acc["at"] + 1).otherwise(acc["end"]).alias("end"),
            F.when(over, ends(acc)).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(
        F.lit(0).alias("last"), F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).alias("first"), F.lit(0.0).alias("top"),
        F.lit(0).alias("end"), F.array().cast("array<struct<a:int,b:int>>").alias("out"),
    )
    found = F.aggregate(codes(run), zero, step, ends)
    before = lambda x: F.length(F.regexp_extract(F.substring(run, 1, x["a"]), "[A-Za-z0-9+]*$", 0))
    after = lambda x: F.length(F.regexp_extract(F.substring(run, x["b"] + 1, F.length(run)), "^[A-Za-z0-9+]*", 0))
    return F.transform(
        found,
        lambda x: F.struct(
            (span["start"] + x["a"] - before(x)).alias("start"), F.lit(3).alias("rank"), (span["start"] + x["b"] + after(x)).alias("end"), F.lit(KINDS[3]).alias("kind")
        ),
    )


def merged(spans: Column) -> Column:
    """Spans of one kind, sorted, with those that overlap made one."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(SPAN),
        lambda out, s: F.when(
            F.coalesce(s["start"] < F.get(out, F.size(out) - 1)["end"], F.lit(False)),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(F.struct(F.get(out, F.size(out) - 1)["start"].alias("start"), s["rank"].alias("rank"), F.greatest(s["end"], F.get(out, F.size(out) - 1)["end"]).alias("end"), s["kind"].alias("kind"))),
            ),
        ).otherwise(F.concat(out, F.array(s))),
    )


def blanked(text: Column, spans: Column) -> Column:
    """The text with each character of the spans a space."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(
                acc["out"],
                F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(acc["at"], s["start"]), F.lit(0))),
            ).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def scanned(docs: DataFrame, model: list[float], threshold: float = 0.35) -> DataFrame:
    """Every row with ``base`` and ``spans`` (arrays of SPAN's struct, by start, then kind).

    Columns of these two names are replaced; all others pass through, whatever their names. An empty
    table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    docs = docs.select(F.struct(*kept).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    text = F.col("_text")
    ratios = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")  # one value: an array of 4356 would be walked by every rule
    keyed = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    long = F.lit(True)
    d = docs.withColumn("_a", located(text, ASSIGN, 0, keyed))
    value = lambda s: F.length(F.regexp_extract(cut(text, s), ASSIGN, 2)) >= 8
    d = d.withColumn("_a", F.filter("_a", value))
    d = d.withColumn("_k", located(text, ACCESS, 1, F.contains(text, F.lit("AKIA"))))
    d = d.withColumn("_h", located(text, HEX, 2, long))
    d = d.withColumn("base", F.array_sort(F.concat("_a", "_k", "_h")))
    d = d.withColumn("_left", blanked(text, F.col("base")))
    left = F.col("_left")
    d = d.withColumn("_m", located(left, CANDIDATE, 3, long)).withColumn("_p", located(left, PART, 3, F.size("_m") > 0))
    run = lambda s: cut(left, s)
    mixed = lambda s: run(s).rlike("[0-9]") & run(s).rlike("[A-Za-z]")
    long_mixed = lambda s: (s["end"] - s["start"] >= LONG) & mixed(s)
    likely = lambda c: F.filter(F.filter(c, long_mixed), lambda s: ratio(run(s), ratios) > threshold)
    d = d.withColumn("_w", likely("_m"))
    rest = F.filter("_m", lambda s: mixed(s) & ~F.array_contains(F.col("_w"), s))
    found = F.flatten(F.transform(rest, lambda s: stretches(run(s), s, ratios, threshold)))
    d = d.withColumn("_s", F.filter(found, mixed))
    added = merged(F.concat("_w", likely("_p"), "_s"))
    d = d.withColumn("spans", F.when(F.size("_m") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base")))
    return d.select("_row.*", "base", "spans")


def joined(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each maximal run of overlapping spans replaced by ``mark``."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def digest(d: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return d.select(
        "doc_id",
        *[n(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
