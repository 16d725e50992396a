"""Quality rules by robust multivariate outliers (minimum covariance determinant).

Only DataFrame functions are used. Per document: plain counts, then a vector of five transformed
statistics in fixed point. Per pool of documents, a language and source, the estimate starts from
robust moments, plain moments and moments of ``tries`` small subsets chosen by hash, and takes
concentration steps until its determinant no longer falls, however many that takes: rank rows by Mahalanobis distance, keep the nearest
``share`` and take their mean and covariance. The start with the least determinant wins; rows within
the 97.5 % quantile of the chi-square then give the final mean and covariance. Documents are rejected
beyond ``cutoff``, the quantile that one in 100,000 normal vectors exceeds. A pool whose median
distance is above the chi-square's has its distances scaled down to it; none are scaled up.

A pool below ``min_rows`` rows is judged by an estimate from all rows of its language, or from all rows
at all if these are too few.

Sums are exact (decimals of fixed-point integers) and ranks come from per-pool histograms of the
distance's logarithm, so the verdicts don't depend on how rows are dealt, and no pool, however
large, meets in one task: only its bounded histogram and its moments do.

Three of the statistics are 0 in most documents, so their covariance would be singular: each variance
gets ``floors`` squared added, small enough that each statistic alone can reject a document.

Edge cases: null text has no words and fails the base rule; null language or source is a value of its
own; with fewer than ``least`` rows in all nothing is rejected beyond the base rule; repeated rows are
judged one by one; extra columns pass through ``measured`` and are ignored here; an empty table gives
no rows.
"""

from __future__ import annotations

import logging
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import blank_words, stored

STATS = ("x0", "x1", "x2", "x3", "x4")
#: Fixed point of the statistics: this many steps to 1.
SCALE = 1000
#: Tables of pools up to this many rows are broadcast.
MAX_POOLS = 20_000
#: Median of the chi-square of 5 degrees of freedom.
CHI2_MEDIAN = 4.35146
#: Its quantiles at 0.975 and at 1 - 1e-5.
CHI2_NEAR, CHI2_FAR = 12.8325, 30.8562
SUBSET = 30  # rows of a start from a small subset, about
SYMBOLS = r"[#*$%&|<>]+"
P = len(STATS)
log = logging.getLogger(__name__)


def measured(docs: DataFrame) -> DataFrame:
    """Every row with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.withColumn("_words", blank_words(F.col("text"))).withColumn("_lines", lines)
    # A 3-word window as one long: its hash above, its position in the low bits. Sorted, equal
    # windows stand together; the sort runs on primitive longs.
    d = d.withColumn("_bits", F.length(F.bin(F.size("_words") + 1)).cast("int"))
    packed = F.transform(
        F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda w, i: F.call_function(
            "shiftleft", F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)), F.col("_bits")
        ).bitwiseOR(i.cast("long")),
    )
    d = d.withColumn("_s", F.sort_array(F.coalesce(packed, F.array().cast("array<bigint>"))))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1
    d = d.withColumn("_low", low)
    word = lambda x, k: F.get("_words", x.bitwiseAND(F.col("_low")).cast("int") + k)

    def same(x: Column, y: Column) -> Column:
        """Equal hashes, and equal words: a long text leaves fewer bits to the hash."""
        out = F.call_function("shiftright", x.bitwiseXOR(y), F.col("_bits")) == 0
        for k in range(3):
            out = out & (word(x, k) == word(y, k))
        return out

    later = F.filter("_s", lambda x, i: same(x, F.get("_s", i - 1)))  # get() is null outside the array
    d = d.withColumn("_later", later)
    first = F.filter("_s", lambda x, i: same(x, F.get("_s", i + 1)))
    d = d.withColumn("_first", F.when(F.size("_later") > 0, first).otherwise(F.col("_later")))
    d = d.withColumn("_at", F.transform(F.concat("_first", "_later"), lambda x: x.bitwiseAND(F.col("_low"))))
    step = lambda k: F.transform("_at", lambda x: x + k)
    covered = F.when(F.size("_at") > 0, F.size(F.array_distinct(F.concat("_at", step(1), step(2))))).otherwise(0)
    return d.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector(m: DataFrame) -> DataFrame:
    """The statistics in fixed point: length, word length, and roots of three shares."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    values = (
        F.log1p("n_words"),
        F.log(F.greatest("word_chars", F.lit(1)) / words) * 3,
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / lines),
        F.sqrt(F.col("n_repeat_words") / words),
    )
    return m.select("*", *[F.round(v * SCALE).cast("long").alias(x) for x, v in zip(STATS, values, strict=True)])


def pooled(v: DataFrame, min_rows: int, least: int) -> tuple[DataFrame, bool]:
    """Adds ``pool``, whose estimate judges a row (null: none does), and ``fits``, the pools it is a sample of.

    Also tells whether there are few enough pools to broadcast a table of them.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    v = v.withColumn("_lang", key("lang")).withColumn("_both", F.concat_ws("\n", "_lang", key("source")))
    n = v.groupBy("_both", "_lang").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    n = stored(n, "sizes")
    whole = (n.agg(F.sum("n")).first()[0] or 0) >= least
    of_lang, own = Window.partitionBy("_lang"), F.col("n") >= min_rows
    wide = F.sum("n").over(of_lang) >= min_rows
    names = n.withColumn("pool", F.when(own, F.col("_both")).when(wide, F.col("_lang")).when(F.lit(whole), F.lit("*")))
    of_all = names.filter("pool = '*'").limit(1).count() > 0
    asked = F.array(
        F.when(own, F.col("_both")),
        F.when(F.max((F.col("pool") == F.col("_lang")).cast("int")).over(of_lang) == 1, F.col("_lang")),
        F.lit("*" if of_all else None).cast("string"),
    )
    names = stored(names.select("_both", "pool", F.array_compact(asked).alias("fits")), "pools")
    light = names.count() <= MAX_POOLS
    return v.join(F.broadcast(names) if light else names, "_both", "left").drop("_lang", "_both"), light


#: Cells (i, j) of a symmetric matrix.
CELLS = [(i, j) for i in range(P) for j in range(i + 1)]


def sums() -> list[Column]:
    """Count, sums and sums of products of STATS: exact, as the fixed point is whole."""
    out = ["count(1) as n", *[f"sum(cast({x} as decimal(38,0))) as s{i}" for i, x in enumerate(STATS)]]
    out += [f"sum(cast({STATS[i]} * {STATS[j]} as decimal(38,0))) as q{i}{j}" for i, j in CELLS]
    return [F.expr(x) for x in out]


def added() -> list[Column]:
    """The sums of ``sums`` rows."""
    return [F.expr(f"sum({x}) as {x}") for x in ("n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in CELLS])]


def moments(s: DataFrame, by: list[str], floors: tuple[float, ...]) -> DataFrame:
    """Mean m_i and covariance c_ij with floors from rows of sums; a group has one."""
    mean = [f"cast(s{i} as double) / n as m{i}" for i in range(P)]
    cov = [
        f"cast(q{i}{j} as double) / n - cast(s{i} as double) / n * (cast(s{j} as double) / n)"
        f" + {(floors[i] * SCALE) ** 2 * (i == j)!r}D as c{i}{j}"
        for i, j in CELLS
    ]
    return s.selectExpr(*by, *mean, *cov)


def factored(params: DataFrame) -> DataFrame:
    """Replaces the covariance by its Cholesky factor l_ij and adds log_det."""
    cells = []
    for i, j in CELLS:
        left = "".join([f"c{i}{j}", *[f" - l{i}{k} * l{j}{k}" for k in range(j)]])
        cells.append(f"sqrt(greatest({left}, 1e-6D)) as l{i}{j}" if i == j else f"({left}) / l{j}{j} as l{i}{j}")
    log_det = " + ".join(f"ln(l{i}{i})" for i in range(P))
    return params.selectExpr("*", *cells, f"{log_det} as log_det").drop(*[f"c{i}{j}" for i, j in CELLS])


def distanced(rows: DataFrame) -> DataFrame:
    """Adds d2: squared Mahalanobis distance of STATS under columns m and l, by forward substitution."""
    z = [f"({''.join([f'{x} - m{i}', *[f' - l{i}{k} * z{k}' for k in range(i)]])}) / l{i}{i} as z{i}" for i, x in enumerate(STATS)]
    d2 = " + ".join(f"z{i} * z{i}" for i in range(P))
    return rows.selectExpr("*", *z, f"{d2} as d2").drop(*[f"z{i}" for i in range(P)])


def binned(rows: DataFrame) -> DataFrame:
    """Adds ``bin`` of the squared distance; 16 bins to each doubling."""
    return distanced(rows).withColumn("bin", F.expr("cast(floor(16 * log2(d2 + 1e-6D)) as int)"))


def running(hist: DataFrame, by: list[str]) -> DataFrame:
    """Adds to a histogram (bin, n) the running count up to each bin and the whole one, by group."""
    w = Window.partitionBy(*by)
    return hist.withColumn("_run", F.sum("n").over(w.orderBy("bin"))).withColumn("_all", F.sum("n").over(w))


def quantile(share: float) -> Column:
    """Least bin of a group of ``running`` rows at which the running count reaches ``share``."""
    return F.min(F.expr(f"if(_run >= _all * {share!r}D, bin, null)"))


def starts(fit: DataFrame, floors: tuple[float, ...], tries: int, hint) -> DataFrame:
    """The first estimates of each pool: medians with quartile spreads, plain moments, small subsets."""
    long = fit.select("pool", F.posexplode(F.array(*STATS)).alias("dim", "bin"))
    hist = long.groupBy("pool", "dim", "bin").agg(F.count(F.lit(1)).alias("n"))
    three = running(hist, ["pool", "dim"]).groupBy("pool", "dim").agg(
        quantile(0.25).alias("lo"), quantile(0.5).alias("mid"), quantile(0.75).alias("hi")
    )
    three = three.withColumn("spread", F.expr("greatest((hi - lo) / 1.349D, 0D)"))
    robust = three.groupBy("pool").agg(
        *[F.expr(f"cast(max(if(dim = {i}, mid, null)) as double) as m{i}") for i in range(P)],
        *[
            F.expr(f"power(max(if(dim = {i}, spread, null)), 2) + {(floors[i] * SCALE) ** 2!r}D as c{i}{j}" if i == j else f"0D as c{i}{j}")
            for i, j in CELLS
        ],
    )
    totals = stored(fit.groupBy("pool").agg(*sums()), "totals")
    some = fit.join(hint(totals.select("pool", F.col("n").alias("_n"))), "pool")
    some = some.withColumn("start", F.explode(F.sequence(F.lit(2), F.lit(1 + tries))))
    some = some.filter(F.pmod(F.xxhash64(*STATS, "start"), F.lit(1 << 30)) * F.col("_n") < SUBSET * (1 << 30))
    small = moments(some.groupBy("pool", "start").agg(*sums()), ["pool", "start"], floors)
    first = robust.withColumn("start", F.lit(0)).unionByName(moments(totals, ["pool"], floors).withColumn("start", F.lit(1)))
    return factored(first.unionByName(small))


def median_scale(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, scale): what brings the median distance of binned rows down to the chi-square's; 1 at least."""
    hist = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    mid = running(hist, by).groupBy(*by).agg(quantile(0.5).alias("mid"))
    return mid.select(*by, F.expr(f"greatest(power(2D, (mid + 0.5D) / 16) / {CHI2_MEDIAN!r}D, 1D) as scale"))


def estimates(fit: DataFrame, light: bool, share: float, floors: tuple[float, ...], tries: int) -> DataFrame:
    """(pool, m, l, scale) of the minimum covariance determinant found, reweighted.

    A step reads the rows once: each bin of distance keeps its rows' sums, and those of the
    nearest bins are added up. A start whose determinant no longer falls takes no further step. Falling
    values of finitely many sets of rows come to an end, so no number of steps is set.
    """
    hint = F.broadcast if light else lambda x: x
    by = ["pool", "start"]
    moving, settled = stored(starts(fit, floors, tries, hint), "mcd"), []
    for step in count(1):
        cells = binned(fit.join(hint(moving), "pool")).groupBy(*by, "bin").agg(*sums(), F.max("log_det").alias("_old"))
        near = running(cells, by).filter(F.expr(f"_run - n < _all * {share!r}D"))
        new = near.groupBy(*by).agg(*added(), F.max("_old").alias("_old"))
        new = factored(moments(new, [*by, "_old"], floors)).selectExpr("*", f"{step == 1} or log_det < _old - 1e-6D as _moved")
        new = stored(new.drop("_old"), "mcd")
        settled.append(new.filter("not _moved").drop("_moved"))
        moving = new.filter("_moved").drop("_moved")
        left = moving.count()
        log.info("concentration step %d: %d starts still move", step, left)
        if not left:
            break
    params = reduce(DataFrame.unionByName, settled, moving)
    best = Window.partitionBy("pool").orderBy("log_det", "start")
    params = stored(params.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k", "start", "log_det"), "mcd")
    ranked = binned(fit.join(hint(params), "pool"))
    kept = ranked.join(hint(median_scale(ranked, ["pool"])), "pool").filter(F.col("d2") <= CHI2_NEAR * F.col("scale"))
    params = stored(factored(moments(kept.groupBy("pool").agg(*sums()), ["pool"], floors)).drop("log_det"), "mcd")
    scale = median_scale(binned(fit.join(hint(params), "pool")), ["pool"])
    return hint(stored(params.join(scale, "pool"), "mcd"))


def quality(
    docs: DataFrame,
    share: float = 0.75,
    cutoff: float = CHI2_FAR,
    min_rows: int = 60,
    least: int = 30,
    floors: tuple[float, ...] = (0.2, 0.06, 0.03, 0.12, 0.12),
    tries: int = 3,
) -> DataFrame:
    """One row per document row: its counts, base_failed, distance2 (null: no estimate), kept."""
    m = measured(docs.select("doc_id", "text", "lang", "source")).drop("text").withColumn("base_failed", base_failed())
    v, light = pooled(stored(vector(m), "quality"), min_rows, least)
    v = stored(v, "pooled")
    fit = v.filter(~F.col("base_failed") & F.col("pool").isNotNull()).select(F.explode("fits").alias("pool"), *STATS)
    found = estimates(fit, light, share, floors, tries)
    judged = distanced(v.join(found, "pool", "left")).withColumn("distance2", F.col("d2") / F.col("scale"))
    far = F.coalesce(F.col("distance2") > cutoff, F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "distance2",
    )
