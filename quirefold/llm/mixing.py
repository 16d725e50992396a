"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash into blocks of about ``block_docs``; block order is the
source's random permutation. A target of e whole sizes and a rest takes every block e times and then
a prefix of the permuted blocks, whose last block is cut between documents where the words come
nearest to the target. The blocks so drawn are a source's quota. A binary tree over the output
shards splits the vector of quotas at each node by a multivariate hypergeometric draw, so that every
shard gets whole numbers of disjoint blocks that sum exactly to the quotas; a source's permuted
draws go to the shards in order, and rows are shuffled inside a shard by hash.

Only one row per source comes to the driver (a bound of 100,000 sources is checked before they are
broadcast; beyond it they are joined by a shuffle). Prefix sums run over blocks in two levels, so a source
that holds a third of all rows meets nowhere in one task.

Edge cases: null or wordless texts have size 0 and follow their block; a null source is a source of
its own, last; rows that share a doc_id fall in the same block and are taken alike; an empty table
gives no rows; extra columns pass through. Reruns with the same rows and seed agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.llm.common import blank_words, small, stored

EDGE_WORDS = 200  # documents up to this size may overshoot a target by half of theirs
RUN = 512  # blocks in a unit of the upper level of prefix sums


def targets(sizes: list[int], weights: list[int], cap: int = 3) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``cap`` sizes; the excess is shared again."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w > cap * sizes[i]}
        for i in over or free:
            out[i] = float(cap * sizes[i]) if over else left * weights[i] / w
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= over
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """quotas[source] dealt over ``shards``: an array [source, shard] whose rows sum to the quotas."""
    out = np.zeros((len(quotas), shards), dtype=np.int64)

    def node(q: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = q
            return
        mid, total = (lo + hi) // 2, int(q.sum())
        rng = np.random.default_rng([seed, lo, hi])
        half = total * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(q, half, method="marginals") if total else q
        node(left, lo, mid)
        node(q - left, mid, hi)

    node(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


def sized(docs: DataFrame, seed: int, *more: str) -> DataFrame:
    """Rows with their source's key, size in words and the hash that deals them into blocks."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("_s"),
        F.size(blank_words(F.col("text"))).cast("long").alias("size"),
        F.xxhash64("doc_id", F.lit(seed)).alias("_h"),
        *more,
    )


#: Columns of the rows of sources that the driver makes.
PLAN = {
    "_s": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "whole": pa.int32(), "rest": pa.float64(), "blocks": pa.int64(),
    "ends": pa.list_(pa.int64()), "last": pa.int64(), "need": pa.float64(),
}


def local(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """Rows of sources as a table; it goes over as Arrow, so no job and no Python worker makes it."""
    return spark.createDataFrame(pa.table({k: pa.array(v, PLAN[k]) for k, v in columns.items()}))


def mix(docs: DataFrame, block_docs: int = 32, shards: int = 16, seed: int = 7, with_text: bool = False) -> DataFrame:
    """One row per document row: size, source_size, target, times, taken, shards (of its copies), order.

    ``times`` counts whole copies; ``order`` sorts rows inside a shard. ``with_text`` adds the columns of
    ``docs`` whose names differ from these: what becomes of a row follows from its source and id, so
    texts are read once more and joined to small tables, never shuffled.
    """
    spark = docs.sparkSession
    rows = stored(sized(docs, seed), "sizes")
    found = rows.groupBy("_s").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect()
    found = sorted(found, key=lambda r: (r["_s"] == "-", r["_s"].encode()))
    # numpy draws from fewer than 10^9 blocks; each may be drawn three times.
    block_docs = max(block_docs, -(-sum(r["n"] for r in found) // 250_000_000))
    sizes = [r["w"] for r in found]
    want = targets(sizes, [1 + i % 3 for i in range(len(found))])
    whole = [int(t // s) if s else 0 for t, s in zip(want, sizes, strict=True)]
    rest = [t - e * s for t, e, s in zip(want, whole, sizes, strict=True)]
    blocks = [-(-r["n"] // block_docs) for r in found]
    told = {"_s": [r["_s"] for r in found], "source_size": sizes, "target": [float(t) for t in want], "whole": whole, "rest": [float(x) for x in rest], "blocks": blocks}
    deal = lambda rows, plan: rows.join(F.broadcast(plan) if len(found) <= 100_000 else plan, "_s").withColumn("block", F.pmod("_h", F.col("blocks")))
    cut = {r["_s"]: r for r in boundaries(deal(rows, local(spark, told))).collect()}
    last = [cut[s]["block"] if s in cut else None for s in told["_s"]]
    drawn = [e * b + (0 if x is None else x + 1) for e, b, x in zip(whole, blocks, last, strict=True)]
    quota = split_quotas(drawn, shards, seed)
    need = [cut[s]["need"] if s in cut else None for s in told["_s"]]
    plan = local(spark, told | {"ends": [np.cumsum(q).tolist() for q in quota], "last": last, "need": need})
    chosen = stored(edges(deal(rows, plan)), "edges")
    base = sized(docs, seed, *[c for c in docs.columns if c not in OWN]) if with_text else rows
    once = deal(base, plan).join(small(chosen, 1_000_000), ["_s", "_h"], "left")
    extra = F.when(F.col("block") < F.col("last"), 1).otherwise(F.coalesce("_edge", F.lit(0)))
    once = once.withColumn("times", F.col("whole") + extra)
    shard = lambda j: F.size(F.filter("ends", lambda e: e <= j))
    copies = F.when(F.col("times") > 0, F.sequence(F.lit(0), F.col("times") - 1)).otherwise(F.array().cast("array<int>"))
    return once.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.col("times").cast("int").alias("times"),
        (F.col("size") * F.col("times")).cast("long").alias("taken"),
        F.transform(copies, lambda e: shard(e * F.col("blocks") + F.col("block"))).alias("shards"),
        F.transform(copies, lambda e: F.xxhash64("doc_id", e, F.lit(seed + 1))).alias("order"),
        *[c for c in docs.columns if with_text and c not in OWN],
    )


#: Columns of ``mix`` and those it works with; columns of documents with these names don't pass through.
OWN = (
    "doc_id", "source", "size", "source_size", "target", "times", "taken", "shards", "order",
    "_s", "_h", "whole", "rest", "blocks", "block", "ends", "last", "need", "_edge",
)


def edges(dealt: DataFrame) -> DataFrame:
    """(_s, _h, _edge): documents taken of the block in which a source's prefix ends.

    Largest first, each is taken that still fits, give or take half of it, so that the words come as
    near as the sizes allow.
    """
    edge = dealt.filter(F.col("block") == F.col("last")).groupBy("_s", "_h", "need").agg(F.sum("size").alias("w"))
    packed = edge.groupBy("_s", "need").agg(F.sort_array(F.collect_list(F.struct("w", "_h")), asc=False).alias("a"))
    room = lambda acc, x: acc["left"] >= F.when(x["w"] <= EDGE_WORDS, x["w"] / 2).otherwise(x["w"])
    fill = F.aggregate(
        "a",
        F.struct(F.col("need").alias("left"), F.array().cast("array<bigint>").alias("took")),
        lambda acc, x: F.struct(
            (acc["left"] - F.when(room(acc, x), x["w"]).otherwise(0)).alias("left"),
            F.when(room(acc, x), F.concat(acc["took"], F.array(x["_h"]))).otherwise(acc["took"]).alias("took"),
        ),
        lambda acc: acc["took"],
    )
    return packed.select("_s", F.explode(fill).alias("_h"), F.lit(1).alias("_edge"))


def copies(mixed: DataFrame) -> DataFrame:
    """One row for each copy that the mix takes: its shard, its place in it, and the document's columns."""
    both = F.explode(F.arrays_zip(F.col("shards").alias("shard"), F.col("order").alias("place"))).alias("_c")
    rest = [c for c in mixed.columns if c not in ("shards", "order", "times", "taken", "shard", "place")]
    return mixed.select(both, *rest).select("_c.shard", "_c.place", *rest)


def write_shards(mixed: DataFrame, path: str) -> None:
    """Writes the copies as Parquet, a folder for each shard, in shuffled order inside it.

    Rows are dealt by ranges of (shard, place), so a shard larger than a task's share spans several
    files, whose names follow its order.
    """
    taken = copies(mixed)
    parts = max(int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    taken.repartitionByRange(parts, "shard", "place").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)


def boundaries(dealt: DataFrame) -> DataFrame:
    """(_s, block, need): the block in which each source's rest ends, and the words still wanted there."""
    sums = stored(
        dealt.filter("rest > 0").groupBy("_s", "block", "rest").agg(F.sum("size").alias("w")).withColumn("run", F.floor(F.col("block") / RUN)),
        "blocks",
    )
    upper = sums.groupBy("_s", "run").agg(F.sum("w").alias("w"))
    before = F.sum("w").over(Window.partitionBy("_s").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    upper = upper.select("_s", "run", F.coalesce(before, F.lit(0)).alias("base"))
    inner = F.sum("w").over(Window.partitionBy("_s", "run").orderBy("block"))
    at = sums.join(upper, ["_s", "run"]).withColumn("upto", F.col("base") + inner)
    ends = at.filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("w") < F.col("rest")))
    return ends.select("_s", "block", (F.col("rest") - F.col("upto") + F.col("w")).alias("need"))


def digest(d: DataFrame) -> DataFrame:
    return d.select("doc_id", "size", "source_size", "target", "taken", "source", "times", "shards")
