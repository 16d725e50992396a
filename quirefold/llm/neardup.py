"""MinHash near-dedup by an inverted join over signature coordinates, confirmed on full sets.

1. Each text gives its set of distinct 3-word shingles (64-bit hashes), a 128-bit name of that set
   and a signature of ``coordinates`` minima. Texts with equal sets form a class, stood for by its
   least doc_id.
2. Classes are posted under each coordinate-value pair. Two texts at the similarity asked for agree
   in at least ``matches`` of the coordinates, but for a chance of about 1e-8 at the defaults. Skip:
   a class with fewer than ``matches`` pairs that another class also has can't reach it and ends
   here. Prefix: of the others only the ``coordinates - matches + 1`` rarest pairs (counting those
   nobody shares) are needed, as two that agree in ``matches`` pairs share one of these.
3. Classes that meet in a prefix pair are linked to the pair's least one; components of these stars
   are candidate groups. No pairs are made within a list.
4. In a group, collisions of signatures are counted; at ``matches`` or more the full sets decide. A
   search from each reached text visits only texts not reached yet, so a group of thousands of near
   copies costs little more than a star, and no link between different components is lost.
5. Groups above ``most`` classes are cut into chunks, to each of which the group's first texts are
   added; then every text outside the group's largest component is compared with all chunks. Links
   inside that component need no more search; every other link has an end that was compared.

Edge cases: null or wordless texts have an empty set and link with nothing; fewer than three words
form one shingle; a null doc_id links with nothing and is kept; rows that share a doc_id share its
component; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import partitions, stored
from quirefold.llm.graph import components
from quirefold.llm.hashing import Words, distinct, mixed, pieces, runs

ROW = "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, sig array<bigint>"
_rng = np.random.default_rng(20240229)
MULTIPLIERS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)

#: Groups of up to this many classes in all (three longs each) are broadcast to the texts.
MAX_IDS = 400_000
SET = 1024  # shingles of a class for which a group has room, on average
BASE = 0x9E3779B97F4A7C15  # of the hashes of runs of words


def shingle_sets(texts: list[bytes | None], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the runs of ``words`` words of each text, A-Z lower-cased."""
    texts = [(t or b"").lower() for t in texts]
    for s, e in pieces(texts):
        w = Words(texts[s:e])
        h = mixed(runs(w.hashes, words, BASE))
        for a, b in zip(w.starts, w.ends, strict=True):
            if b - a >= words:
                yield distinct(h[a : b - words + 1])
            else:  # the whole sequence, named as no longer run is
                yield mixed(runs(w.hashes[a:b], int(b - a), BASE)) if b > a else w.hashes[:0]


def signature(s: np.ndarray, coordinates: int) -> np.ndarray:
    """Minima of ``coordinates`` hash functions over a set, in pieces to bound memory."""
    out = np.full(coordinates, np.iinfo(np.uint64).max, dtype=np.uint64)
    a, b = MULTIPLIERS[:coordinates, None], ADDENDS[:coordinates, None]
    for k in range(0, len(s), 2048):
        h = s[None, k : k + 2048] * a + b
        np.minimum(out, h.min(axis=1), out=out)
    return out


def sketched(coordinates: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, sig = [], [], [], []
            for s in shingle_sets(batch.column("_t").to_pylist(), words):
                name = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                s1.append(name >> 64)
                s2.append(name & ((1 << 64) - 1))
                sig.append(signature(s, coordinates).view(np.int64) if len(s) else [])
            as_long = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64), pa.int64())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), as_long(s1), as_long(s2), pa.array(sig, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "s1", "s2", "sig"])

    return run


def searched(coordinates: int, matches: int, words: int, percent: int):
    """Links (a, b) that connect a group; rows are (doc_id, _t, ask). ``ask``: search starts here."""

    def run(table: pa.Table) -> pa.Table:
        ids = np.array(table["doc_id"].to_pylist(), dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        ids, ask = ids[order], np.array(table["ask"].to_pylist(), dtype=bool)[order]
        sets = list(shingle_sets(table["_t"].take(pa.array(order)).to_pylist(), words))
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        marked = np.zeros(len(names), dtype=bool)
        sigs = np.stack([signature(s, coordinates) for s in sets])
        left = np.ones(len(ids), dtype=bool)  # not reached yet
        some_passive = not ask.all()
        a, b = [], []
        for root in np.flatnonzero(ask):
            if not left[root]:
                continue
            left[root] = False
            queue = [root]
            while queue and left.any():
                at = queue.pop()
                rest = np.flatnonzero(left)
                fit = (100 * sizes[rest] >= percent * sizes[at]) & (100 * sizes[at] >= percent * sizes[rest])
                rest = rest[fit]
                rest = rest[(sigs[rest] == sigs[at]).sum(axis=1) >= matches]
                if not len(rest):
                    continue
                own = flat[begins[at] : begins[at] + sizes[at]]
                marked[own] = True
                if len(rest) > 8:
                    both = np.add.reduceat(marked[flat], begins, dtype=np.int64)[rest]
                else:
                    both = np.array([marked[flat[begins[k] : begins[k] + sizes[k]]].sum() for k in rest])
                marked[own] = False
                for k in rest[100 * both >= percent * (sizes[at] + sizes[rest] - both)].tolist():
                    left[k] = False
                    a.append(int(ids[root]))
                    b.append(int(ids[k]))
                    if ask[k] or not some_passive:
                        queue.append(k)
            if some_passive:  # other roots may need the rows that were reached from this one
                left[~ask] = True
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def candidate_groups(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(doc_id, grp, n_shingles): classes that may have a link, and their candidate group."""
    posts = classes.select("doc_id", F.explode("sig").alias("pair"))
    shared = posts.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = posts.join(shared, "pair").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("p"))
    prefix = met.filter(F.size("p") >= matches).select(
        "doc_id", F.explode(F.slice("p", 1, F.size("p") - matches + 1)["pair"]).alias("pair")
    )
    prefix = stored(prefix, "prefix")
    stars = prefix.groupBy("pair").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    links = prefix.join(stars, "pair").select("a", F.col("doc_id").alias("b"))
    groups = components(links).select(F.col("id").alias("doc_id"), F.col("component").alias("grp"))
    return groups.join(classes.select("doc_id", "n_shingles"), "doc_id")


def links_within(docs: DataFrame, groups: DataFrame, check, most: int) -> DataFrame:
    """Links (a, b) between classes of the same group that connect whatever is connected."""
    # A group counts as larger than its number of classes if their sets are: ``most`` of SET shingles fit.
    share = F.ceil(F.sum("n_shingles") / SET)
    sizes = groups.groupBy("grp").agg(F.greatest(F.count(F.lit(1)), share).alias("n"))
    large = sizes.filter(F.col("n") > most)
    sized = stored(groups.select("doc_id", "grp").join(sizes, "grp"), "sized")
    # Few enough ids go to the texts; else all texts are shuffled to meet theirs.
    hint = F.broadcast if sized.count() <= MAX_IDS else lambda x: x
    texts = docs.select("doc_id", "_t").join(hint(sized), "doc_id").dropDuplicates(["doc_id"])
    some = large.limit(1).count() > 0
    if not some:
        whole = texts.withColumn("ask", F.lit(True)).groupBy("grp").applyInArrow(lambda t: check(t), "a bigint, b bigint")
        return stored(whole, "links")
    texts = stored(texts, "grouped")
    out = texts.filter(F.col("n") <= most).withColumn("ask", F.lit(True)).groupBy("grp").applyInArrow(lambda t: check(t), "a bigint, b bigint")
    # Chunks by hash; the group's first texts (its least ids, by block minima) join every chunk.
    big = texts.filter(F.col("n") > most).withColumn("chunks", F.ceil(F.col("n") * 2 / most))
    big = big.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")))
    heads = big.groupBy("grp", "chunk").agg(F.min("doc_id").alias("doc_id"))
    heads = heads.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("doc_id"))).filter("k <= 16").select("grp", "doc_id")
    cells = big.select("grp", "chunk").distinct()
    columns = ["doc_id", "_t", "grp", "chunk"]
    leaders = big.drop("chunk").join(heads, ["grp", "doc_id"]).join(cells, "grp").select(*columns)
    round1 = big.select(*columns).unionByName(leaders).dropDuplicates(["doc_id", "grp", "chunk"]).withColumn("ask", F.lit(True))
    first = stored(round1.groupBy("grp", "chunk").applyInArrow(lambda t: check(t), "a bigint, b bigint"), "links")
    label = components(first)
    named = big.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    counts = named.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy("grp").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all"))
    rest = named.join(top, "grp").filter(F.col("component") != F.col("top.component"))
    # So many parts that each has about most / 4 of these texts: every part meets every chunk.
    parts_of = F.ceil((F.col("all") - F.col("top.c")) * 4 / most)
    rest = rest.select("doc_id", "_t", "grp", F.pmod(F.xxhash64("doc_id", F.lit(1)), parts_of).alias("part"))
    rest = stored(rest, "outside")
    parts = rest.select("grp", "part").distinct()
    asks = rest.join(cells, "grp").select("doc_id", "_t", "grp", "chunk", "part").withColumn("ask", F.lit(True))
    there = big.select(*columns).join(parts, "grp").withColumn("ask", F.lit(False))
    there = there.join(asks.select("doc_id", "grp", "chunk", "part"), ["doc_id", "grp", "chunk", "part"], "left_anti")
    second = asks.unionByName(there.select(*asks.columns)).groupBy("grp", "chunk", "part").applyInArrow(lambda t: check(t), "a bigint, b bigint")
    return stored(out.unionByName(first).unionByName(second), "links")


def near_duplicates(
    docs: DataFrame, words: int = 3, percent: int = 85, coordinates: int = 48, matches: int = 26, most: int = 4096
) -> DataFrame:
    """One row per document row: n_shingles, component_id (least doc_id reachable), kept."""
    spark = docs.sparkSession
    base = docs.select("doc_id", F.col("text").cast("binary").alias("_t"))
    rows = stored(base.mapInArrow(sketched(coordinates, words), ROW), "sketches")
    usable = rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    names = stored(usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    classes = usable.join(names.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    groups = stored(candidate_groups(classes, coordinates, matches), "groups")
    check = searched(coordinates, matches, words, percent)
    found = components(links_within(base, groups, check, most))
    named = names.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "s1", "s2", F.coalesce("component", "rep").alias("_c")
    )
    empty = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = rows.drop("sig").join(named, ["s1", "s2"], "left")
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("_c"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
