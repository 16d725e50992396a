"""Embedding near-dedup: approximate search in per-shard HNSW graphs, exact cosines, components.

1. Rows of equal vectors form a class, named by 128 bits of hash and stood for by its least vec_id;
   copies combine before the shuffle, and only classes are indexed and searched.
2. Classes are dealt to shards by hash, so many that a shard has about ``shard_rows`` of them. Each
   builds a graph (``hnsw.Graph``). Every class is a query to every shard. A cell is a shard with one
   block of queries: its task builds the graph and streams the queries through, so its memory follows
   the shard and its time the block, and a lost task is run again from its inputs.
3. A task widens its beam until an audit against a scan finds the share ``target`` of links, on a
   sample of nodes and of vectors made to lie exactly at the threshold. Single queries widen theirs
   until it holds something below the threshold. The widest beam is the scan of the shard.
4. What the search finds is verified in double precision. A task gives each query's number of linked
   rows and, for the links themselves, only a forest that joins whatever they join: at most one link
   a node, not all pairs of a group. Components of the forests are the groups.

Edge cases: vectors that are null, empty, zero or hold null or non-finite entries link with nothing
and are kept, as are rows with a null vec_id; shorter vectors count as filled up with zeros. Each row
of a repeated vec_id is a vector of its own. Copies are links of each other. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import stored
from quirefold.llm.graph import components
from quirefold.llm.hnsw import Graph

#: How far below the threshold single precision looks; what it finds is verified.
SLACK = 1e-5
FOUND = "kind int, a bigint, b bigint, n bigint"


def keyed(vectors: DataFrame) -> DataFrame:
    """Adds ``v`` (usable vectors, -0 as 0; else null) and ``s1``, ``s2``, the class's name."""
    kind = dict(vectors.dtypes)["embedding"].removeprefix("array<").removesuffix(">")
    real = kind if kind in ("float", "double") else "double"
    v = F.transform("embedding", lambda c: c.cast(real) + F.lit(0).cast(real))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    usable = F.col("vec_id").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda c: c != 0)
    rows = vectors.select("vec_id", F.when(F.coalesce(usable, F.lit(False)), v).alias("v"))
    name = lambda k: F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(k), F.col("v")))
    return rows.withColumn("s1", name(1)).withColumn("s2", name(2))


def unit(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of a batch scaled to length 1, in double precision."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    x = np.zeros((len(column), d))
    x[np.arange(d) < np.diff(ends, prepend=0)[:, None]] = flat
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node joined to it) that join what the links (a, b) join."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = label != np.arange(len(nodes))
    return nodes[some], nodes[label[some]]


class Cell:
    """One shard, built from its rows, and what a block of queries finds in it."""

    def __init__(self, parts: list[pa.RecordBatch], d: int, least: float, target: float):
        of = lambda c: np.concatenate([p.column(c).to_numpy() for p in parts])
        self.s1, self.s2, self.rep, self.size, self.least = of("s1"), of("s2"), of("rep"), of("size"), least
        self.exact = np.concatenate([unit(p.column("v"), d) for p in parts])
        order = np.lexsort((self.s2, self.s1))  # the same graph however the rows came
        self.s1, self.s2, self.rep, self.size, self.exact = (x[order] for x in (self.s1, self.s2, self.rep, self.size, self.exact))
        self.graph = Graph(self.exact)
        self.beam = self.graph.audited(least, target)
        self.links = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))

    def counts(self, b: pa.RecordBatch, d: int) -> pa.RecordBatch:
        of = lambda c: b.column(c).to_numpy()
        s1, s2, rep, q = of("s1"), of("s2"), of("rep"), unit(b.column("v"), d)
        n = np.zeros(len(q), dtype=np.int64)
        for i, j in self.graph.within(q, self.least - SLACK, self.beam):
            for k in range(0, len(i), 1 << 16):
                x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                fits = (np.einsum("nd,nd->n", q[x], self.exact[y]) >= self.least) & ((s1[x] != self.s1[y]) | (s2[x] != self.s2[y]))
                x, y = x[fits], y[fits]
                np.add.at(n, x, self.size[y])
                self.links = forest(np.concatenate([self.links[0], rep[x]]), np.concatenate([self.links[1], self.rep[y]]))
        some = n > 0
        return found_rows(0, s1[some], s2[some], n[some])


def found_rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(a), kind, dtype=np.int32)), *[pa.array(x, pa.int64()) for x in (a, b, n)]]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b", "n"])


def searched(d: int, least: float, target: float):
    """FOUND rows of cells; a cell's index rows come before its queries. Kind 0: (s1, s2, linked rows); 1: a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, cell = None, [], None
        for b in batches:
            key = 2 * b.column("cell").to_numpy().astype(np.int64) + b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                now, part = divmod(int(key[s]), 2), b.slice(s, e - s)
                if now[0] != at:
                    if cell:
                        yield found_rows(1, *cell.links, np.zeros(len(cell.links[0])))
                    at, parts, cell = now[0], [], None
                if now[1] == 0:
                    parts.append(part)
                    continue
                if cell is None and parts:
                    cell, parts = Cell(parts, d, least, target), []
                if cell:
                    yield cell.counts(part, d)
        if cell:
            yield found_rows(1, *cell.links, np.zeros(len(cell.links[0])))

    return run


def near_vectors(
    vectors: DataFrame, least: float = 0.9, shard_rows: int = 50_000, least_shards: int = 6, block_rows: int = 500_000, target: float = 0.995
) -> DataFrame:
    """One row per vector row: n_links, component_id, kept."""
    rows = keyed(vectors)
    grouped = rows.filter("v is not null").groupBy("s1", "s2")
    classes = stored(grouped.agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("v").alias("v")), "vector-classes")
    n, d = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    shards, blocks = max(least_shards, -(-n // shard_rows)), max(1, -(-n // block_rows))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    part = lambda c, k: F.pmod(F.col(c), F.lit(k)).cast("int")
    index = classes.select("*", F.lit(0).alias("kind"), each(blocks).alias("_b")).withColumn("_s", part("s1", shards))
    asked = classes.select("*", F.lit(1).alias("kind"), each(shards).alias("_s")).withColumn("_b", part("s2", blocks))
    both = index.unionByName(asked).withColumn("cell", F.col("_b") * shards + F.col("_s")).drop("_b", "_s")
    cells = both.repartitionById(shards * blocks, F.col("cell")).sortWithinPartitions("cell", "kind")
    found = stored(cells.mapInArrow(searched(d or 0, least, target), FOUND), "vector-links")
    linked = found.filter("kind = 0").groupBy(F.col("a").alias("s1"), F.col("b").alias("s2")).agg(F.sum("n").alias("n"))
    groups = components(found.filter("kind = 1").select("a", "b")).select(F.col("id").alias("rep"), "component")
    told = classes.select("s1", "s2", "rep", "size").join(linked, ["s1", "s2"], "left").filter("n is not null or size > 1").join(groups, "rep", "left")
    told = told.select("s1", "s2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("_n"), F.coalesce("component", "rep").alias("_c"))
    out = rows.drop("v").join(told, ["s1", "s2"], "left")
    component = F.coalesce("_c", F.col("vec_id"))
    return out.select(
        "vec_id", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_links"), component.cast("bigint").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
