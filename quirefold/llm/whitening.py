"""Embedding whitening from a covariance that is built tile by tile.

1. Entries become whole numbers ``x = floor(scale * c)``. Rows of equal x are taken once for the fit
   (their encodings are deduplicated before and after the shuffle, so copies cost little).
2. Sums by dimension give the means. Dimensions are cut into at most ``PANELS`` panels of columns;
   each pair of panels is a tile key. Tasks cut their rows into row blocks and send a block's panels to
   each tile that needs them; a tile's two panels of one row block meet, are centred, and multiplied.
   A task adds up the products of a tile before it sends their sum on, and sums are added per tile.
3. Only the assembled matrix (dimensions by dimensions, whatever the number of rows) comes to the
   driver, which takes its eigenvectors. Rows are then projected where they are.

Edge cases: rows whose vector is null or holds a null, NaN or infinite entry are dropped; copies
and repeated ids are rows like others; a null id stays null. Shorter vectors are filled up with
zeros. An x beyond the range of a long counts as the end of that range. Components without variance
aren't returned, so equal vectors alone, or empty ones, give no rows, as an empty table does. A
deviation beyond a long is null. The sign of a component makes its largest entry positive. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import stored

#: Most panels of columns, so a row is sent at most PANELS times; and their least width.
PANELS, LEAST_WIDTH = 8, 32
ROWS = 4096  # rows of a block at most
FLAT = 1e-12  # eigenvalues up to this share of the largest count as none
LONG = np.iinfo(np.int64)


@dataclass(frozen=True)
class Shape:
    """What the encoding of x needs to know of the whole table."""

    dimensions: int
    low: int
    high: int
    scale: float

    @property
    def kind(self) -> np.dtype:
        """The least type of whole numbers that holds every x."""
        return next(k for k in (np.dtype(f"<i{b}") for b in (1, 2, 4, 8)) if np.iinfo(k).min <= self.low and self.high <= np.iinfo(k).max)


@dataclass(frozen=True)
class Whitening:
    """A fit: n distinct vectors, their sums, and the components by falling eigenvalue (columns of ``axes``)."""

    shape: Shape
    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly."""
        most = self.n * (self.shape.high - self.shape.low)
        small = most * most * max(1, self.shape.dimensions) <= LONG.max and self.n * max(abs(self.shape.low), abs(self.shape.high)) <= LONG.max
        kind = np.int64 if small else object
        d = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return [v if v <= LONG.max else None for v in (d * d).sum(axis=1).tolist()]


def usable(vectors: DataFrame) -> DataFrame:
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vectors.filter(F.col("embedding").isNotNull() & F.forall("embedding", fine)).select("vec_id", "embedding")


def rounded(c: np.ndarray, scale: float) -> np.ndarray:
    """x of entries as doubles that hold whole numbers of a long."""
    return np.clip(np.floor(scale * c) + 0.0, float(LONG.min), np.nextafter(float(LONG.max), 0))


def matrix(column: pa.Array, shape: Shape) -> np.ndarray:
    """x of a batch of vectors, one row each."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    lengths = np.diff(ends, prepend=0)
    x = np.zeros((len(column), shape.dimensions), dtype=shape.kind)
    x[np.arange(shape.dimensions) < lengths[:, None]] = rounded(flat, shape.scale).astype(shape.kind)
    return x


def shape_of(vectors: DataFrame, scale: float) -> Shape:
    v = F.col("embedding")
    d, low, high = vectors.agg(F.max(F.size(v)), F.min(F.array_min(v)), F.max(F.array_max(v))).first()
    ends = rounded(np.array([min(low or 0.0, 0.0), max(high or 0.0, 0.0)]), scale)  # zeros may fill up
    return Shape(d or 0, int(ends[0]), int(ends[1]), scale)


def encoded(shape: Shape):
    width = shape.dimensions * shape.kind.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("embedding"), shape)
            places = np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)
            rows = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(places), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([rows], names=["x"])

    return run


def blocks(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[np.ndarray]:
    """Row blocks of encoded rows."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            raw = b"".join(b.column("x").slice(k, ROWS).to_pylist())
            yield np.frombuffer(raw, dtype=shape.kind).reshape(-1, shape.dimensions)


def summed(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(shape.dimensions, dtype=object)
        small = ROWS * max(-shape.low, shape.high) <= LONG.max
        for x in blocks(batches, shape):
            n += len(x)
            s = s + x.sum(axis=0, dtype=np.int64 if small else object).astype(object)
        if n:
            columns = [pa.array(range(len(s)), pa.int32()), pa.array([n] * len(s), pa.int64()), pa.array([str(v) for v in s])]
            yield pa.RecordBatch.from_arrays(columns, names=["dimension", "n", "s"])

    return run


def panels(shape: Shape, width: int | None = None) -> list[slice]:
    width = width or max(LEAST_WIDTH, -(-shape.dimensions // PANELS))
    return [slice(k, min(k + width, shape.dimensions)) for k in range(0, shape.dimensions, width)]


def dealt(shape: Shape, cuts: list[slice]):
    """Sends the panels of each row block to the tiles that they take part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, x in enumerate(blocks(batches, shape)):
            raw = [np.ascontiguousarray(x[:, c]).tobytes() for c in cuts]
            rows = [(i, j, first + k, p, raw[p]) for i in range(len(cuts)) for j in range(i, len(cuts)) for p in sorted({i, j})]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TILE_TYPES, strict=True)], names=TILE)

    return run


TILE = ["i", "j", "block", "panel", "x"]
TILE_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
SUM = "i int, j int, s binary"


def added(products: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """One row for each run of products of the same tile: their sum."""

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["i", "j", "s"])

    at, total = None, None
    for i, j, p in products:
        if at == (i, j):
            total += p
        else:
            if at:
                yield row()
            at, total = (i, j), p.copy()
    if at:
        yield row()


def multiplied(shape: Shape, cuts: list[slice], mean: np.ndarray):
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        left = None
        for b in batches:
            for i, j, p, raw in zip(*[b.column(c).to_pylist() for c in ("i", "j", "panel", "x")], strict=True):
                x = np.frombuffer(raw, dtype=shape.kind).reshape(-1, cuts[p].stop - cuts[p].start) - mean[cuts[p]]
                if i == j:
                    yield i, j, x.T @ x
                elif p == i:  # sorted by panel: the other one of this block comes next
                    left = x
                else:
                    yield i, j, left.T @ x

    return lambda batches: added(products(batches))


def tile_sums(cuts: list[slice]):
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        for b in batches:
            for i, j, raw in zip(*[b.column(c).to_pylist() for c in ("i", "j", "s")], strict=True):
                yield i, j, np.frombuffer(raw).reshape(cuts[i].stop - cuts[i].start, -1)

    return lambda batches: added(products(batches))


def covariance(rows: DataFrame, shape: Shape, n: int, mean: np.ndarray, width: int | None = None) -> np.ndarray:
    """Covariance (divisor n) of encoded rows, assembled from its tiles."""
    cuts = panels(shape, width)
    sent = rows.mapInArrow(dealt(shape, cuts), "i int, j int, block bigint, panel int, x binary")
    met = sent.repartition("i", "j", "block").sortWithinPartitions("i", "j", "block", "panel")
    part = met.mapInArrow(multiplied(shape, cuts, mean), SUM)
    whole = part.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(tile_sums(cuts), SUM)
    v = np.zeros((shape.dimensions, shape.dimensions))
    for i, j, raw in whole.toLocalIterator():
        t = np.frombuffer(bytes(raw)).reshape(cuts[i].stop - cuts[i].start, -1) / n
        v[cuts[i], cuts[j]], v[cuts[j], cuts[i]] = t, t.T
    return v


def fitted(rows: DataFrame, shape: Shape, components: int = 4, width: int | None = None) -> Whitening | None:
    """The fit to distinct encoded rows; None where nothing varies."""
    sums = rows.mapInArrow(summed(shape), "dimension int, n bigint, s string").groupBy("dimension")
    found = sums.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dimension").collect()
    if not found:
        return None
    n, s = found[0]["n"], [int(r["s"]) for r in found]
    v = covariance(rows, shape, n, np.array([x / n for x in s]), width)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    some = values > max(FLAT * values[0], 0.0)
    values, axes = values[some], axes[:, some]
    if not len(values):
        return None
    axes = axes * np.sign(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], axis=0))
    return Whitening(shape, n, s, values, axes, float(np.trace(v)))


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity.

    Each task centres by its own means before it multiplies; the sums of squares of its rows' means
    join the parts. Those means are all but 0, as x was centred, so nothing is lost to rounding.
    """
    k = len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m = 0, np.zeros(k), np.zeros((k, k))
        for x in blocks(batches, w.shape):
            y = w.project(x)
            own, size = y.mean(axis=0), len(y)
            off = own - mean
            m += (y - own).T @ (y - own) + np.outer(off, off) * (n * size / (n + size))
            mean, n = mean + off * size / (n + size), n + size
        if n:
            at = [(a, b) for a in range(k) for b in range(k)]
            columns = [[a for a, _ in at], [b for _, b in at], [n] * len(at), [mean[a] for a, _ in at], [mean[b] for _, b in at], [m[p] for p in at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 3], strict=True)], names=["a", "b", "n", "p", "q", "m"])

    parts = rows.mapInArrow(run, "a int, b int, n bigint, p double, q double, m double").groupBy("a", "b")
    sums = parts.agg(F.sum("n"), F.sum(F.col("n") * F.col("p")), F.sum(F.col("n") * F.col("q")), F.sum(F.col("m") + F.col("n") * F.col("p") * F.col("q")))
    return max(abs((m - p * q / n) / n - (a == b)) for a, b, n, p, q, m in sums.collect())


def whitened(vectors: DataFrame, w: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("embedding"), w.shape)
            y = w.project(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(w.deviations(x), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, deviation bigint, whitened array<double>")


RESULT = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whitening(vectors: DataFrame, components: int = 4, scale: float = 256.0, width: int | None = None) -> DataFrame:
    """One row per usable vector and component: RESULT."""
    own = usable(vectors)
    shape = shape_of(own, scale)
    rows = stored(own.mapInArrow(encoded(shape), "x binary").dropDuplicates(), "whitening-fit") if shape.dimensions else None
    w = fitted(rows, shape, components, width) if rows is not None else None
    if w is None:
        return own.sparkSession.createDataFrame([], RESULT.format(dict(own.dtypes)["vec_id"]))
    share = F.array(*[F.lit(float(e / w.trace)) for e in w.values])
    out = whitened(own, w).select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return out.select(
        "vec_id", (F.col("_k") + 1).alias("component"), F.lit(w.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(share, F.col("_k")).alias("explained"), F.lit(float(identity_error(rows, w))).alias("identity_error"),
    )
