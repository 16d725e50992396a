"""Substring dedup by seed and extend, exact for repeats of ``size`` words or more.

Seeds are winnowed anchors: of every ``size - gram + 1`` consecutive ``gram``-word hashes the least
is an anchor, so two equal windows of ``size`` words hold the same anchor at the same place. The
anchors of all documents are joined by hash; those of one document only end there. Around each
shared anchor a document extends the match both ways, one word at a time up to ``size`` words: each
extension is a window, named by 96 bits of hash, and all documents that agree on it agree on the
window. No pairs are made: for every window the least doc_id is found, and documents above it lose
the window. Consecutive lost windows merge into maximal repeats.

Documents are dealt once into blocks by a hash of id and text, so rows of one id, or without one, are
spread too. What a block asks of the rest (its distinct anchors,
then its distinct windows) is deduplicated in the block first, so a passage that a third of all
documents share arrives once per block, and answers go back to blocks. Nothing but blobs of hashes
is shuffled after the texts.

Edge cases: null or short texts have no windows and keep their words; a null doc_id counts as the
largest; rows that share a doc_id don't remove each other's words; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import partitions, volume
from quirefold.llm.hashing import Words, least_places, mixed, pieces, runs

LAST = (1 << 63) - 1
ASK = "bucket int, _b bigint, h binary, g binary, lo binary, hi binary"
REPLY = "_b bigint, h binary, g binary, lo binary"
OUT = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, starts array<int>, ends array<int>"


class Hasher:
    """Anchors and windows of documents' words."""

    def __init__(self, size: int, gram: int):
        self.size, self.gram = size, gram
        self.a, self.b = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

    def anchors(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of windows, which of the distinct anchors each has, hashes of these)."""
        start = np.flatnonzero(w.whole(self.size))
        if not len(start):
            return start, start, np.empty(0, np.uint64)
        h = mixed(runs(w.hashes, self.gram, self.a))
        at = least_places(h, self.size - self.gram + 1)[start]
        new = np.concatenate(([True], at[1:] != at[:-1]))
        return start, np.cumsum(new) - 1, h[at[new]]

    def windows(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(64, 32 bits) of hash of every run of words, by its start."""
        second = mixed(runs(w.hashes, self.size, self.b)) >> np.uint64(32)
        return mixed(runs(w.hashes, self.size, self.a)), second.astype(np.uint32)


def grouped_min_max(h: np.ndarray, ids: np.ndarray, g: np.ndarray | None = None):
    """Distinct hashes with the least and largest id of each; also g, the hash's second part."""
    order = np.argsort(h, kind="stable") if g is None else np.lexsort((g, h))
    h, ids = h[order], ids[order]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.empty(0, bool)
    if g is not None and len(h):
        g = g[order]
        new[1:] |= g[1:] != g[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return h, g, ids, ids, order, at
    return h[at], None if g is None else g[at], np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at), order, at


def asked(block: int, buckets: int, h: np.ndarray, g: np.ndarray | None, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
    """A block's distinct hashes as one row for each bucket; sorted by id, so that ids compress."""
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((hi, lo, bucket))
    h, lo, hi, bucket = h[order], lo[order], hi[order], bucket[order]
    g = np.zeros(0, np.uint32) if g is None else g[order]
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(h) else np.empty(0, np.int64)
    ends = np.append(at[1:], len(h))[: len(at)]
    cut = lambda x: [x[s:e].tobytes() for s, e in zip(at, ends, strict=True)]
    return pa.table(
        {
            "bucket": pa.array(bucket[at], pa.int32()),
            "_b": pa.array([block] * len(at), pa.int64()),
            "h": pa.array(cut(h), pa.binary()),
            "g": pa.array(cut(g), pa.binary()),
            "lo": pa.array(cut(lo), pa.binary()),
            "hi": pa.array(cut(hi), pa.binary()),
        }
    )


def joined(column: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of blobs, and how many each row has."""
    parts = [np.frombuffer(x, dtype=dtype) for x in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.empty(0, dtype)), np.array([len(p) for p in parts], dtype=np.int64)


def block_words(table: pa.Table) -> Iterator[tuple[np.ndarray, list[bytes], Words]]:
    """(ids, texts, words) of a block, some MB at a time."""
    ids, texts = np.array(table["_id"].to_pylist(), dtype=np.int64), [x or b"" for x in table["_t"].to_pylist()]
    for s, e in pieces(texts):
        yield ids[s:e], texts[s:e], Words(texts[s:e])


def ask_anchors(size: int, gram: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        hasher, hs, ids = Hasher(size, gram), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for i, _, w in block_words(table):
            start, which, h = hasher.anchors(w)
            hs.append(h)
            first = np.concatenate(([True], which[1:] != which[:-1])) if len(which) else np.empty(0, bool)
            ids.append(i[w.text[start[first]]])
        h, _, lo, hi, *_ = grouped_min_max(np.concatenate(hs), np.concatenate(ids))
        return asked(table["_b"][0].as_py(), buckets, h, None, lo, hi)

    return run


def answer(windows: bool):
    """For a bucket: tells each block which of its anchors, or windows, others share.

    Anchors: those that two different ids have. Windows: those some id of the block must give up,
    with the least id that has them.
    """

    def run(table: pa.Table) -> pa.Table:
        (h, n), (lo, _), (hi, _) = joined(table["h"], np.uint64), joined(table["lo"], np.int64), joined(table["hi"], np.int64)
        g = joined(table["g"], np.uint32)[0] if windows else None
        order, at = grouped_min_max(h, lo, g)[4:]
        least, most = lo.copy(), hi.copy()
        if len(at):
            sizes = np.diff(np.append(at, len(h)))
            least[order] = np.repeat(np.minimum.reduceat(lo[order], at), sizes)
            most[order] = np.repeat(np.maximum.reduceat(hi[order], at), sizes)
        keep = least < (hi if windows else most)
        ends = np.cumsum(n)
        rows = []
        for block, s, e in zip(table["_b"].to_pylist(), ends - n, ends, strict=True):
            k = np.flatnonzero(keep[s:e]) + s
            if len(k):
                rows.append((block, h[k].tobytes(), g[k].tobytes() if windows else b"", least[k].tobytes() if windows else b""))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({k: pa.array(list(c), t) for k, c, t in zip(("_b", "h", "g", "lo"), columns, kinds, strict=True)})

    return run


def ask_windows(size: int, gram: int, buckets: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        shared = np.unique(joined(replies["h"], np.uint64)[0])
        hasher, hs, gs, ids = Hasher(size, gram), [np.empty(0, np.uint64)], [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i, _, w in block_words(table) if len(shared) else ():
            start, which, anchors = hasher.anchors(w)
            # Extend: every window around a shared anchor, from the leftmost to the rightmost.
            start = start[np.isin(anchors, shared)[which]]
            if len(start):
                h, g = hasher.windows(w)
                hs.append(h[start])
                gs.append(g[start])
                ids.append(i[w.text[start]])
        h, g, lo, hi, *_ = grouped_min_max(np.concatenate(hs), np.concatenate(ids), np.concatenate(gs))
        block = table["_b"][0].as_py() if table.num_rows else 0
        return asked(block, buckets, h, g, lo, hi)

    return run


def spans(removed: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of True: the maximal repeats."""
    edge = np.diff(np.concatenate(([0], removed.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def remove(size: int, gram: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        h, g, lo = joined(replies["h"], np.uint64)[0], joined(replies["g"], np.uint32)[0], joined(replies["lo"], np.int64)[0]
        order = np.lexsort((g, h))
        h, g, lo = h[order], g[order], lo[order]
        hasher, rows = Hasher(size, gram), []
        for ids, texts, w in block_words(table):
            removed = np.zeros(len(w.hashes) + 1, dtype=np.int32)
            start = np.flatnonzero(w.whole(size)) if len(h) else np.empty(0, np.int64)
            if len(start):
                wh, wg = (x[start] for x in hasher.windows(w))
                k = np.searchsorted(h, wh)
                for _ in range(8):  # past equal first parts with another second part
                    j = np.minimum(k, len(h) - 1)
                    k = k + ((h[j] == wh) & (g[j] < wg) & (k < len(h)))
                k = np.minimum(k, len(h) - 1)
                start = start[(h[k] == wh) & (g[k] == wg) & (lo[k] < ids[w.text[start]])]
                removed[start] = 1
                np.subtract.at(removed, start + size, 1)
            gone = np.cumsum(removed[:-1]) > 0
            for i, text, s, e in zip(ids.tolist(), texts, w.starts, w.ends, strict=True):
                out, own = text.split(), gone[s:e]
                lost = int(own.sum())
                if lost:
                    out = [x for x, y in zip(out, own.tolist(), strict=True) if not y]
                rows.append((i, int(e - s), lost, hashlib.sha256(b" ".join(out)).hexdigest(), *(spans(own) if lost else ([], []))))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        names = ("id", "n_words", "n_removed", "kept_sha256", "starts", "ends")
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.table({k: pa.array(list(c), t) for k, c, t in zip(names, columns, kinds, strict=True)})

    return run


def dedup(docs: DataFrame, size: int = 50, gram: int = 20, block_bytes: int = 2_500_000) -> DataFrame:
    """One row per document row: n_words, n_removed, kept_sha256, and the repeats' word spans."""
    n, size_ = volume(docs)
    blocks = max(1, -(-size_ // block_bytes))
    parts = partitions(docs.sparkSession, n)
    base = (
        docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.col("text").cast("binary").alias("_t"))
        .withColumn("_b", F.pmod(F.xxhash64("_id", "_t"), F.lit(blocks)))
        .repartition(parts, "_b")
    )
    anchors = base.groupBy("_b").applyInArrow(ask_anchors(size, gram, parts), ASK)
    shared = anchors.groupBy("bucket").applyInArrow(answer(False), REPLY)
    around = base.groupBy("_b").cogroup(shared.groupBy("_b")).applyInArrow(ask_windows(size, gram, parts), ASK)
    least = around.groupBy("bucket").applyInArrow(answer(True), REPLY)
    out = base.groupBy("_b").cogroup(least.groupBy("_b")).applyInArrow(remove(size, gram), OUT)
    return out.select(F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), *[c for c in out.columns if c != "id"])


def digest(d: DataFrame) -> DataFrame:
    return d.select("doc_id", "n_words", "n_removed", "kept_sha256")
