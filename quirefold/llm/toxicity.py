"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

A text's vector has the hashed beginnings of all its words: their first 4, 5 and 7 bytes in lower case,
or the whole of a shorter word. Each is weighed by 1 + log(count), its inverse document frequency and
its lean to toxic in labelled texts: 1, and ``LEAN`` more for each unit by which the lower bound of its
log odds ratio exceeds ``LEAST``. None is left out, of examples or of queries, so any example can be a
neighbour.

Examples are put in blocks of similar ones. A block holds its postings by feature, those of frequent
features as whole rows, and the index the largest weight of each feature in each block. A query visits
blocks by their upper bound and stops when no block can change its ``k`` nearest, so the result
equals a full scan's. Neighbours vote, each weighed by its cosine. The vote becomes a probability by
isotonic regression over labelled rows that aren't examples and had no part in the weights. The nearest
ones are the evidence.

The classifier is fitted on bounded samples of labelled rows, chosen by hash: at most ``most`` rows and
``most_bytes`` of text; ``per_label`` of each label among them are the examples, from which the features'
weights come too, and the others are for the calibration alone. All rows are scored, each by itself, so memory is bounded by a batch of texts.

Edge cases: null or empty text has no feature and gets the rate of toxic rows in the sample; with no
usable label every score is 0; a label other than 0 and 1 is none; a doc_id that ``labels`` has twice counts as toxic if any row says so;
repeated rows are scored alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import crc_mod
from quirefold.llm.hashing import mixed, pieces

PREFIXES = (4, 5, 7)  # bytes of the beginnings of words
BITS = 20
#: Weight of a feature that leans to toxic, by how far its log odds less SURE standard errors exceed LEAST.
LEAN, SURE, LEAST = 30.0, 2.0, 1.0
BLOCK = 128  # examples in a block
DENSE = 8  # postings of a feature in a block from which they are kept as a row
PART = 1 << 20  # bytes of text worked on at once
#: Bytes of letters, digits and all beyond ASCII keep their value; other bytes are blanks.
KEEP = np.array([b if (48 <= b < 58 or 97 <= b < 123 or b >= 128) else 32 for b in range(256)], dtype=np.uint8)


def text_features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct hashed beginnings of words, counts) of each text; a long text is read in pieces."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    for s, e in pieces(parts, PART):
        own = parts[s:e]
        if e - s == 1 and len(own[0]) > PART:
            counts = np.zeros(1 << BITS, dtype=np.int64)
            for piece in cut(own[0]):
                counts += np.bincount(word_features([piece])[1], minlength=1 << BITS)
            at = np.flatnonzero(counts)
            yield at, counts[at]
            continue
        text, h = word_features(own)
        names, counts = np.unique((text << BITS) | h, return_counts=True)
        ends = np.searchsorted(names, np.arange(1, e - s + 1) << BITS)
        names &= (1 << BITS) - 1
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            yield names[lo:hi], counts[lo:hi]


def cut(text: bytes) -> Iterator[bytes]:
    """Pieces of about PART bytes that end where a word does."""
    raw, at = KEEP[np.frombuffer(text, dtype=np.uint8)], 0
    while at < len(text):
        end = min(at + PART, len(text))
        while end < len(text) and raw[end - 1] != 32:
            blank = np.flatnonzero(raw[end : end + PART] == 32)
            end = min(end + (int(blank[0]) + 1 if len(blank) else PART), len(text))
        yield text[at:end]
        at = end


def word_features(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the beginnings of all words; of a shorter word, the whole with a blank, once."""
    raw = KEEP[np.frombuffer(b" ".join(parts) + b" " * (1 + PREFIXES[-1]), dtype=np.uint8)]
    start = np.flatnonzero((raw[1:] != 32) & (raw[:-1] == 32)) + 1
    if raw[0] != 32:
        start = np.concatenate(([0], start))
    text = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, side="right")
    h, on = np.zeros(len(start), dtype=np.uint64), np.ones(len(start), dtype=bool)
    texts, out = [], []
    for k in range(PREFIXES[-1]):
        own = np.flatnonzero(on)
        h[own] = h[own] * np.uint64(257) + raw[start[own] + k]
        on[own] = raw[start[own] + k] != 32  # a word's blank ends it
        if k + 1 in PREFIXES:
            shown = own if k + 1 > PREFIXES[0] else np.arange(len(start))
            texts.append(text[shown])
            out.append((mixed(h[shown]) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(texts), np.concatenate(out)


@dataclass
class Block:
    """Postings of some examples: ``row`` of each gram among ``dense`` (or -1), the others from ``begin`` on."""

    row: np.ndarray
    dense: np.ndarray
    begin: np.ndarray
    post: np.ndarray
    weight: np.ndarray

    def cosines(self, g: np.ndarray, w: np.ndarray) -> np.ndarray:
        at = self.row[g]
        full = at >= 0
        out = w[full] @ self.dense[at[full]]
        g, w = g[~full], w[~full]
        first, size = self.begin[g], self.begin[g + 1] - self.begin[g]
        held = size > 0
        if held.any():
            first, size, w = first[held], size[held], w[held]
            at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            out = out + np.bincount(self.post[at], weights=np.repeat(w, size) * self.weight[at], minlength=len(out))
        return out


@dataclass
class Index:
    weights: np.ndarray  # [2^BITS] of a gram, without its count
    rate: float = 0.0  # of toxic rows in the sample
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # doc_id of each example
    toxic: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    blocks: list[Block] = field(default_factory=list)
    number: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))  # of a gram in the examples, or -1
    top: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.float32))  # [numbers, blocks] largest weight
    votes: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))  # of the calibration, rising
    chances: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))  # what each vote means

    def vector(self, grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grams that examples have, as numbers, and their weights in the text's vector of unit length."""
        w = (1 + np.log(counts)) * self.weights[grams]
        w = (w / max(np.sqrt((w * w).sum()), 1e-30)).astype(np.float32)
        known = self.number[grams]
        return known[known >= 0], w[known >= 0]

    def nearest(self, f: np.ndarray, w: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k largest cosines above 0 as (cosine, example), ties by example."""
        if not len(f):
            return []
        bound = w @ self.top[f]
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or (len(best) == k and bound[block] * (1 + 1e-5) < best[-1][0]):
                break
            sums = self.blocks[block].cosines(f, w)
            least = best[-1][0] if len(best) == k else 0.0
            if len(sums) > k:
                least = max(least, float(np.partition(sums, -k)[-k]))
            own = np.flatnonzero((sums >= least) & (sums > 0))
            best = sorted(best + [(float(sums[i]), block * BLOCK + int(i)) for i in own], key=lambda p: (-p[0], p[1]))[:k]
        return best

    def vote(self, f: np.ndarray, w: np.ndarray, k: int) -> tuple[float | None, list[int]]:
        """The k nearest's share of toxic ones, weighed by cosine (None: there is no neighbour), and their ids."""
        found = self.nearest(f, w, k)
        if not found:
            return None, []
        c = np.array([x for x, _ in found])
        y = self.toxic[[i for _, i in found]]
        return float((c * y).sum() / c.sum()), [int(self.ids[i]) for _, i in found[:3]]

    def score(self, f: np.ndarray, w: np.ndarray, k: int) -> tuple[float, list[int]]:
        v, ids = self.vote(f, w, k)
        return (self.rate if v is None else float(np.interp(v, self.votes, self.chances))), ids


def originals(own: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which texts aren't near copies of earlier ones: fewer than five of eight least hashes in common with any."""
    seen: dict[tuple[int, int], int] = {}
    out = np.ones(len(own), dtype=bool)
    for i, (g, _) in enumerate(own):
        minima = [(k, int(mixed(g.astype(np.uint64) + np.uint64(k << 32)).min())) for k in range(8)] if len(g) else []
        first = Counter(seen.setdefault(m, i) for m in minima)
        out[i] = not any(n >= 5 for j, n in first.items() if j != i)
    return out


def leaning(own: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Weights of all features: inverse document frequency times the lean to toxic.

    Near copies are counted once, as they say nothing new.
    """
    n, size = [np.zeros(1 << BITS), np.zeros(1 << BITS)], [0, 0]
    for (g, _), label, new in zip(own, y.tolist(), originals(own), strict=True):
        if new:
            n[label][g] += 1
            size[label] += 1
    odds = [np.log((n[k] + 0.5) / (size[k] - n[k] + 0.5)) for k in (0, 1)]
    sure = odds[1] - odds[0] - SURE * np.sqrt(1 / (n[1] + 0.5) + 1 / (n[0] + 0.5))
    return (np.log((1 + sum(size)) / (1 + n[0] + n[1])) + 1) * (1 + LEAN * np.maximum(sure - LEAST, 0))


def alike(own: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """An order of examples in which similar ones are near: median splits along principal directions."""
    sketch = np.zeros((len(own), 64), np.float64)
    for k, (g, c) in enumerate(own):
        w = (1 + np.log(c)) * weights[g]
        sign = np.where(mixed(g.astype(np.uint64)) & np.uint64(1), 1.0, -1.0)
        sketch[k] = np.bincount(g % 64, weights=sign * w / max(np.sqrt((w * w).sum()), 1e-30), minlength=64)

    def split(rows: np.ndarray) -> np.ndarray:
        if len(rows) <= BLOCK:
            return np.sort(rows)
        x = sketch[rows] - sketch[rows].mean(axis=0)
        axis = np.linalg.eigh(x.T @ x)[1][:, -1]
        rows = rows[np.argsort(x @ axis, kind="stable")]
        half = -(-len(rows) // (2 * BLOCK)) * BLOCK  # whole blocks on the left
        return np.concatenate([split(rows[:half]), split(rows[half:])])

    return split(np.arange(len(own)))


def chosen(keys: np.ndarray, y: np.ndarray, per_label: int) -> np.ndarray:
    """Up to ``per_label`` rows of each label, by hash; a quarter of a label's rows, at least, isn't taken."""
    out = []
    for label in (0, 1):
        rows = np.flatnonzero(y == label)
        rows = rows[np.argsort(keys[rows], kind="stable")]
        out.append(rows[: min(per_label, -(-3 * len(rows) // 4))])
    return np.sort(np.concatenate(out))


def rising(v: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of labels on votes by pooling neighbours: knots for interpolation."""
    votes, at = np.unique(v, return_inverse=True)
    mass, hits = np.bincount(at, weights=weight), np.bincount(at, weights=weight * y)
    pools: list[tuple[float, float, float]] = []  # sums of weights, of weighted labels, of weighted votes
    for one in zip(mass.tolist(), hits.tolist(), (mass * votes).tolist(), strict=True):
        pools.append(one)
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last, before = pools.pop(), pools.pop()
            pools.append(tuple(a + b for a, b in zip(before, last, strict=True)))
    total, labels, sums = (np.array(x) for x in zip(*pools, strict=True))
    return sums / total, labels / total


def fitted(ids: list[int], texts: list[str | None], toxic: list[int], per_label: int = 750, k: int = 25) -> Index:
    """The index and its calibration from a sample of labelled rows."""
    y = np.array(toxic, dtype=np.int64)
    own = list(text_features(texts))
    keys = mixed(np.array(ids, dtype=np.int64).view(np.uint64) + np.uint64(17))
    rows = chosen(keys, y, per_label)
    index = Index(leaning([own[i] for i in rows], y[rows]) if len(y) else np.ones(1 << BITS), float(y.mean()) if len(y) else 0.0)
    index.number = np.full(1 << BITS, -1, np.int32)
    if not len(y):
        return index
    rows = rows[alike([own[i] for i in rows], index.weights)]
    index.ids, index.toxic = np.array(ids, dtype=np.int64)[rows], y[rows]
    names = np.unique(np.concatenate([own[i][0] for i in rows]))
    index.number[names] = np.arange(len(names))
    vectors = [index.vector(*own[i]) for i in rows]
    index.top = np.zeros((len(names), -(-len(rows) // BLOCK)), np.float32)
    for b in range(index.top.shape[1]):
        part = vectors[b * BLOCK : (b + 1) * BLOCK]
        index.blocks.append(made(part, len(names)))
        for f, w in part:
            index.top[f, b] = np.maximum(index.top[f, b], w)
    # Votes of rows that aren't examples tell what a vote means; with none of a label, the examples' own do.
    rest = np.setdiff1d(np.arange(len(y)), rows)
    if len(set(y[rest].tolist())) < len(set(y.tolist())):
        rest = np.arange(len(y))
    found = [(v, y[i]) for i in rest if (v := index.vote(*index.vector(*own[i]), k)[0]) is not None]
    if found:
        v, label = (np.array(x, dtype=np.float64) for x in zip(*found, strict=True))
        share = label.mean()
        weight = np.where(label > 0, index.rate / max(share, 1e-9), (1 - index.rate) / max(1 - share, 1e-9))
        index.votes, index.chances = rising(v, label, weight)
    return index


def made(part: list[tuple[np.ndarray, np.ndarray]], names: int) -> Block:
    f = np.concatenate([f for f, _ in part])
    w = np.concatenate([w for _, w in part])
    at = np.repeat(np.arange(len(part)), [len(f) for f, _ in part])
    n = np.bincount(f, minlength=names)
    often = np.flatnonzero(n >= DENSE)
    row = np.full(names, -1, np.int32)
    row[often] = np.arange(len(often))
    dense = np.zeros((len(often), len(part)), np.float32)
    full = row[f] >= 0
    dense[row[f[full]], at[full]] = w[full]
    f, w, at = f[~full], w[~full], at[~full]
    order = np.argsort(f, kind="stable")
    begin = np.searchsorted(f[order], np.arange(names + 1)).astype(np.int32)
    return Block(row, dense, begin, at[order].astype(np.int16), w[order])


def sample(docs: DataFrame, labels: DataFrame, most: int, most_bytes: int) -> list:
    """(doc_id, text, toxic) of labelled rows that are not held out, chosen by hash: at most ``most``
    rows and ``most_bytes`` of text. Only ids and lengths come to the driver before the choice."""
    own = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = most / max(own.count(), 1)
    key = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    near = own.filter(key < share * 1.2 + 1e-6).select("doc_id", "toxic", key.alias("_k"))
    one = docs.select("doc_id", "text").join(near, "doc_id")
    sizes = one.select("doc_id", "_k", F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).orderBy("_k", "doc_id", "n").limit(2 * most).collect()
    ids, left, seen = [], most_bytes, set()
    for r in sizes:
        if len(ids) < most and r["n"] <= left and r["doc_id"] not in seen:
            ids.append(r["doc_id"])
            seen.add(r["doc_id"])
            left -= r["n"]
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id bigint")
    rows = one.join(F.broadcast(wanted), "doc_id", "left_semi").filter(F.octet_length(F.coalesce("text", F.lit(""))) <= most_bytes)
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()


OUT = "doc_id bigint, held_out boolean, score double, predicted int, evidence array<bigint>"


def scored(docs: DataFrame, index: Index, k: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, {}
        for batch in batches:
            found = []
            for grams, counts in text_features(batch.column("text").to_pylist()):
                name = hash((grams.tobytes(), counts.tobytes())), len(grams)
                if name not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[name] = own.score(*own.vector(grams, counts), k)
                found.append(known[name])
            score = np.clip([x for x, _ in found], 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(score, pa.float64()),
                    pa.array((score >= 0.5).astype(np.int32), pa.int32()),
                    pa.array([x for _, x in found], pa.list_(pa.int64())),
                ],
                names=["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, OUT)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 10_000, most_bytes: int = 48 << 20, per_label: int = 750, k: int = 25) -> DataFrame:
    """Learns from labels of rows whose crc32 of the id modulo 5 is not 0, and scores all rows."""
    marked = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"))
    rows = sample(docs, labels, most, most_bytes)
    index = fitted([r["doc_id"] for r in rows], [r["text"] for r in rows], [r["toxic"] for r in rows], per_label, k)
    return scored(marked, index, k)


def digest(d: DataFrame) -> DataFrame:
    return d
