"""Language ID of mixed-language text: scripts, per-word scores, and Viterbi with a switching cost.

A model is learned from labelled texts: per language, log shares of hashed character n-grams (1 to 4
characters, word ends marked) and the scripts that it is written in. To label a text, every word
(a run of letters) gets the languages that its script leaves, its n-gram score in each, and a
Viterbi pass over the words chooses the best labels when each change costs ``switch``. Runs of one
label are spans. The language of the whole text is the one with most letters; its score is the mean,
over that language's letters, of the word's posterior among the languages, times their share.

Scoring is numpy over batches: n-grams of all texts at once, the Viterbi steps of many texts side by
side. The model is learned from at most ``per_lang`` labelled rows of a language, chosen by hash.

Edge cases: null text, or one without a letter, is ``und`` with score 0; with nothing to learn from
every text is ``und``; words in a script that no learned language uses keep all languages; repeated
rows are labelled alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import crc_mod, small
from quirefold.llm.hashing import mixed

#: First code points of ranges of scripts, in order (fixed values); "" ends a range.
SCRIPTS = (
    (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x700, ""), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, ""),
    (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, ""), (0xE00, "thai"),
    (0xE80, ""), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1400, ""), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"),
    (0xD7B0, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, ""), (0x20000, "han"), (0x30000, ""),
)
FIRST = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({s for _, s in SCRIPTS})
SCRIPT = np.array([NAMES.index(s) for _, s in SCRIPTS], dtype=np.int8)
BITS = 18  # of an n-gram's hash
GRAMS = (1, 2, 3, 4)
PART = 1 << 20  # characters worked on at once
BLANK = re.compile(r"\s")
LETTER = np.array([chr(i).isalpha() for i in range(0x30000)])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # [2^BITS, langs] log share of a hashed n-gram
    scripts: np.ndarray  # [scripts, langs] whether the language uses it


class Texts:
    """Letters of texts side by side, in words."""

    def __init__(self, texts: list[str]):
        joined = "\n" + "\n".join(texts).lower() + "\n"  # a mark before each word, the first one's too
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = LETTER[np.minimum(self.points, len(LETTER) - 1)] & (self.points < len(LETTER))
        edge = np.diff(np.concatenate(([False], letter)).view(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        after = 1 + np.cumsum([len(t.lower()) + 1 for t in texts])
        self.counts = np.diff(np.concatenate(([0], np.searchsorted(self.starts, after))))
        self.letters = self.ends - self.starts
        place = np.searchsorted(FIRST, self.points[self.starts], side="right") - 1
        self.script = np.where(place >= 0, SCRIPT[np.maximum(place, 0)], NAMES.index(""))
        # With one mark on each side, words are runs of letters and n-grams stay inside a run.
        self.run = np.where(letter, self.points, 0).astype(np.uint64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, and for each word its first and one past its last) of n-grams that begin at
        the mark before the word or later and end at the mark after it or earlier."""
        x = self.run
        size = len(x) - n + 1
        h = np.zeros(max(size, 0), dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + x[k : k + size]
        h = (mixed(h * np.uint64(8) + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32)
        lo = np.maximum(self.starts - (n > 1), 0)
        hi = np.minimum(self.ends + (n > 1) - n + 1, size)
        return h, lo, np.maximum(hi, lo)


def learned(rows: list[tuple[str, str]], smooth: float = 0.5) -> Model:
    """From (text, lang) rows."""
    langs = sorted({lang for _, lang in rows})
    counts = np.zeros((len(langs), 1 << BITS), dtype=np.float64)
    scripts = np.zeros((len(NAMES), len(langs)), dtype=np.float64)
    for k, lang in enumerate(langs):
        t = Texts([text for text, own in rows if own == lang])
        for n in GRAMS:
            h, lo, hi = t.grams(n)
            inside = np.zeros(len(h) + 1, dtype=np.int32)
            np.add.at(inside, lo, 1)
            np.add.at(inside, hi, -1)
            counts[k] += np.bincount(h, weights=(np.cumsum(inside[:-1]) > 0), minlength=1 << BITS)
        scripts[:, k] = np.bincount(t.script, weights=t.letters, minlength=len(NAMES))
    shares = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * (1 << BITS)))
    used = scripts >= np.maximum(scripts.sum(axis=0, keepdims=True) * 0.01, 1)
    used[~used.any(axis=1)] = True
    return Model(langs, np.ascontiguousarray(shares.T.astype(np.float32)), used)


def word_scores(t: Texts, model: Model) -> np.ndarray:
    """[word, lang]: mean n-gram log share, weighed by length; -1e4 where the script says no."""
    out = np.zeros((len(t.starts), len(model.langs)), dtype=np.float32)
    if not len(t.starts):
        return out
    for n in GRAMS:
        h, lo, hi = t.grams(n)
        for k in range(len(model.langs)):
            sums = np.concatenate(([0.0], np.cumsum(model.table[h, k], dtype=np.float64)))
            out[:, k] += sums[hi] - sums[lo]
    return out / len(GRAMS) + np.where(model.scripts[t.script], 0.0, -1e4).astype(np.float32)


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word; texts of ``counts`` words lie one after another.

    Texts are stepped side by side, longest first, so the ones still running are a prefix.
    """
    labels = np.zeros(len(scores), dtype=np.int32)
    order = np.argsort(-counts, kind="stable")
    start = (np.cumsum(counts) - counts)[order]
    size = counts[order]
    running = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    stay = np.zeros(scores.shape, dtype=bool)
    come = np.zeros(len(scores), dtype=np.int32)
    best: np.ndarray | None = None
    final = np.zeros((len(size), scores.shape[1]), dtype=np.float32)
    for step, n in enumerate(running):
        at = start[:n] + step
        if best is None:
            best = scores[at].copy()
        else:
            best = best[:n]
            top = best.argmax(axis=1)
            other = best[np.arange(n), top][:, None] - switch
            keep = best >= other
            stay[at], come[at] = keep, top
            best = np.where(keep, best, other) + scores[at]
        best -= best.max(axis=1, keepdims=True)
        final[:n] = best
    state = final.argmax(axis=1).astype(np.int32)
    for step in range(len(running) - 1, -1, -1):
        n = running[step]
        at = start[:n] + step
        own = state[:n]
        labels[at] = own
        state[:n] = np.where(stay[at, own], own, come[at]) if step else own
    return labels


def cut(text: str) -> list[str]:
    """Pieces of about PART characters that end at a blank, so no word is cut."""
    out, at = [], 0
    while len(text) - at > PART:
        blank = BLANK.search(text, at + PART)
        end = blank.end() if blank else len(text)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def runs(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts, in order, some PART characters at a time."""
    own, size = [], 0
    for t in texts:
        if own and size + len(t or "") > PART:
            yield own
            own, size = [], 0
        own.append(t or "")
        size += len(t or "")
    if own:
        yield own


def label_texts(texts: list[str | None], model: Model, switch: float) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans) of each text; spans are (first word, one past the last, language)."""
    for part in runs(texts):
        yield from label_run(part, model, switch) if model.langs else [("und", 0.0, [])] * len(part)


def label_run(texts: list[str], model: Model, switch: float) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    pieces = [cut(t) for t in texts] if sum(map(len, texts)) > PART else [[t] for t in texts]
    lengths, found, sizes = [], [], []
    for own in runs([p for x in pieces for p in x]):
        t = Texts(own)
        found.append(word_scores(t, model))
        lengths.append(t.letters)
        sizes.append(t.counts)
    scores, letters_of = np.concatenate(found), np.concatenate(lengths)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in pieces])
    counts = np.bincount(owner, weights=np.concatenate(sizes), minlength=len(texts)).astype(np.int64)
    labels = viterbi(scores, counts, switch)
    shares = np.exp(np.minimum(scores - scores.max(axis=1, keepdims=True), 0)) if len(scores) else scores
    own = shares[np.arange(len(labels)), labels] / shares.sum(axis=1) if len(scores) else np.empty(0)
    at = 0
    for n in counts.tolist():
        label, letters, sure = labels[at : at + n], letters_of[at : at + n], own[at : at + n]
        at += n
        if not n:
            yield "und", 0.0, []
            continue
        by = np.bincount(label, weights=letters, minlength=len(model.langs))
        lang = int(by.argmax())
        score = float((sure * letters)[label == lang].sum() / letters.sum())
        edge = np.flatnonzero(np.diff(label)) + 1
        edges = [0, *edge.tolist(), n]
        yield model.langs[lang], min(max(score, 0.0), 1.0), [
            (s, e, model.langs[label[s]]) for s, e in zip(edges, edges[1:], strict=False)
        ]


def sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """(text, lang): of each language the ``per_lang`` labelled rows with the least hash, at most.

    Hashes below a bound from the language's count come first, so few rows reach the ranking.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = small(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), 10_000)
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    near = rows.join(sizes, "lang").withColumn("_k", key).filter(F.col("_k") * F.col("_n") <= 1.2 * per_lang + 30)
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_k", "doc_id")))
    return ranked.filter(F.col("_r") <= per_lang).select("text", "lang")


OUT = "doc_id bigint, held_out boolean, lang_pred string, score double, n_spans bigint, spans array<struct<first:int,last:int,lang:string>>"


def identify(docs: DataFrame, model: Model, switch: float = 6.0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans, spans) for each row of (doc_id, held_out, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(label_texts(batch.column("text").to_pylist(), shared.value, switch))
            spans = [[dict(zip(("first", "last", "lang"), s, strict=True)) for s in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([len(s) for s in spans], pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "n_spans", "spans"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, OUT)


def language(docs: DataFrame, per_lang: int = 400, switch: float = 6.0) -> DataFrame:
    """Learns from rows whose crc32 of the id modulo 4 is not 2, and labels all rows."""
    marked = docs.withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)
    rows = sample(marked.filter(~F.col("held_out")), per_lang).collect()
    model = learned([(r["text"], r["lang"]) for r in rows])
    return identify(marked, model, switch)


def digest(d: DataFrame) -> DataFrame:
    return d.select("doc_id", "held_out", "lang_pred", "score", "n_spans")

