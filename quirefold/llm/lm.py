"""LM scoring: a gated recurrent model in numpy, with a class-factored output.

Symbols are the most frequent words of all training texts, the end of a text, and classes of all
other words by their last two bytes. A GRU reads symbols; the output layer gives the class first,
then the word in its class. A word outside the vocabulary has its class's probability times its
smoothed share of that class in the whole training corpus, so the model is a distribution over all
words. It is trained by truncated backpropagation over windows, the state carried from window to
window; a text is scored from its first word to its end with the state carried throughout.

Every training row is trained on, in rounds of rows chosen by hash: about ``most`` rows first, each
round ``GROWTH`` times as many as all before it, less those. A round's rows are dealt into shards of
about ``block_bytes`` of text; each shard trains a copy of the network, and the mean of the copies, weighted
by their symbols, goes on to the next round. The network has a fixed size; nothing else of training
comes to the driver.

Corpus counts cover every text: documents are dealt into blocks by hash, each block asks for its
distinct words once (with its own training counts), buckets by word hash add these up and answer
each block in the order asked. Words are known by 64-bit hashes. Only totals, the words of the
vocabulary and sums by suffix come to the driver.

Edge cases: null or empty text is its end alone; no training rows give counts of 0 and a model that
knows no word; repeated rows count and are scored each; a null doc_id counts as the empty text in
the split; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import crc_mod, partitions, stored, volume
from quirefold.llm.hashing import Words, pieces

ALPHA = 0.1  # of the counts' smoothing
GROWTH = 8  # of the rows trained on, from round to round
CHUNK = 8192  # states scored at once
SPREAD = 60.0  # of logits whose powers of e are all exact enough in single precision
PIECES = 16  # of a network's numbers, at least; each is averaged in one task
ASK = "bucket int, _b bigint, h binary, c binary, k binary"
COUNTS = (
    "bucket int, _b bigint, c binary, n bigint, v bigint, sk array<bigint>, sn array<bigint>, sv array<bigint>, "
    "wh array<bigint>, wk array<bigint>, wn array<bigint>"
)
COPY = "piece int, shard bigint, n bigint, p binary"
MEAN = "piece int, p binary"
OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


@dataclass
class Vocabulary:
    """Symbols: 0 is the end, then words by class, then a symbol for each class of other words."""

    words: np.ndarray  # sorted hashes
    symbol: np.ndarray  # of each of these
    classes: int  # of words; class 0 holds the end too
    width: int  # symbols in a class of words
    suffix: np.ndarray  # [65536] class of other words by the last two bytes

    @property
    def others(self) -> int:
        return int(self.suffix.max()) + 1

    @property
    def size(self) -> int:
        return self.classes * self.width + self.others

    def symbols(self, w: Words, ends: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.words, w.hashes), max(len(self.words) - 1, 0))
        other = self.classes * self.width + self.suffix[ends]
        return np.where(self.words[k] == w.hashes, self.symbol[k], other) if len(self.words) else other


def fitted_vocabulary(
    hashes: np.ndarray, ends: np.ndarray, classes: int = 24, width: int = 32, suffixes: int = 40,
    counts: np.ndarray | None = None, share: np.ndarray | None = None,
) -> Vocabulary:
    """From words, each ``counts`` times; ``share`` is all words' number by suffix, if these aren't all."""
    counts = np.ones(len(hashes), np.int64) if counts is None else counts
    share = np.bincount(ends, weights=counts, minlength=65536).astype(np.int64) if share is None else share.copy()
    names, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    sums = np.bincount(inverse, weights=counts, minlength=len(names)).astype(np.int64)
    top = np.argsort(-sums, kind="stable")[: classes * width - 1]
    top = top[sums[top] > 1]
    known = names[top]
    order = np.argsort(known)
    np.subtract.at(share, ends[first[top]], sums[top])
    suffix = np.full(65536, 0, dtype=np.int64)
    best = np.argsort(-share, kind="stable")[: suffixes - 1]
    suffix[best[share[best] > 0]] = np.arange(1, 1 + int((share[best] > 0).sum()))
    # Class by frequency: neighbours in rank share a class.
    return Vocabulary(known[order], (np.arange(len(top)) + 1)[order], classes, width, suffix)


@dataclass
class Gru:
    voc: Vocabulary
    hidden: int
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.p:
            rng, h, v = np.random.default_rng(5), self.hidden, self.voc
            w = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
            self.p = {
                "E": w(v.size, 3 * h), "U": w(h, 3 * h), "Wc": w(h, v.classes + v.others),
                "bc": np.zeros(v.classes + v.others, np.float32), "Ww": w(v.classes, h, v.width), "bw": np.zeros((v.classes, v.width), np.float32),
            }

    def step(self, state: np.ndarray, x: np.ndarray):
        """States [hidden, stream] after symbols whose rows of E are ``x`` [3 * hidden, stream], which is used up.

        Streams lie side by side, so each gate is one run of memory.
        """
        h = self.hidden
        u = self.p["U"].T @ state
        gates, new = x[: 2 * h], x[2 * h :]
        gates += u[: 2 * h]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        new += gates[:h] * u[2 * h :]
        np.tanh(new, out=new)
        after = new - state
        after *= gates[h:]
        after += state
        return after, gates, new, u[2 * h :]

    def log_probs(self, states: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Natural log P(symbol | state); with ``grads``, also adds gradients and returns dstates.

        Rows are put in order of their class once, so that each class of words is a slice.
        """
        v, p, n = self.voc, self.p, len(target)
        inside = target < v.classes * v.width
        cls = np.where(inside, target // v.width, v.classes + target - v.classes * v.width)
        order = sorted_order(cls)
        states, target, cls = states[order], target[order], cls[order]
        logs, e = softmax(states @ p["Wc"] + p["bc"], cls, grads is not None)
        back = None
        if grads is not None:
            e[np.arange(n), cls] -= 1
            grads["Wc"] += states.T @ e
            grads["bc"] += e.sum(axis=0)
            back = e @ p["Wc"].T
        edges = np.searchsorted(cls, np.arange(v.classes + 1))
        for c in range(v.classes):
            own = slice(edges[c], edges[c + 1])
            if edges[c] == edges[c + 1]:
                continue
            s, word = states[own], target[own] - c * v.width
            more, e = softmax(s @ p["Ww"][c] + p["bw"][c], word, grads is not None)
            logs[own] += more
            if grads is not None:
                e[np.arange(len(word)), word] -= 1
                grads["Ww"][c] += s.T @ e
                grads["bw"][c] += e.sum(axis=0)
                back[own] += e @ p["Ww"][c].T
        out = np.empty_like(logs)
        out[order] = logs
        if back is not None:
            unsorted = np.empty_like(back)
            unsorted[order] = back
            back = unsorted
        return out, back

    def window(self, state: np.ndarray, symbols: np.ndarray, fresh: np.ndarray, live: np.ndarray | None = None):
        """One step of training on symbols [time, stream]: (loss, gradients, state after).

        ``fresh`` marks the first symbol of a text, before which the state is zero. Symbols that
        aren't ``live`` pad the ends of streams and count for nothing.
        """
        h, p, (n, streams) = self.hidden, self.p, symbols.shape
        grads = {k: np.zeros_like(x) for k, x in p.items()}
        side = lambda x: np.ascontiguousarray(x.reshape(n, streams, -1).transpose(0, 2, 1))
        rows = lambda x: x.transpose(0, 2, 1).reshape(n * streams, -1)
        read, state = side(p["E"][symbols]), state.T
        prev, uc = (np.empty((n, h, streams), read.dtype) for _ in range(2))
        for t in range(n):
            prev[t] = np.where(fresh[t], np.float32(0), state)
            state, _, _, uc[t] = self.step(prev[t], read[t])
        r, z, new = read[:, :h], read[:, h : 2 * h], read[:, 2 * h :]
        before = rows(prev)
        if live is None or live.all():
            logs, dh = self.log_probs(before, symbols.reshape(-1), grads)
        else:
            at, dh = np.flatnonzero(live), np.zeros_like(before)
            logs, dh[at] = self.log_probs(before[at], symbols.reshape(-1)[at], grads)
        dh, by_new, by_z, by_r = side(dh), z * (1 - new * new), (new - prev) * z * (1 - z), uc * r * (1 - r)
        dx, du = (np.empty_like(read) for _ in range(2))
        carry = np.zeros_like(dh[0])
        for t in range(n - 1, -1, -1):
            dr, dz, dnew = dx[t, :h], dx[t, h : 2 * h], dx[t, 2 * h :]
            np.multiply(carry, by_new[t], out=dnew)
            np.multiply(carry, by_z[t], out=dz)
            np.multiply(dnew, by_r[t], out=dr)
            du[t, : 2 * h] = dx[t, : 2 * h]
            np.multiply(dnew, r[t], out=du[t, 2 * h :])
            carry -= carry * z[t]
            carry += p["U"] @ du[t]
            carry += dh[t]
            carry[:, fresh[t]] = 0
        grads["U"] += before.T @ rows(du)
        order = sorted_order(symbols.reshape(-1))
        names, at = np.unique(symbols.reshape(-1)[order], return_index=True)
        grads["E"][names] = np.add.reduceat(rows(dx)[order], at)
        return -float(logs.sum()), grads, state.T

    def text_logs(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural log probability of each symbol of texts that lie one after another."""
        order = np.argsort(-counts, kind="stable")
        start, size = (np.cumsum(counts) - counts)[order], counts[order]
        longest = int(size[0]) if len(size) else 0
        running = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        out = np.empty(len(symbols), np.float64)
        state, states, places, held = np.zeros((self.hidden, len(size)), np.float32), [], [], 0
        for t, n in enumerate(running.tolist()):
            where = start[:n] + t
            state = state[:, :n]
            states.append(state)
            places.append(where)
            held += n
            if held >= CHUNK or t == longest - 1:  # a bounded number of states is held
                at = np.concatenate(places)
                out[at] = self.log_probs(np.concatenate(states, axis=1).T, symbols[at])[0]
                states, places, held = [], [], 0
            state = self.step(state, np.ascontiguousarray(self.p["E"][symbols[where]].T))[0]
        return out


def sorted_order(x: np.ndarray) -> np.ndarray:
    """Stable order of small numbers; 16 bits are sorted by their digits."""
    return np.argsort(x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x, kind="stable")


def softmax(logits: np.ndarray, target: np.ndarray, wanted: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(log probability of each row's target, probabilities if ``wanted``); logits are used up.

    Logits within ``SPREAD`` of each other, as they mostly are, are shifted by one value; else each row by its own largest.
    """
    most = logits.max(initial=-np.inf)
    logits -= most if most - logits.min(initial=np.inf) < SPREAD else logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(target)), target]
    e = np.exp(logits, out=logits)
    total = e @ np.ones(e.shape[1], e.dtype)
    if wanted:
        e /= total[:, None]
    return own - np.log(total), e if wanted else None


def trained(
    voc: Vocabulary, texts: list[np.ndarray], hidden: int = 16, streams: int = 32, window: int = 24, epochs: int = 3,
    start: Gru | None = None, rate: float = 0.02,
) -> Gru:
    """Adam over windows of parallel streams of whole texts (symbols, each with its end), from ``start``."""
    net = Gru(voc, hidden, {k: x.copy() for k, x in start.p.items()} if start else {})
    flat = np.concatenate(texts) if texts else np.empty(0, np.int64)
    if not len(flat):
        return net
    first = np.zeros(len(flat), dtype=bool)
    first[np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1]))] = True
    per = -(-len(flat) // (streams * window)) * window
    pad = np.zeros(per * streams - len(flat), dtype=np.int64)
    live = np.arange(per * streams) < len(flat)
    s, f, live = (x.reshape(streams, per).T for x in (np.concatenate((flat, pad)), np.concatenate((first, pad > 0)), live))
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    step, total = 0, epochs * (per // window)
    for _ in range(epochs):
        state = np.zeros((streams, hidden), np.float32)
        for k in range(0, per, window):
            step += 1
            own = live[k : k + window]
            _, grads, state = net.window(state, s[k : k + window], f[k : k + window], own)
            now = rate * (1 - 0.9 * step / total)
            for name, g in grads.items():
                g = np.clip(g / int(own.sum()) * 10, -1, 1)
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.01 * (g * g - v[name])
                net.p[name] -= now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)
    return net


END = np.uint64(0x9FB21C651E98DF25)  # stands for the end among word hashes


def tokens(texts: list[bytes | None], voc: Vocabulary | None = None):
    """(hashes, suffix keys, symbols or None, counts): each text's words and its end."""
    texts = [(t or b"").lower() for t in texts]
    hs, ks, ss, ns = [], [], [], []
    for s, e in pieces(texts):
        w = Words(texts[s:e])
        last = w.last_bytes
        at = w.ends  # an end goes after each text's words
        hs.append(np.insert(w.hashes, at, END))
        ks.append(np.insert(last, at, 0))
        if voc is not None:
            ss.append(np.insert(voc.symbols(w, last), at, 0))
        ns.append(w.counts + 1)
    cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    return cat(hs, np.uint64), cat(ks, np.int64), cat(ss, np.int64) if voc is not None else None, cat(ns, np.int64)


def distinct_by_bucket(h: np.ndarray, buckets: int):
    """(distinct hashes by bucket and value, where each is first, bucket of each, the place in them of each of ``h``)."""
    names, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    bucket = (names % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return names[order], first[order], bucket[order], place[inverse]


def ask_words(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        h, k, _, n = tokens(table["_t"].to_pylist())
        train = np.repeat(~np.array(table["held_out"].to_pylist(), dtype=bool), n)
        names, first, bucket, place = distinct_by_bucket(h, buckets)
        counts = np.bincount(place[train], minlength=len(names)).astype(np.int64)
        suffix = k[first].astype(np.uint16)
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        cut = lambda x: [x[s:e].tobytes() for s, e in zip(at, [*at[1:], len(x)], strict=True)]
        block = table["_b"][0].as_py()
        return pa.table({"bucket": pa.array(bucket[at], pa.int32()), "_b": pa.array([block] * len(at), pa.int64()), "h": pa.array(cut(names), pa.binary()), "c": pa.array(cut(counts), pa.binary()), "k": pa.array(cut(suffix), pa.binary())})

    return run


def add_up(most: int):
    """Sums by word; the first row also tells sums by suffix and the ``most`` most frequent words."""

    def run(table: pa.Table) -> pa.Table:
        get = lambda name, t: [np.frombuffer(x, dtype=t) for x in table[name].to_pylist()]
        h, c, k = get("h", np.uint64), get("c", np.int64), get("k", np.uint16)
        names, first, inverse = np.unique(np.concatenate(h), return_index=True, return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate(c), minlength=len(names)).astype(np.int64)
        seen = sums > 0
        word = np.flatnonzero(seen & (names != END))
        suffix = np.concatenate(k)[first].astype(np.int64)
        sk, at = np.unique(suffix[word], return_inverse=True)
        sn, sv = np.bincount(at, weights=sums[word]).astype(np.int64), np.bincount(at)
        top = word[np.argsort(-sums[word], kind="stable")[:most]]
        ends = np.cumsum([len(x) for x in h])
        out = [sums[inverse[e - len(x) : e]].tobytes() for x, e in zip(h, ends, strict=True)]
        rows, none = table.num_rows, [[]] * (table.num_rows - 1)
        first_only = lambda x: pa.array([int(x)] + [0] * (rows - 1), pa.int64())
        lists = {"sk": sk, "sn": sn, "sv": sv, "wh": names[top].view(np.int64), "wk": suffix[top], "wn": sums[top]}
        lists = {name: pa.array([x.tolist(), *none], pa.list_(pa.int64())) for name, x in lists.items()}
        return pa.table({"bucket": table["bucket"], "_b": table["_b"], "c": pa.array(out, pa.binary()), "n": first_only(sums.sum()), "v": first_only(seen.sum()), **lists})

    return run


def score_texts(shared, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        net, n_all, v_all, nk, vk = shared.value
        voc = net.voc
        h, k, symbols, sizes = tokens(table["_t"].to_pylist(), voc)
        _, _, bucket, place = distinct_by_bucket(h, buckets)
        by = dict(zip(answers["bucket"].to_pylist(), answers["c"].to_pylist(), strict=True))
        counts = np.concatenate([np.frombuffer(by[b], dtype=np.int64) for b in np.unique(bucket).tolist()])
        c = counts[place].astype(np.float64)
        base = np.log10((c + ALPHA) / (n_all + ALPHA * (v_all + 1)))
        logs = net.text_logs(symbols, sizes)
        other = symbols >= voc.classes * voc.width
        group = symbols[other] - voc.classes * voc.width
        logs[other] += np.log((c[other] + ALPHA) / (nk[group] + ALPHA * (vk[group] + 1)))
        starts = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table({"doc_id": table["doc_id"], "held_out": table["held_out"], "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(add((c > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(len(sizes), n_all), pa.int64()), "base_score": pa.array(add(base), pa.float64()), "score": pa.array(add(logs) / np.log(10), pa.float64())})

    return run


def corpus_vocabulary(counts: DataFrame, most: int) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The vocabulary of all training rows, and the other words' number and distinct ones by class."""
    by = counts.select(F.inline(F.arrays_zip("sk", "sn", "sv"))).groupBy("sk").agg(F.sum("sn"), F.sum("sv")).collect()
    share, kinds = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    for k, n, v in by:
        share[k], kinds[k] = n, v
    top = counts.select(F.inline(F.arrays_zip("wh", "wk", "wn"))).orderBy(F.desc("wn"), "wh").limit(most).collect()
    h, k, n = (np.array([r[i] for r in top], np.int64) for i in range(3))
    voc = fitted_vocabulary(h.view(np.uint64), k, counts=n, share=share)
    known = np.isin(h.view(np.uint64), voc.words)
    np.subtract.at(share, k[known], n[known])
    np.subtract.at(kinds, k[known], 1)
    nk, vk = (np.bincount(voc.suffix, weights=x, minlength=voc.others) for x in (share, kinds))
    return voc, nk, vk


def train_shard(shared, pieces_: int, streams: int, epochs: int, rate: float):
    """Trains a copy of the network on a shard's texts, in an order of their own."""

    def run(table: pa.Table) -> pa.Table:
        net = shared.value
        order = table.select(["doc_id", "_t"]).combine_chunks().sort_by([("doc_id", "ascending"), ("_t", "ascending")])
        _, _, symbols, sizes = tokens(order["_t"].to_pylist(), net.voc)
        texts = np.split(symbols, np.cumsum(sizes)[:-1])
        p = trained(net.voc, texts, net.hidden, streams, epochs=epochs, start=net, rate=rate).p
        flat = np.concatenate([p[k].reshape(-1) for k in sorted(p)])
        cuts = [x.tobytes() for x in np.array_split(flat, pieces_)]
        same = lambda x: pa.array([x] * pieces_, pa.int64())
        return pa.table({"piece": pa.array(range(pieces_), pa.int32()), "shard": same(table["_s"][0].as_py()), "n": same(len(symbols)), "p": pa.array(cuts, pa.binary())})

    return run


def mean_of_shards(table: pa.Table) -> pa.Table:
    table = table.sort_by("shard")  # so that sums don't depend on how rows are dealt
    total = 0.0
    for n, p in zip(table["n"].to_pylist(), table["p"], strict=True):
        total = total + n * np.frombuffer(p.as_py(), np.float32).astype(np.float64)
    out = (total / sum(table["n"].to_pylist())).astype(np.float32).tobytes()
    return pa.table({"piece": table["piece"][:1], "p": pa.array([out], pa.binary())})


def rounds(n: int, most: int) -> list[tuple[int, int]]:
    """(from, to) of the rows of each round; together they are all n rows."""
    edges = [0, most]
    while edges[-1] < n:
        edges.append(edges[-1] * GROWTH)
    edges[-1] = max(n, 1)
    return list(zip(edges[:-1], edges[1:], strict=True))


def network(docs: DataFrame, voc: Vocabulary, n: int, size: int, most: int, block_bytes: int, hidden: int) -> Gru:
    """The network after all rounds over the training rows."""
    spark, net = docs.sparkSession, Gru(voc, hidden)
    key = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / (1 << 30)
    rows = docs.filter(~F.col("held_out")).select("doc_id", "_t", (key * max(n, 1)).alias("_at"))
    for start, end in rounds(n, most):
        shards = max(1, -(-(end - start) * size // (max(n, 1) * block_bytes)))
        own = rows.filter((F.col("_at") >= start) & (F.col("_at") < end))
        own = own.select("doc_id", "_t", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(shards)).alias("_s"))
        shared, cuts = spark.sparkContext.broadcast(net), max(PIECES, shards // PIECES)
        learn = train_shard(shared, cuts, *((256, 1, 0.01) if start else (32, 3, 0.02)))
        copies = own.repartition(min(partitions(spark, end - start), shards), "_s").groupBy("_s").applyInArrow(learn, COPY)
        found = copies.groupBy("piece").applyInArrow(mean_of_shards, MEAN).orderBy("piece").collect()
        if found:  # a round may have no rows
            flat, at, p = np.concatenate([np.frombuffer(r["p"], np.float32) for r in found]), 0, {}
            for k in sorted(net.p):
                p[k] = flat[at : at + net.p[k].size].reshape(net.p[k].shape).copy()
                at += net.p[k].size
            net = Gru(voc, hidden, p)
        shared.unpersist()
    return net


def score(docs: DataFrame, most: int = 500, block_bytes: int = 12_000_000, hidden: int = 16) -> DataFrame:
    """One row per document row: counts, the smoothed unigram score and the model's; see OUT."""
    spark, (n, size) = docs.sparkSession, volume(docs)
    blocks, parts = max(1, -(-size // block_bytes)), partitions(docs.sparkSession, n)
    marked = docs.select("doc_id", F.col("text").cast("binary").alias("_t"), (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"))
    base = marked.withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).repartition(min(parts, max(blocks, 1)), "_b")
    asked = base.groupBy("_b").applyInArrow(ask_words(parts), ASK)
    words = 24 * 32 - 1  # of the vocabulary: its classes times their width, less the end
    counts = stored(asked.groupBy("bucket").applyInArrow(add_up(words), COUNTS), "counts")
    t = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v")]).first()
    voc, nk, vk = corpus_vocabulary(counts, words)
    net = network(marked, voc, n, size, most, block_bytes, hidden)
    shared = spark.sparkContext.broadcast((net, t["n"], t["v"], nk, vk))
    answers = counts.select("_b", "bucket", "c")
    return base.groupBy("_b").cogroup(answers.groupBy("_b")).applyInArrow(score_texts(shared, parts), OUT)
