"""Word and n-gram hashes in numpy, for the operators that run on Arrow batches."""

from __future__ import annotations

import numpy as np


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which near values go far apart."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs(x: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of all runs of k values, built from runs of 1, 2, 4 ... values."""
    n = len(x) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, done, part, size = np.zeros(n, dtype=np.uint64), 0, x, 1
    while done < k:
        if k & size:
            out += part[done : done + n] * np.uint64(pow(base, done, 1 << 64))
            done += size
        if done < k:
            part = part[:-size] + part[size:] * np.uint64(pow(base, size, 1 << 64))
            size *= 2
    return out


_random = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and which bytes part words: space and U+0009 to U+000D.
BYTES = _random.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


BASE = 0xA0761D6478BD642F
#: Bytes of text hashed at once. A word that is longer is hashed in one piece.
CHUNK = 1 << 18
_powers = [np.ones(1, dtype=np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of BASE and of its inverse; those of a chunk are kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, out=x))
    if n <= CHUNK + 1:
        _powers[:] = out
    return out[0], out[1]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes, last two bytes) of the words of a piece that no word crosses."""
    edge = np.diff(np.concatenate(([True], BLANK[raw], [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(BYTES[raw] * up[: len(raw)], out=sums[1:])
    last = raw[ends - 1].astype(np.int64) | np.where(ends - starts > 1, raw[ends - 2], 0).astype(np.int64) << 8
    return starts, mixed((sums[ends] - sums[starts]) * down[starts]), last


class Words:
    """Words of a list of UTF-8 texts, side by side: 64-bit hashes, and which text each is in."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        parts, at = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))], 0
        while at < len(raw):
            end = min(at + CHUNK, len(raw))
            while end < len(raw) and not BLANK[raw[end - 1]]:  # on to the end of the last word
                step = raw[end : end + CHUNK]
                blank = np.flatnonzero(BLANK[step])
                end += int(blank[0]) + 1 if len(blank) else len(step)
            starts, hashes, last = word_hashes(raw[at:end])
            parts.append((starts + at, hashes, last))
            at = end
        starts, self.hashes, self.last_bytes = (np.concatenate(x) for x in zip(*parts, strict=True))
        after = np.cumsum([len(t) + 1 for t in texts])
        self.ends = np.searchsorted(starts, after)  # of each text, in words
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        self.counts = self.ends - self.starts
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), self.counts)  # of each word

    def whole(self, k: int) -> np.ndarray:
        """For each start of k consecutive words, whether they are of one text."""
        n = len(self.text) - k + 1
        return self.text[:n] == self.text[k - 1 :] if n > 0 else np.empty(0, dtype=bool)


def pieces(texts: list[bytes], most: int = 1 << 19):
    """(from, to) of runs of texts of about ``most`` bytes, one text at least."""
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, k
            at, size = k, 0
        size += len(t)
    if len(texts) > at:
        yield at, len(texts)


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def least_places(h: np.ndarray, window: int) -> np.ndarray:
    """For every ``window`` consecutive values, the place of the leftmost least one."""
    if len(h) < window:
        return np.empty(0, dtype=np.int64)
    if len(h) > 1 << 24:
        return np.lib.stride_tricks.sliding_window_view(h, window).argmin(axis=1) + np.arange(len(h) - window + 1)
    # 40 bits of the value above 24 of the place: minima of runs of 2, 4, 8 ... and then of all.
    low = (np.arange(len(h), dtype=np.uint64)) | ((h >> np.uint64(24)) << np.uint64(24))
    size = 1
    while 2 * size <= window:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if size < window:
        low = np.minimum(low[: len(h) - window + 1], low[window - size :])
    return (low & np.uint64((1 << 24) - 1)).astype(np.int64)
