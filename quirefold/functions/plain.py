"""Text functions on Python strings, for the steps that run as folds over Arrow batches.

They agree with the columns of the same meaning in ``functions.text``.
"""

from __future__ import annotations

import re
from functools import lru_cache

from quirefold.functions.text import mojibake_pairs

CONTROL = re.compile(r"[\x00-\x1f\x7f]")
TAG = re.compile(r"<[^>]+>")
HAS_TEXT = re.compile(r"[^\s\x00-\x1f\x7f\ufffc]")
#: A-Z in lower case, a-z and 0-9 as they are, all other bytes as spaces.
KEY_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: What else has an ASCII letter in its lower case.
LOWERED = ("\u0130", "i\u0307"), ("\u212a", "k")


def clean(s: str | None) -> str:
    return " ".join(CONTROL.sub(" ", (s or "").replace("\x00", "").replace("￼", "")).split())


def has_text(s: str) -> bool:
    """Whether ``clean`` leaves anything; looks no further than the first character that stays."""
    return HAS_TEXT.search(s) is not None


@lru_cache(maxsize=4096)
def key(s: str) -> str:
    """The comparison key: tags dropped, lower case, only a-z and 0-9."""
    s = s.replace("\x00", "")
    if not s.isascii():
        s = s.replace("\ufffc", "")
        for c, low in LOWERED:
            s = s.replace(c, low)
    s = TAG.sub(" ", s) if "<" in s else s
    return b" ".join(s.encode("ascii", "replace").translate(KEY_BYTES).split()).decode()


@lru_cache
def garbled_starts(compat: bool) -> frozenset[str]:
    return frozenset(bad[0] for bad, _ in mojibake_pairs(compat))


def repaired(s: str, compat: bool = False) -> str:
    if not any(c in s for c in garbled_starts(compat)):
        return s
    for bad, good in mojibake_pairs(compat):
        if bad in s:
            s = s.replace(bad, good)
    return s


def paragraphs(text: str) -> list[str]:
    """Paragraphs with something in them, as they stand."""
    return [p for p in text.split("\n\n") if p.strip()]
