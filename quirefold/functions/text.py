"""Scalar text functions. Patterns start with (?Ud): Unicode classes, and only \\n ends a line."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

U = "(?Ud)"
UM = "(?Udm)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, U + r"^\s+|\s+\z", "")


def kept_text(c: Column) -> Column:
    """Null is empty; NUL and U+FFFC go."""
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\x00"), F.lit("")), F.lit("\ufffc"), F.lit(""))


#: What may be white space other than a blank, a control, or a character that goes; one class of two ranges, so the test is cheap.
UNCLEAN = r"[\x00-\x1f\x7f-\xa0\x{1680}-\x{ffff}]"


def clean_line(c: Column | str) -> Column:
    """Null is empty; NUL and U+FFFC go; other controls are spaces; white space collapses.

    Most lines have single blanks alone and need no replacement, which costs several times the test.
    Columns given by name are tested first; an expression isn't, as it would be worked out again and again.
    """
    if isinstance(c, str):
        whole = F.col(c)
        return F.when(~whole.rlike(UNCLEAN) & ~F.contains(whole, F.lit("  ")), F.trim(whole)).otherwise(clean_line(whole))
    return F.trim(F.regexp_replace(kept_text(c), r"(?U)[\s\x01-\x1f\x7f]+", " "))


def has_text(c: Column) -> Column:
    """Whether ``clean_line`` leaves anything; looks no further than the first character that stays."""
    return F.coalesce(c, F.lit("")).rlike(r"(?U)[^\s\x00-\x1f\x7f\ufffc]")


def clean_paragraph(c: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), clean_line), lambda x: x != ""), " ")


def console_text(c: Column, most: int = 80) -> Column:
    """Cleaned, beyond ASCII replaced by a question mark, cut to ``most``."""
    return F.substring(F.regexp_replace(clean_line(c), r"[^\x00-\x7f]", "?"), 1, most)


def slugify(c: Column, most: int = 64) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(F.when(s == "", "section").otherwise(s), 1, most)


def match_key(c: Column, unicode_keys: bool = False) -> Column:
    """The comparison key: tags dropped, lower case, only a-z and 0-9 (or all letters and digits).

    White space and controls end as single blanks with all else that isn't kept, so the text needs
    no cleaning but for the characters that vanish.
    """
    s = F.regexp_replace(F.lower(kept_text(c)), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+" if unicode_keys else "[^a-z0-9]+", " "))


def margin_key(c: Column | str) -> Column:
    """Key of a running header or footer: page numbers at either end don't count.

    White space of a cleaned line is single spaces. A column given by name is tested first: a line that
    begins and ends in letters or punctuation, and not in a P, has nothing to cut and needs no cleaning for its key.
    """
    s = F.regexp_replace(clean_line(c), U + r"^\d{1,3} | \d{1,3}\z", "")
    cut = match_key(F.regexp_replace(s, U + r"(?i)^page \d{1,4} ?", ""))
    if not isinstance(c, str):
        return cut
    whole = F.col(c)
    ends = F.concat(F.substring(whole, 1, 1), F.substring(whole, -1, 1))
    bare = F.trim(F.regexp_replace(F.lower(kept_text(whole)), "[^a-z0-9]+", " "))
    return F.when(ends.rlike(r"\A[\p{L}\p{P}&&[^pP<]][\p{L}\p{P}]\z"), F.when(F.contains(whole, F.lit("<")), match_key(whole)).otherwise(bare)).otherwise(cut)


#: Punctuation that decoding UTF-8 as Windows-1252 garbles (fixed values).
GARBLED = "•–—‘’“”…"


def garbled(c: str, times: int) -> str:
    """A text after ``times`` rounds of being encoded in UTF-8 and read as Windows-1252."""
    for _ in range(times):
        read = lambda b: bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b)
        c = "".join(read(b) for b in c.encode())
    return c


@lru_cache
def mojibake_pairs(compat: bool = False) -> tuple[tuple[str, str], ...]:
    """(garbled, repaired) in the order in which they are replaced.

    ``compat`` lifts twice garbled punctuation by one level and a bullet garbled three times by two;
    else every level is repaired to the true character. Stray pairs from no-break spaces go in both.
    """
    stray = [(garbled("\u00c2", 1) + " ", " "), (garbled("\u00c2", 1), "")]
    if compat:
        return ((garbled("•", 3), garbled("•", 1)), *((garbled(c, 2), garbled(c, 1)) for c in GARBLED), *stray)
    whole = [(garbled(c, n), c) for n in (3, 2, 1) for c in GARBLED]
    return (*whole, *stray, ("\u00c2 ", " "), ("\u00c2\u00a0", " "))


def repair_mojibake(c: Column, compat: bool = False) -> Column:
    for bad, good in mojibake_pairs(compat):
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def is_page_number(c: Column | str) -> Column:
    return clean_line(c).rlike(U + r"(?i)^(page\s+)?\d{1,4}(\s*(/|of)\s*\d{1,4})?\z")


def is_bullet(c: Column) -> Column:
    return c.rlike(U + r"^([•*-]|\d+\.)\s")


def words(c: Column) -> Column:
    return F.filter(F.split(c, U + r"\s+"), lambda x: x != "")


LONGEST = 120  # characters of a heading


def heading_shaped(c: Column) -> Column:
    """4 to 120 characters, no bullet, not a sentence of more than 8 words."""
    long_sentence = c.endswith(".") & (F.size(words(c)) > 8)
    return F.length(c).between(4, LONGEST) & ~c.rlike(U + r"^[•*-]") & ~long_sentence


def cell_escape(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def html_escape(c: Column, keep_sup: bool = False) -> Column:
    """The five entities; ``keep_sup`` gives superscript numbers of up to three digits their tags back."""
    for bad, good in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(bad), F.lit(good))
    return F.regexp_replace(c, U + r"(?i)&lt;sup&gt;\s*([0-9]{1,3})\s*&lt;/sup&gt;", "<sup>$1</sup>") if keep_sup else c
