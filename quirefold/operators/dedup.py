"""Repeated paragraphs: exact by key, then near ones by similarity ratio."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import U, match_key
from quirefold.operators.layout import streamed
from quirefold.operators.post import Kept

#: Looks no further than the twelfth word.
TWELVE_WORDS = U + r"\A\s*+(?:\S++\s++){11}\S"


def candidates(paras: DataFrame, unicode_keys: bool = False) -> DataFrame:
    """Adds ``norm`` and ``candidate``: long prose may be a repeat; tables and headings may not."""
    norm = match_key(F.col("text"), unicode_keys)
    long = (F.length("text") >= 80) & F.col("text").rlike(TWELVE_WORDS)
    return paras.withColumn("norm", norm).withColumn("candidate", long & ~F.col("text").rlike(r"^(\||#|- (Level|Pages|Source):)"))


def exact(paras: DataFrame, scope: list[str]) -> DataFrame:
    """The first of each key in its scope; paragraphs without a key go, short ones stay.

    Keys are shuffled as 128-bit names, not as texts.
    """
    c = candidates(paras).withColumn("_name", F.md5(F.nullif(F.col("norm"), F.lit("")))).drop("norm")
    w = Window.partitionBy(*scope, "_name", "candidate").orderBy("para")
    first = c.withColumn("_k", F.when(F.col("candidate"), F.row_number().over(w)))
    return first.filter("_name is not null and coalesce(_k, 1) = 1").select(*paras.columns)


def near(paras: DataFrame, scope: list[str], ratio: float = 0.94, autojunk: bool = True) -> DataFrame:
    """Of candidates that share ten first key words, those unlike every earlier kept one.

    ``Kept`` proves most pairs unlike, so a large bucket costs few matches; it holds the bucket's kept keys.
    """
    c = candidates(paras)
    key = F.concat_ws(" ", F.slice(F.split("norm", " "), 1, 10))
    keyed = c.filter("candidate").select(*paras.columns, "norm", key.alias("_p"))

    def keep(k: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        kept = Kept(autojunk, ratio)
        for *row, norm, _ in rows:
            if not kept.like(norm):
                kept.add(norm)
                yield tuple(row)

    once = streamed(keyed, [*scope, "_p"], ["para"], keep, paras.schema, whole=False)
    return c.filter("not candidate and norm <> ''").select(*paras.columns).unionByName(once)


def deduplicated(paras: DataFrame, scope: list[str], ratio: float = 0.94, autojunk: bool = True) -> DataFrame:
    return near(exact(paras, scope), scope, ratio, autojunk)
