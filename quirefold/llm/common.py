"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.store import shared_dir, stored  # noqa: F401

#: Word separators of most contracts: space and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def volume(docs: DataFrame) -> tuple[int, int]:
    """(rows, bytes of text) of a table with ``text``."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return n, size


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting that the table has at most ``max_rows`` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def partitions(spark: SparkSession, rows: int = 0, rows_each: int = 20_000) -> int:
    """Number of parts to deal data into: follows the session, and the data when that is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def blank_words(text: Column) -> Column:
    """Array of the runs of characters other than space and U+0009 to U+000D; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
