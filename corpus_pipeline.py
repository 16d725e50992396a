"""The corpus pipeline: quality rules, near-dedup, decontamination, secret scan, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in
the shared folder and reads again as the next one's docs. All but the last return the columns of
``documents``. Rows are joined to verdicts by doc_id; rows that share a doc_id go or stay together,
and a row without a doc_id stays, as nothing can be said of it. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import decontam, mixing, neardup, quality, secrets
from quirefold.llm.common import documents, stored

#: No stage but the first is within reach of SQL; tests hold all against brute force.
ORACLE_SQL = None


def without(docs: DataFrame, verdicts: DataFrame, bad) -> DataFrame:
    """The rows of docs whose doc_id isn't among those that ``bad`` selects."""
    ids = verdicts.filter(bad).select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or their pool's robust distance rejects go."""
    return without(docs, quality.quality(docs), ~F.col("kept"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the least doc_id stays."""
    found = neardup.near_duplicates(docs, words=5, percent=80, coordinates=64, matches=34)
    return without(docs, found, ~F.col("kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontam.digest(decontam.decontaminate(docs, items)), F.col("contaminated"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; a changed text gets its new length."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = secrets.scanned(whole, secrets.trained(secrets.labelled_samples(spark)))
    changed = F.size("spans") > 0
    clean = found.withColumn("clean", F.when(changed, secrets.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    new = {"text": F.col("clean"), "n_chars": F.when(changed, F.length("clean").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return clean.select(*[(F.col("row")[c] if new.get(c) is None else new[c]).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document, text and all, with the times that the mix takes it and its output shards.

    ``mixing.write_shards`` writes these rows' copies by shard, in shuffled order.
    """
    return mixing.mix(docs, with_text=True)


STAGES = [
    ("quality", quality_stage),
    ("neardup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
