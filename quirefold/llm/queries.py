"""The opN queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import bases, chat, decontam, langid, lm, mixing, neardup, quality, secrets, substring, toxicity, vectors, whitening
from quirefold.llm.common import LOWER, UPPER, documents
from quirefold.llm.shop import OP12_SQL, op12_intervals  # noqa: F401


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.digest(decontam.decontaminate(documents(spark, sf_dir), items))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(documents(spark, sf_dir)))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.trained(secrets.labelled_samples(spark))
    return secrets.digest(secrets.scanned(documents(spark, sf_dir), model))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(langid.language(documents(spark, sf_dir)))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(chat.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.dedup(documents(spark, sf_dir)))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.digest(toxicity.toxicity(documents(spark, sf_dir), labels))


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's links at cosine 0.9 or more, and its component."""
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable vector on the first four components of the distinct vectors' covariance."""
    return whitening.whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: f for k, f in globals().items() if k.startswith("op") and k[2:].split("_")[0].isdigit()}
    return own | {f.__name__: f for f in (bases.base_quality, bases.base_secrets)}


#: Words of the contracts that take runs of characters other than space and U+0009 to U+000D.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS seq
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM iw WHERE len(w) > 0)
),
occ AS (
  SELECT * FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS seq
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n))
  SEMI JOIN win USING (seq, n)
),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
own AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM occ JOIN win USING (seq, n) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, items IS NOT NULL AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""

OP7_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, k, role, '{chat.PROBE}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(k, role)
),
o AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
  sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY k) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  sum(20 + length(r || t) + length(regexp_replace(r || t, '[^\\<#:]', '', 'g')))::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""

OP8_SQL = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
win AS (
  SELECT doc_id, s AS start, array_to_string(words[s:s + 49], ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50)
),
firsts AS (SELECT seq, min(doc_id) AS lo FROM win GROUP BY seq HAVING count(DISTINCT doc_id) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 50)) AS pos
  FROM win JOIN firsts USING (seq) WHERE lo < doc_id
),
lost AS (SELECT doc_id, list(pos) AS places, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN words
    ELSE list_filter(words, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""


OP9_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(words[s:s + 2], ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS s FROM w WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM sh x JOIN sh y USING (seq) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * met >= 85 * (p.n + q.n - met)
),
reach AS (SELECT doc_id AS a, doc_id AS c FROM sizes UNION SELECT b, c FROM reach JOIN links USING (a)),
firsts AS (SELECT a AS doc_id, min(c) AS c FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN firsts USING (doc_id)
"""


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x, v y WHERE x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT b, c FROM reach JOIN links USING (a)),
firsts AS (SELECT a AS vec_id, min(c) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts USING (vec_id) LEFT JOIN firsts USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the whole result; the others are tested against brute force."""
    return {"op1_decontaminate": OP1_SQL, "op7_chat": OP7_SQL, "op8_substring": OP8_SQL, "op9_neardup": OP9_SQL, "op11_vectors": OP11_SQL, "op12_intervals": OP12_SQL, "base_quality": bases.QUALITY_SQL, "base_secrets": bases.SECRETS_SQL}
