"""The parts of operators 2 and 4 that SQL can say: base counts and base spans, as queries of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import quality, secrets
from quirefold.llm.common import documents

_BLANK = r"\x20\x09-\x0D"


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base rule of every document, without the method's verdict."""
    m = quality.measured(documents(spark, sf_dir).select("doc_id", "text"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of every document, without those that the model adds."""
    found = secrets.scanned(documents(spark, sf_dir), secrets.trained(secrets.labelled_samples(spark)))
    return secrets.digest(found).drop("spans")


QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') AS w FROM documents),
windows AS (SELECT doc_id, s, w[s:s + 2] AS three FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) > 2)),
twice AS (SELECT doc_id, three FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + 3)) AS p FROM windows SEMI JOIN twice USING (doc_id, three)) GROUP BY doc_id),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS l, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""

#: Words before a value, each letter in either case.
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_KINDS = (
    ("assign", rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
)
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v,"
    f" string_split_regex(t, '{pattern}') AS b, {least} AS least FROM d"
    for rank, (kind, pattern, group, least) in enumerate(_KINDS)
)
#: Matches and the pieces between them alternate, so a match starts after the lengths of all before it.
SECRETS_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND}),
each AS (SELECT *, length(array_to_string(b[1:k], '')) + length(array_to_string(m[1:k - 1], '')) AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM f)),
spans AS (SELECT doc_id, rank, kind, s, s + length(m[k]) AS e FROM each WHERE length(v[k]) >= least),
told AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS a, count(*) FILTER (WHERE rank = 1) AS k, count(*) FILTER (WHERE rank = 2) AS h,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS x FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(x, '')) AS base_sha256 FROM d LEFT JOIN told USING (doc_id)
"""
