"""The query over the shop's tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import intervals


def op12_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sale and relation: pairs with sessions of its client, shared slots and the sessions' names."""
    sales, lines, clicks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "sale_lines", "clicks"))
    return intervals.related(sales, lines, clicks)


#: CRC-32 has no function there: a table of its 256 steps, then a fold over the digits.
OP12_SQL = """
WITH steps AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
c AS (SELECT client_id, epoch_us(ts) AS us, coalesce(kind = 'error', false) AS bad FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY client_id ORDER BY us) > 1800000000, true)::INT AS new FROM c),
n AS (SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT client_id, min(us) AS first, max(us) AS last, max(us * 2 + bad::INT) % 2 = 1 AS is_open FROM n GROUP BY client_id, k),
r AS (SELECT client_id, first // 21600000000 AS lo, CASE WHEN is_open THEN 99999999 ELSE last // 21600000000 END AS hi,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(first::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc
  FROM s, steps),
shipped AS (SELECT sale_id, max(epoch_us(shipped_at)) AS last FROM sale_lines GROUP BY sale_id),
l AS (SELECT sale_id, client_id, epoch_us(sold_at) // 21600000000 AS lo,
  CASE WHEN status = 'open' THEN 99999999 ELSE greatest(epoch_us(sold_at), coalesce(last, epoch_us(sold_at))) // 21600000000 END AS hi
  FROM sales LEFT JOIN shipped USING (sale_id) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
p AS (SELECT sale_id, l.lo AS a, l.hi AS b, r.lo AS c, r.hi AS d, crc FROM l JOIN r USING (client_id) WHERE l.lo <= r.hi AND r.lo <= l.hi)
SELECT sale_id, CASE WHEN a < c THEN CASE WHEN b < d THEN 'overlaps' WHEN b = d THEN 'finished_by' ELSE 'contains' END
  WHEN a = c THEN CASE WHEN b < d THEN 'starts' WHEN b = d THEN 'equals' ELSE 'started_by' END
  ELSE CASE WHEN b < d THEN 'during' WHEN b = d THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
  count(*) AS n_pairs, sum(CASE WHEN least(b, d) < 99999999 THEN least(b, d) - greatest(a, c) + 1 END)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc
FROM p GROUP BY ALL
"""
