"""Interval overlap join: sales with the click sessions of their clients, classified and summed.

1. Clicks become sessions in steps. Per client and half hour: clicks of one half hour are never over
   30 minutes apart, so they share a session, and their sums combine before the shuffle. Per client and
   day, a window over its half hours; what came before a day's first one can only matter if it was on
   the day before, so that day's end is joined. Then a client's days, a row each, tell which session
   was open when a day began. No task holds a client's clicks, whatever their number.
2. Both sides become distinct slot intervals with counts. An open end is a sentinel beyond every
   slot, so open ends are equal and everything later is before them. However many sales or clicks a
   client has, its distinct intervals are bounded by the pairs of slots in the time covered.
3. Clients are dealt by hash. One with over ``most`` distinct intervals is cut into time shards of so
   many slots that about ``most`` intervals start in each. An interval goes to each shard that it
   covers, and is marked in the one where it starts. The later start of a pair lies in one shard, so
   that shard alone counts the pair: where one of both starts.
4. An Arrow task lays its (client, shard) cells side by side on one axis, so that intervals of two
   cells never meet, and DuckDB joins the two sides by their two inequalities (its IEJoin), classifies
   pairs and sums them by interval and relation. It holds whole cells of about ``batch`` rows at a time.
5. Partial sums of shards are merged, and go to the sales by (client, start, end).

Edge cases: rows with a null client_id, sold_at or ts are ignored; a sale whose lines have no
shipped_at ends at sold_at; lines without a sale_id belong to none. Repeated clicks change nothing;
each row of a repeated sale_id counts, and its rows are summed; sales with a null sale_id are summed
as one. A null kind is no error, a null status not open. Times with a zone count in UTC, those without
are taken as UTC, whatever the session's zone. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import stored

MINUTE = 60_000_000
GAP, SLOT = 30 * MINUTE, 360 * MINUTE
HALVES = 48  # half hours of a day
#: Slots are told from ZERO on, so that all that a timestamp can give lie in 0 ... OPEN - 1.
ZERO, AXIS = 1 << 22, 1 << 25
OPEN = AXIS - 1
#: By the order of starts, then of ends, each earlier, equal, later.
RELATIONS = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")
SUMS = "client_id bigint, lo bigint, hi bigint, relation string, n_pairs bigint, overlap_slots bigint, crc bigint"

JOIN = f"""
SELECT l.i AS i, 3 * (sign(l.lo - r.lo) + 1) + sign(l.hi - r.hi) + 1 AS code, sum(r.n)::BIGINT AS n_pairs,
  sum(CASE WHEN least(l.hi, r.hi) < {OPEN} THEN r.n * (least(l.hi, r.hi) - greatest(l.lo, r.lo) + 1) END)::BIGINT AS overlap_slots,
  sum(r.crc)::BIGINT AS crc
FROM l JOIN r ON l.x0 <= r.x1 AND l.x1 >= r.x0
WHERE l.begins OR r.begins
GROUP BY ALL
"""


def micros(df: DataFrame, column: str) -> Column:
    """Whole microseconds since 1970 of a timestamp; one without a zone is taken as UTC."""
    if dict(df.dtypes)[column] != "timestamp_ntz":
        return F.unix_micros(column)
    c = F.col(column)
    second = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    minutes = F.unix_date(F.to_date(c)).cast("bigint") * 1440 + F.hour(c) * 60 + F.minute(c)
    return minutes * MINUTE + second


def whole(c: Column, unit: Column | int) -> Column:
    """How often ``unit`` goes into a whole number, rounded down."""
    unit = F.lit(unit).cast("bigint") if isinstance(unit, int) else unit
    return F.call_function("div", c - F.pmod(c, unit), unit)


def slot(c: Column) -> Column:
    return whole(c, SLOT) + ZERO


def sessions(clicks: DataFrame) -> DataFrame:
    """(client_id, first, last, open) of click sessions; times in microseconds."""
    c = clicks.select("client_id", micros(clicks, "ts").alias("us"), F.coalesce(F.col("kind") == "error", F.lit(False)).cast("bigint").alias("bad"))
    c = c.filter("client_id is not null and us is not null")
    # The last bit of ``last`` tells of an error at the last time: one number, so sums stay hashed.
    by_half = c.groupBy("client_id", whole(F.col("us"), GAP).alias("half")).agg(F.min("us").alias("first"), F.max(F.col("us") * 2 + F.col("bad")).alias("last"))
    halves = stored(by_half.withColumn("day", whole(F.col("half"), HALVES)), "half-hours")
    ends = halves.groupBy("client_id", "day").agg(F.max("last").alias("_end")).withColumn("day", F.col("day") + 1)
    w = Window.partitionBy("client_id", "day").orderBy("half")
    before = F.coalesce(F.lag("last").over(w), F.col("_end"))
    begins = F.coalesce(F.col("first") - F.shiftright("_before", 1) > GAP, F.lit(True))
    marked = halves.join(ends, ["client_id", "day"], "left").withColumn("_before", before).withColumn("_own", F.when(begins, F.col("first")))
    marked = stored(marked.select("client_id", "day", "first", "last", F.last("_own", ignorenulls=True).over(w).alias("session")), "half-hours")
    days = marked.groupBy("client_id", "day").agg(F.max("session").alias("_last"))
    earlier = Window.partitionBy("client_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    opened = days.select("client_id", "day", F.last("_last", ignorenulls=True).over(earlier).alias("session"))
    going = marked.filter("session is null").drop("session").join(opened, ["client_id", "day"])
    whole_ = marked.filter("session is not null").unionByName(going).groupBy("client_id", "session")
    found = whole_.agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return found.select("client_id", "first", F.shiftright("last", 1).alias("last"), (F.col("last") % 2 != 0).alias("open"))


def sale_intervals(sales: DataFrame, sale_lines: DataFrame) -> DataFrame:
    """(sale_id, client_id, lo, hi): slots of each sale with a client and a time."""
    shipped = sale_lines.select("sale_id", micros(sale_lines, "shipped_at").alias("_t")).filter("sale_id is not null and _t is not null")
    last = shipped.groupBy("sale_id").agg(F.max("_t").alias("_last"))
    own = sales.select("sale_id", "client_id", micros(sales, "sold_at").alias("_sold"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("_open"))
    own = own.filter("client_id is not null and _sold is not null").join(last, "sale_id", "left")
    end = F.when(F.col("_open"), OPEN).otherwise(slot(F.greatest("_sold", "_last")))
    return own.select("sale_id", "client_id", slot(F.col("_sold")).alias("lo"), end.alias("hi"))


def session_intervals(found: DataFrame) -> DataFrame:
    """(client_id, lo, hi, n, crc): distinct slot intervals of sessions, how many, and the sum of their names."""
    end = F.when(F.col("open"), OPEN).otherwise(slot(F.col("last")))
    s = found.select("client_id", slot(F.col("first")).alias("lo"), end.alias("hi"), F.crc32(F.col("first").cast("string").cast("binary")).alias("_c"))
    return s.groupBy("client_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.sum("_c").alias("crc"))


def joined_cells(batch: int):
    """Joins the two sides of each (client, shard) cell; rows come sorted by cell."""

    def joined(con, t: pa.Table) -> pa.Table:
        of = lambda c: t[c].to_numpy()
        client, shard, lo, hi = of("client_id"), of("shard"), of("lo"), of("hi")
        cell = np.cumsum(np.concatenate(([0], (client[1:] != client[:-1]) | (shard[1:] != shard[:-1]))))
        left = of("is_left")
        side = {}
        for name, rows in (("l", np.flatnonzero(left)), ("r", np.flatnonzero(~left))):
            columns = {"i": rows, "lo": lo[rows], "hi": hi[rows], "x0": cell[rows] * AXIS + lo[rows], "x1": cell[rows] * AXIS + hi[rows]}
            columns |= {c: of(c)[rows] for c in ("begins", "n", "crc")}
            side[name] = pa.table(columns)
            con.register(name, side[name])
        got = con.sql(JOIN).to_arrow_table()
        at = got["i"].to_numpy()
        return pa.table(
            {
                "client_id": client[at], "lo": lo[at], "hi": hi[at], "relation": pa.array(RELATIONS).take(got["code"].cast(pa.int64())),
                "n_pairs": got["n_pairs"], "overlap_slots": got["overlap_slots"], "crc": got["crc"],
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con, held, n = duckdb.connect(config={"threads": 1}), [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < batch:
                continue
            t = pa.Table.from_batches(held)
            client, shard = t["client_id"].to_numpy(), t["shard"].to_numpy()
            cut = np.flatnonzero((client[1:] != client[:-1]) | (shard[1:] != shard[:-1]))
            if len(cut):  # the last cell may go on in the next batch
                end = int(cut[-1]) + 1
                yield from joined(con, t.slice(0, end)).to_batches()
                held, n = t.slice(end).to_batches(), t.num_rows - end
        if n:
            yield from joined(con, pa.Table.from_batches(held)).to_batches()

    return run


def overlapping(left: DataFrame, right: DataFrame, most: int = 4096, batch: int = 100_000) -> DataFrame:
    """SUMS of pairs of distinct intervals ``left`` (client_id, lo, hi) and ``right`` (... n, crc) that share a slot."""
    both = left.select("client_id", "lo", "hi", F.lit(True).alias("is_left"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("crc"))
    both = both.unionByName(right.select("client_id", "lo", "hi", F.lit(False).alias("is_left"), "n", "crc"))
    sizes = both.groupBy("client_id").agg(F.count(F.lit(1)).alias("_n"), F.min("lo").alias("_a"), F.max("lo").alias("_z"))
    width = F.greatest(F.lit(1), F.floor((F.col("_z") - F.col("_a") + 1) * most / F.col("_n"))).cast("bigint")
    # Written first, so the join with it starts from rows alone and a hot client's can be split among tasks.
    hot = stored(sizes.filter(F.col("_n") > most).select("client_id", "_a", "_z", width.alias("_w")), "hot-clients")
    rows = both.join(hot.hint("merge"), "client_id", "left")
    # No pair's later start is beyond the client's last one, so open intervals end there.
    shard = lambda c: whole(c - F.col("_a"), F.col("_w"))
    covered = F.when(F.col("_w").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(shard(F.col("lo")), shard(F.least("hi", "_z"))))
    dealt = rows.select("client_id", "lo", "hi", "is_left", "n", "crc", F.posexplode(covered).alias("_k", "shard")).withColumn("begins", F.col("_k") == 0)
    cells = dealt.drop("_k").repartition("client_id", "shard").sortWithinPartitions("client_id", "shard")
    return cells.mapInArrow(joined_cells(batch), SUMS)


def related(sales: DataFrame, sale_lines: DataFrame, clicks: DataFrame, most: int = 4096) -> DataFrame:
    """Per sale and relation: sale_id, relation, n_pairs, overlap_slots, sessions_crc."""
    own = stored(sale_intervals(sales, sale_lines), "sale-intervals")
    there = stored(session_intervals(sessions(clicks)), "session-intervals")
    part = overlapping(own.select("client_id", "lo", "hi").distinct(), there, most)
    sums = [F.sum(c).alias(c) for c in ("n_pairs", "overlap_slots", "crc")]
    merged = part.groupBy("client_id", "lo", "hi", "relation").agg(*sums)
    told = own.join(merged, ["client_id", "lo", "hi"]).groupBy("sale_id", "relation").agg(*sums)
    return told.select("sale_id", "relation", "n_pairs", "overlap_slots", F.col("crc").alias("sessions_crc"))
