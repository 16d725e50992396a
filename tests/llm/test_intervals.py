"""The interval join against plain loops over all pairs."""

import datetime as dt
import random
import zlib

from pyspark.sql import functions as F

from quirefold.llm import intervals
from quirefold.llm.intervals import GAP, SLOT

SALES = "sale_id bigint, client_id bigint, status string, sold_at timestamp_ntz, crc bigint"
LINES = "sale_id bigint, shipped_at timestamp_ntz"
CLICKS = "click_id bigint, client_id bigint, kind string, ts timestamp_ntz, lo string"
START = dt.datetime(2024, 1, 1)
EPOCH = dt.datetime(1970, 1, 1)


def us(t):
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def brute(sales, lines, clicks):
    own = {}
    for _, c, kind, t, _ in clicks:
        if c is not None and t is not None:
            own.setdefault(c, []).append((us(t), kind == "error"))
    found = {}
    for c, rows in own.items():
        at = None
        for t, bad in sorted(rows):
            if at is None or t - at[1] > GAP:
                at = [t, t, bad]
                found.setdefault(c, []).append(at)
            else:
                at[2] = bad or (at[2] and t == at[1])
                at[1] = t
    out = {}
    for sale, c, status, t, _ in sales:
        if c is None or t is None:
            continue
        ends = [us(x) for s, x in lines if s == sale and sale is not None and x is not None]
        a, b = us(t) // SLOT, float("inf") if status == "open" else max([us(t), *ends]) // SLOT
        for first, last, bad in found.get(c, []):
            x, y = first // SLOT, float("inf") if bad else last // SLOT
            if a <= y and x <= b:
                cmp = lambda p, q: 0 if p < q else 1 if p == q else 2
                name = intervals.RELATIONS[3 * cmp(a, x) + cmp(b, y)]
                row = out.setdefault((sale, name), [0, None, 0])
                row[0] += 1
                if min(b, y) < float("inf"):
                    row[1] = (row[1] or 0) + min(b, y) - max(a, x) + 1
                row[2] += zlib.crc32(str(first).encode())
    return {k: tuple(v) for k, v in out.items()}


def rows(n, hot, seed):
    r = random.Random(seed)
    client = lambda: None if r.random() < 0.02 else 7 if r.random() < hot else r.randrange(5)
    time = lambda days: None if r.random() < 0.02 else START + dt.timedelta(seconds=r.randrange(days * 86400), microseconds=r.randrange(10**6))
    sales = [(None if r.random() < 0.01 else k, client(), r.choice(["open", "done", None]), time(60), 1) for k in range(n)]
    sales += sales[:3]  # repeated rows
    lines = [(r.choice([None, r.randrange(n)]), time(90)) for _ in range(2 * n)]
    clicks = [(k, client(), r.choice(["error", "click", None]), time(60), "x") for k in range(3 * n)]
    clicks += [(c[0], c[1], "error", c[3], "x") for c in clicks[:40]]  # ties at a time
    clicks += [(k, 7, "click", START + dt.timedelta(minutes=30 * k), "x") for k in range(5)]  # exactly 30 minutes apart
    clicks += [(k, 3, "click", START + dt.timedelta(minutes=29 * k), "x") for k in range(99)]  # a session over several slots
    clicks += [(k, 4, "click", START + dt.timedelta(minutes=29 * k, days=9), "x") for k in range(300)]  # over six days, one without a begin
    clicks += [(k, 4, "error", START + dt.timedelta(days=8, minutes=m), "x") for k, m in ((1, 1409), (2, 1410), (3, 1439))]  # one minute before midnight
    sales += [(n + k, 3, "done", START + dt.timedelta(hours=6 * k), 1) for k in range(12)]
    lines += [(n + k, START + dt.timedelta(days=40)) for k in range(6)]
    return sales, lines, clicks


def found(spark, sales, lines, clicks, most):
    df = intervals.related(spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES), spark.createDataFrame(clicks, CLICKS), most)
    assert df.columns == ["sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc"]
    got = {(r[0], r[1]): tuple(r[2:]) for r in df.collect()}
    assert len(got) == df.count()
    return got


def test_all_pairs_whole_and_in_shards(spark):
    data = rows(300, 0.5, 1)
    want = brute(*data)
    assert {k[1] for k in want} == set(intervals.RELATIONS)
    assert found(spark, *data, 4096) == want
    assert found(spark, *data, 16) == want  # the hot client is cut into time shards
    assert found(spark, *data, 1) == want


def test_cells_that_span_batches(spark):
    data = rows(200, 0.4, 2)
    own = intervals.sale_intervals(spark.createDataFrame(data[0], SALES), spark.createDataFrame(data[1], LINES)).select("client_id", "lo", "hi").distinct()
    there = intervals.session_intervals(intervals.sessions(spark.createDataFrame(data[2], CLICKS)))
    sums = lambda batch: sorted(intervals.overlapping(own, there, 20, batch).collect(), key=str)
    assert sums(1) == sums(50) == sums(100_000) != []


def test_no_rows_zones_and_old_times(spark):
    empty = [spark.createDataFrame([], s) for s in (SALES, LINES, CLICKS)]
    assert intervals.related(*empty).count() == 0
    old = dt.datetime(1969, 12, 31, 23, 59, 59, 999999)
    sales, clicks = [(1, 1, "done", old, 0)], [(1, 1, "click", old, "x"), (2, 1, "click", old + dt.timedelta(minutes=31), "x")]
    assert found(spark, sales, [(1, old)], clicks, 9) == brute(sales, [(1, old)], clicks)
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        night = START + dt.timedelta(days=70, hours=2, minutes=30)  # an hour that clocks there skip
        got = spark.createDataFrame([(night,)], "t timestamp_ntz").select(F.col("t"))
        assert got.select(intervals.micros(got, "t")).first()[0] == us(night)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    zoned = spark.sql("select timestamp'2024-01-01 06:00:00+00:00' as t")
    assert zoned.select(intervals.slot(intervals.micros(zoned, "t"))).first()[0] == us(START) // SLOT + 1 + intervals.ZERO
