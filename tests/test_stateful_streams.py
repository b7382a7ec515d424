"""Ordered smoothing and quotes with a time to live, over several files with late rows, against loops over the sorted rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quartz_panel.plans import stream_queries as Q
from quartz_panel.streaming.stateful import OrderedSmoother

RANKS = "ticker_id long, horizon string, date date, rank double"


def smoothed(rows, span, start=None):
    alpha, out, state = 2 / (span + 1), {}, dict(start or {})
    for t, h, day, rank in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if rank is not None:
            state[t, h] = rank if state.get((t, h)) is None else alpha * rank + (1 - alpha) * state[t, h]
        out[t, h, day] = state.get((t, h))
    return out


def write_files(spark, files, schema, folder):
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def ranks():
    rng = random.Random(3)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=7 * k) for k in range(24)]
    rows = [(t, h, d, None if rng.random() < 0.1 else round(rng.random(), 3)) for t in (1, 2, 5) for h in ("3M", "1Y") for d in days if rng.random() < 0.9]
    files = [[] for _ in range(6)]
    for r in rows:
        files[min(5, days.index(r[2]) // 4 + rng.randint(0, 1))].append(r)
    for f in files:
        rng.shuffle(f)
    return rows, files


def test_late_and_unordered_days_are_smoothed_in_order(spark, tmp_path, ranks):
    rows, files = ranks
    write_files(spark, files, RANKS, f"{tmp_path}/in")
    got = Q.smoothed_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], RANKS).schema, str(tmp_path), 3, "70 days").collect()
    want = smoothed(rows, 3)
    assert {(r.ticker_id, r.horizon, r.date): r.smooth for r in got} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}


def test_goes_on_from_stored_ranks_and_ignores_known_days(spark, tmp_path, ranks):
    rows, _ = ranks
    cut = dt.date(2020, 3, 1)
    before = {(t, h): v for (t, h, d), v in sorted(smoothed(rows, 4).items()) if d <= cut}
    stored = spark.createDataFrame([(t, h, cut, v) for (t, h), v in before.items()], "ticker_id long, horizon string, date date, smooth double")
    late = [r for r in rows if r[2] > dt.date(2020, 2, 15)]  # days up to the stored one come again
    write_files(spark, [late], RANKS, f"{tmp_path}/in")
    got = Q.smoothed_stream(spark, f"{tmp_path}/in", stored.drop("smooth").withColumn("rank", F.lit(0.0)).schema, str(tmp_path), 4, "400 days", stored).collect()
    want = {k: v for k, v in smoothed(rows, 4).items() if k[2] > cut}
    assert {(r.ticker_id, r.horizon, r.date): r.smooth for r in got} == {k: pytest.approx(v) for k, v in want.items()}


def test_a_batch_reads_and_writes_a_key_once_and_gives_out_what_changed():
    """No state call or timer for each row: one get and one update a batch; only days from the earliest new one on are given out."""
    calls, held = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return held.get("x")

        def update(self, x):
            calls.append("update")
            held["x"] = x

    class Handle:
        def getValueState(self, *_):
            return Value()

    class Timers:
        def __init__(self, day):
            self.day = day

        def getCurrentWatermarkInMs(self):
            return 0 if self.day is None else int((self.day - dt.date(1970, 1, 1)).total_seconds() * 1000)

    days = [dt.date(2020, 1, d) for d in range(1, 21)]
    rows = [{"date": d, "rank": None if d.day == 4 else float(d.day)} for d in days]
    want = {k[2]: v for k, v in smoothed([(1, "3M", r["date"], r["rank"]) for r in rows], 3).items()}
    s = OrderedSmoother(0.5)
    s.init(Handle())
    run = lambda part, seen: [(r.date, r.smooth) for r in s.handleInputRows((1, "3M"), iter(part), Timers(seen))]
    assert len(run([r for r in rows[:10] if r["date"].day != 7][::-1], None)) == 9
    assert run([rows[6]], days[5]) == [(d, want[d]) for d in days[6:10]]
    assert run(rows[:3] + rows[10:], days[12]) == [(d, want[d]) for d in days[10:]]
    assert calls == ["get", "update"] * 3 and len(held["x"][2]) == 8
    assert run([rows[2]], days[12]) == []


def test_quotes_expire_by_event_time_over_files(spark, tmp_path):
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(k, rng.randint(1, 12), base + dt.timedelta(seconds=20 * k + rng.randint(0, 40), microseconds=rng.randint(0, 999999)), round(rng.random() * 9, 2)) for k in range(300)]
    rows.insert(5, (300, 77, base + dt.timedelta(seconds=3), 1.5))
    rows += [(301, 78, rows[-1][2], 2.5), (302, 78, rows[-1][2], 3.5), (303, 79, rows[-1][2], None)]
    schema = "event_id long, user_id long, ts timestamp_ntz, value double"
    write_files(spark, [rng.sample(rows[a : a + 60], len(rows[a : a + 60])) for a in range(0, len(rows), 60)], schema, f"{tmp_path}/in")
    closes = spark.createDataFrame([(t, 100.0 + t) for t in range(1, 13)] + [(77, 177.0), (79, 179.0)], "ticker_id long, adj_close double")
    ttl, late = 120, 90
    got = {r.ticker_id: (r.price, r.stale) for r in Q.quote_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, str(tmp_path), closes, ttl, f"{late} seconds").collect()}
    now = max(r[2] for r in rows) - dt.timedelta(seconds=late)
    last, close = {}, {r.ticker_id: r.adj_close for r in closes.collect()}
    for seq, t, ts, price in rows:
        last[t] = max(last.get(t, (dt.datetime.min, -1, None)), (ts, seq, price), key=lambda x: x[:2])
    ms = lambda t: t.replace(microsecond=t.microsecond // 1000 * 1000)
    want = {t: ((price, False) if price is not None and ms(ts) + dt.timedelta(seconds=ttl) > ms(now) else (close.get(t), True)) for t, (ts, _, price) in last.items()}
    assert got == want and {s for _, s in want.values()} == {True, False}
    assert got[77] == (177.0, True) and got[78] == (3.5, False) and got[79] == (179.0, True)
