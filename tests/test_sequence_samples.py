"""Sequence samples against a row-by-row version: every end row, all 12 columns."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quartz_panel.operators import fundamentals as U
from quartz_panel.operators import sentiment as N
from quartz_panel.operators import sequences as S
from quartz_panel.operators.sequences import RATIOS, SAMPLE_COLUMNS, sequence_samples
from quartz_panel.sources import views as V

DIR = "/root/testdata/sf0.001"


def z(a):
    return np.zeros(len(a)) if a.std() < 1e-9 else (a - a.mean()) / a.std()


def brute(bars, filings, daily, end):
    """bars: (date, close, volume) in order; filings: (filed_at, accession, ratios); daily: {date: (7d, 14d)}."""
    c = [x[1] for x in bars]
    for i in range(1, len(c)):
        c[i] = c[i] if c[i] and c[i] > 0 else c[i - 1]
    at = range(end - 251, end + 1)
    r = np.array([math.log(c[i] / c[i - 1]) for i in at])
    out = {"return_z": z(r), "volume_z": z(np.array([math.log(max(bars[i][2] if bars[i][2] is not None else 1.0, 1.0)) for i in at]))}
    out["volatility"] = [r[max(0, i - 19) : i + 1].std() for i in range(252)]
    near = [next((daily[d] for d in (bars[i][0] - dt.timedelta(k) for k in range(4)) if d in daily), (0.0, 0.0)) for i in at]
    known = [max((f for f in filings if f[0] <= bars[i][0]), default=(0, 0, (0.0,) * 5))[2] for i in at]
    turn = [2 * math.pi * bars[i][0].timetuple().tm_yday / 365.25 for i in at]
    out |= {"sentiment_7d": [x[0] for x in near], "sentiment_14d": [x[1] for x in near], "day_sin": np.sin(turn), "day_cos": np.cos(turn)}
    return out | {n: [x[k] for x in known] for k, n in enumerate(RATIOS)}


def test_samples_equal_the_row_by_row_version(spark):
    two = F.col("ticker_id") <= 2
    bars = V.bars(spark, DIR).filter(two)
    first = bars.groupBy("ticker_id").agg(F.min("trade_date").alias("f"))
    # gaps of price and volume, and headlines that overlap the bars
    h = F.xxhash64("ticker_id", "trade_date")
    bars = bars.join(first, "ticker_id").select("ticker_id", "trade_date", F.when((F.pmod(h, F.lit(19)) > 0) | (F.col("trade_date") == F.col("f")), F.col("adj_close")).alias("adj_close"), F.when(F.pmod(h, F.lit(23)) > 0, F.col("volume")).alias("volume")).localCheckpoint()
    filings = V.filings(spark, DIR).filter(two)
    heads = V.headlines(spark, DIR).withColumn("ticker_id", F.col("headline_id") % 3).withColumn("published_at", F.expr("timestampadd(DAY, -9900 + 3 * (headline_id % 700), published_at)"))
    daily = N.rolling_sentiment(N.sentiment_daily(heads)).localCheckpoint()
    got = {(r.ticker_id, r.trade_date): r for r in sequence_samples(bars, filings, daily).collect()}
    rows, n, moved = sorted(bars.collect()), 0, False
    for t in (0, 1, 2):
        b = [tuple(r)[1:] for r in rows if r.ticker_id == t]
        f = [(r.filed_at, r.accession_number, tuple(r[c] or 0.0 for c in RATIOS)) for r in U.annotated(filings).filter(F.col("ticker_id") == t).collect()]
        s = {r.score_date: (float(r.rolling_7d), float(r.rolling_14d)) for r in daily.filter(F.col("ticker_id") == t).collect()}
        n += max(0, len(b) - 252)
        for end in range(252, len(b)):
            want = brute(b, f, s, end)
            moved |= any(want["sentiment_7d"]) and any(want["revenue_growth"])
            for c in SAMPLE_COLUMNS:
                assert np.allclose(got[t, b[end][0]][c], want[c], atol=1e-9), (t, end, c)
    assert len(got) == n > 0 and moved


def test_query_gives_every_end_row_and_every_column(spark):
    out = entry.queries()["w31_sequence_samples"](spark, DIR)
    ends = V.bars(spark, DIR).groupBy("ticker_id").count().agg(F.sum(F.greatest(F.col("count") - 252, F.lit(0)))).first()[0]
    rows = out.collect()
    assert len(rows) == ends > 0 and out.columns == ["ticker_id", "trade_date", "n", *SAMPLE_COLUMNS]
    assert all(r.n == 252 and None not in r for r in rows)


def test_a_window_takes_no_work_of_its_length_in_spark(spark):
    """No sliding list of 252 rows for each bar in the plan: a name's rows go to the task once."""
    plan = sequence_samples(V.bars(spark, DIR), V.filings(spark, DIR), N.rolling_sentiment(N.sentiment_daily(V.headlines(spark, DIR))))._jdf.queryExecution().toString()
    assert "RowFrame, -251" not in plan and "FlatMapGroupsInArrow" in plan


def test_strided_windows_and_summaries_over_blocks(spark, monkeypatch):
    """Blocks of two windows, a stride, a name too short, one of 253 bars, leading nulls, a flat price."""
    monkeypatch.setattr(S, "BLOCK", 2)
    price = lambda t, i: None if t == 2 and i < 3 else (5.0 if t == 3 else 10.0 + math.sin(i * (t + 1)))
    size = {0: 270, 1: 252, 2: 253, 3: 260}
    rows = [(t, dt.date(2001, 1, 1) + dt.timedelta(days=i), price(t, i), float(i % 7)) for t, n in size.items() for i in range(n)]
    got = {(r.ticker_id, r.trade_date): r for r in S.sequence_windows(spark.createDataFrame(rows, "ticker_id long, trade_date date, adj_close double, volume double"), 4).collect()}
    day = lambda i: dt.date(2001, 1, 1) + dt.timedelta(days=i)
    assert sorted(got) == [(0, day(i)) for i in range(252, 270, 4)] + [(2, day(252))] + [(3, day(i)) for i in (252, 256)]
    for (t, end), r in got.items():
        i = (end - day(0)).days
        logs = [None if price(t, k - 1) is None else math.log(price(t, k) / price(t, k - 1)) for k in range(i - 251, i + 1)]
        assert [x is None for x in r.returns] == [x is None for x in logs]
        assert r.z == [None] * 252 if None in logs else np.allclose(r.z, z(np.array(logs)))
        assert np.allclose(r.volumes, z(np.log([k % 7 or 1.0 for k in range(i - 251, i + 1)])))
