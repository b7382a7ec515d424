"""A name's month-end rows, made with numpy from all that is known of it: its bars and side rows meet in one task, by one shuffle.

A name's figures are those of ``price_factors``, ``filing_reaction``, ``estimate_features``, ``short_ratio`` and ``filled``, but for grid
dates alone, so nothing is joined afterwards.  A task holds one name's bars and side rows at a time.  A missing value is NaN here, null outside."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fundamentals import ESTIMATE_FIELDS
from .price import HORIZONS

#: As-of columns of filings, and what else is told of a name's filings.
FUNDS = ("revenue_growth", "gross_margin", "operating_margin", "debt_equity", "fcf_revenue", "total_equity", "ttm_revenue", "ttm_net_income", "ttm_fcf", "gross_margin_stability_4q", "operating_margin_stability_4q", "revenue_growth_stability_4q")
REACTION = ("filing_surprise_3d", "filing_drift_30d", "filings_recency_days", "filings_in_90d")
ANALYSTS = ("rec_mean_level", "rec_rev_30d", "rec_rev_90d", "price_target_mean", "price_target_rev_90d", "forward_earnings_yield", "forward_ebitda_yield", "revenue_surprise", "eps_surprise", "eps_est_rev_30d", "eps_est_rev_90d", "coverage_chg_90d", "pt_num_estimates", "eps_dispersion")
PRICE = (
    "mom_1m", "mom_3m", "mom_6m", "mom_12_1", "beta_252d", "vol_20d", "vol_60d", "vol_120d", "log_market_cap", "max_ret_21d", "idio_vol", "dist_high_252", "dist_low_252", "ma_gap_50", "ma_gap_200", "vol_trend",
    "ret_skew_120d", "downside_vol_ratio_120d", "efficiency_ratio_120d", "amihud_illiq_60d", "turnover_60d", "resid_mom_12_1", "resid_mom_6m", "mom_accel_3_6", "mom_consistency_6m",
)
#: Side tables: time, values and order among rows of equal time.
SIDES = {
    "filings": ("filed_at", FUNDS, "accession_number"),
    "estimates": ("as_of_date", tuple(ESTIMATE_FIELDS), None),
    "surprises": ("report_date", ("eps_actual", "eps_consensus", "rev_actual", "rev_consensus"), None),
    "short_interest": ("publication_date", ("days_to_cover", "short_interest", "avg_daily_volume"), "settlement_date"),
    "sentiment": ("score_date", ("rolling_7d", "rolling_14d"), None),
}


#: Names whose rows a task holds at a time: those of equal ticker_id div BLOCK.
BLOCK = 64


def month_rows(bars: DataFrame, tickers: DataFrame, market: DataFrame, grid: list, sides: Mapping[str, DataFrame] | None = None, max_stale_days: int = 7, min_pos: int = 252) -> DataFrame:
    """A row for each name and date of ``grid`` (the calendar's month ends) on which its last bar is at most so many days old and has ``min_pos`` bars before it.

    Returns, masks and price factors; with ``sides`` (tables by the keys of SIDES) also what they say as of the date.  Bars that have a column
    block (ticker_id div BLOCK) and are dealt by it aren't shuffled again."""
    block = F.floor(F.col("ticker_id") / BLOCK).alias("block")
    none = lambda kind: F.lit(None).cast(kind)
    known = tickers.select(block, "ticker_id", F.lit("").alias("side"), none("date").alias("at"), none("string").alias("tie"), F.array(F.col("shares_outstanding").cast("double")).alias("v"), "sector", "industry")
    for k, table in (sides or {}).items():
        at, values, tie = SIDES[k]
        rows = table.filter(F.col(at).isNotNull()).select(block, "ticker_id", F.lit(k).alias("side"), F.col(at).alias("at"), (F.col(tie).cast("string") if tie else none("string")).alias("tie"), F.array(*(F.col(c).cast("double") for c in values)).alias("v"), none("string").alias("sector"), none("string").alias("industry"))
        known = known.unionByName(rows)
    own = bars if "block" in bars.columns else bars.withColumn("block", block)
    own = own.filter("ticker_id is not null and trade_date is not null").join(F.broadcast(market), "trade_date", "left").select("block", "ticker_id", "trade_date", *(F.col(c).cast("double") for c in ("adj_close", "volume", "mkt")))
    dates = np.array(sorted({d for d in grid if d is not None}), "datetime64[D]").astype("int64")
    parts = {"ticker_id": bars.schema["ticker_id"].dataType.simpleString(), "bar_date": "date", "date": "date", "pos": "int", "adj_close": "double"}
    parts |= {f"{k}_{h}": t for h in HORIZONS for k, t in (("r", "double"), ("mask", "boolean"))}
    parts |= {"volume": "double", "sector": "string", "industry": "string", "shares_outstanding": "double", **dict.fromkeys(PRICE, "double")}
    if sides:
        parts |= dict.fromkeys((*FUNDS, "fund_available", *REACTION, *ANALYSTS, "short_ratio", "sentiment_7d", "sentiment_14d"), "double")
    arrow = {"date": pa.date32(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    schema, whole = pa.schema([(c, arrow[t]) for c, t in parts.items()]), bool(sides)

    def made(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("side", "ascending"), ("ticker_id", "ascending"), ("at", "ascending"), ("tie", "ascending")])
        side = pc.dictionary_encode(right["side"].combine_chunks())
        places = {k: np.flatnonzero(side.indices.to_numpy() == i) for i, k in enumerate(side.dictionary.to_pylist())}
        ids, flat = right["ticker_id"].to_numpy(), _doubles(right["v"].combine_chunks().flatten())
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(right["v"]).to_numpy())])
        names, first = np.unique(ids[places.get("", [])], return_index=True)
        if not len(names) or not left.num_rows:
            return schema.empty_table()
        first = places[""][first]
        b = _Bars(names, left)
        who, on = np.repeat(np.arange(len(names)), len(dates)), np.tile(dates, len(names))
        at = _latest(b.key, who, on)
        held = at >= 0
        held[held] &= (b.pos[at[held]] >= min_pos) & (on[held] - b.day[at[held]] <= max_stale_days)
        at, who, on = at[held], who[held], on[held]
        if not len(at):
            return schema.empty_table()
        shares = flat[starts[first]][who]
        out = {"ticker_id": names[who], "bar_date": b.day[at], "date": on, "pos": b.pos[at], "adj_close": b.c[at], "volume": b.vol[at], "shares_outstanding": shares, **_forward(b, at), **_factors(b, shares, at)}
        if whole:
            when = _days(right["at"].fill_null(0))

            def rows(k: str) -> tuple[np.ndarray, np.ndarray]:
                i, width = places.get(k, np.zeros(0, int)), len(SIDES[k][1])
                code = np.minimum(np.searchsorted(names, ids[i]), len(names) - 1)
                i, code = (x[names[code] == ids[i]] for x in (i, code))
                return _key(code, when[i]), flat[starts[i][:, None] + np.arange(width)]

            out |= _filings(*rows("filings"), b, at, who, on) | _analysts(rows("estimates"), rows("surprises"), who, on) | _shorts(*rows("short_interest"), who, on) | _mood(*rows("sentiment"), who, on)
        groups = {g: right[g].combine_chunks().take(pa.array(first[who])) for g in ("sector", "industry")}
        return pa.Table.from_arrays([groups[f.name] if f.name in groups else _column(out[f.name], f.type) for f in schema], schema=schema)

    return own.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(made, ", ".join(f"{c} {t}" for c, t in parts.items()))


def _key(who: np.ndarray, day: np.ndarray) -> np.ndarray:
    """Name and day as one number in their order."""
    return (who.astype("int64") << 24) + (day + (1 << 23))


def _latest(key: np.ndarray, who: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The place of the name's last row at or before each date, -1 where there is none."""
    i = np.searchsorted(key, _key(who, on), "right") - 1
    return np.where((i >= 0) & (np.append(key, -1)[i] >> 24 == who), i, -1)


class _Bars:
    """The bars of the names, by name and day; pos counts a name's bars from 0, begin and end are its first and past its last."""

    def __init__(self, names: np.ndarray, table: pa.Table):
        ids, day = table["ticker_id"].to_numpy(), _days(table["trade_date"])
        who = np.minimum(np.searchsorted(names, ids), len(names) - 1)
        order = np.lexsort((day, who))
        order = order[names[who[order]] == ids[order]]
        self.who, self.day = who[order], day[order]
        self.c, self.vol, self.mkt = (_doubles(table[x])[order] for x in ("adj_close", "volume", "mkt"))
        self.key = _key(self.who, self.day)
        self.begin, self.end = np.searchsorted(self.who, np.arange(len(names)), "left"), np.searchsorted(self.who, np.arange(len(names)), "right")
        self.pos = np.arange(len(order)) - self.begin[self.who]

    def lag(self, x: np.ndarray, at: np.ndarray, n: int, none: float = np.nan) -> np.ndarray:
        """The value n bars before (after, for a negative n)."""
        there = self.pos[at] >= n if n >= 0 else at - n < self.end[self.who[at]]
        return np.where(there, x[np.clip(at - n, 0, len(x) - 1)], none)

    def running(self, rows: list) -> np.ndarray:
        """Running sums of each row within each name; missing counts as 0."""
        out = np.stack([x if x.dtype == bool else _zero(x) for x in rows]).astype("float64")
        for a, z in zip(self.begin, self.end):
            np.cumsum(out[:, a:z], axis=1, out=out[:, a:z])
        return out


def _days(x) -> np.ndarray:
    return x.cast(pa.int32()).to_numpy().astype("int64")


def _doubles(x) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False) if isinstance(x, pa.Array) else x.to_numpy()


def _column(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    if pa.types.is_date(kind):
        return pa.array(x.astype("int32")).cast(kind)
    return pa.array(x, kind, from_pandas=True) if pa.types.is_floating(kind) else pa.array(x).cast(kind)


def _zero(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), 0.0, x)


def _log_ratio(a, b) -> np.ndarray:
    ok = (a > 0) & (b > 0)
    return np.where(ok, np.log(np.where(ok, a, 1.0) / np.where(ok, b, 1.0)), 0.0)


def _over(a, b, ok) -> np.ndarray:
    """a / b where ``ok``, else 0; missing is 0."""
    return _zero(np.where(ok, a / np.where(ok, b, 1.0), 0.0))


def _forward(b: _Bars, at: np.ndarray) -> dict:
    out, now = {}, b.c[at]
    for h, n in HORIZONS.items():
        later = b.lag(b.c, at, -n)
        out |= {f"r_{h}": _log_ratio(later, now), f"mask_{h}": (now > 0) & (later > 0)}
    return out


def _extreme(b: _Bars, x: np.ndarray, at: np.ndarray, n: int, largest: bool) -> np.ndarray:
    """The extreme of the name's last n values at each place, missing ones skipped."""
    none, back = -np.inf if largest else np.inf, np.arange(n)
    x = np.where(np.isnan(x), none, x)
    v = np.where(back > b.pos[at][:, None], none, x[np.maximum(at[:, None] - back, 0)])
    v = (np.max if largest else np.min)(v, axis=1)
    return np.where(v == none, np.nan, v)


def _factors(b: _Bars, shares: np.ndarray, at: np.ndarray) -> dict:
    """price_factors of the bars ``at``: sums over trailing rows are differences of running sums."""
    c, vol, m = b.c, b.vol, b.mkt
    prev = b.lag(c, np.arange(len(c)), 1)
    ok = (c > 0) & (prev > 0)
    d = np.where(ok, np.log(np.where(ok, c, 1.0) / np.where(ok, prev, 1.0)), np.nan)
    s = np.where(np.isnan(m), np.nan, _zero(d))
    dv = c * vol
    traded = (dv > 0) & ~np.isnan(d)
    sums = {
        "n": ~np.isnan(m), "x": s, "y": m, "xx": s * s, "yy": m * m, "xy": s * m,
        "k": ~np.isnan(d), "d": d, "dd": d * d, "ddd": d * d * d, "ad": np.abs(d), "neg": np.where(d < 0, d * d, np.nan),
        "p": c, "pn": ~np.isnan(c), "v": vol, "il": np.where(traded, np.abs(d) / np.where(traded, dv, 1.0), np.nan), "iln": traded,
    }
    run = dict(zip(sums, b.running(list(sums.values())), strict=True))
    upto = lambda k, n: b.lag(run[k], at, n, 0.0)
    total = lambda k, n, skip=0: upto(k, skip) - upto(k, skip + n)
    now, lag = c[at], lambda n: b.lag(c, at, n)

    def deviation(w: int) -> np.ndarray:
        n, x, xx = np.maximum(total("k", w), 1.0), total("d", w), total("dd", w)
        return np.where(n > 1, np.sqrt(np.maximum(xx / n - (x / n) * (x / n), 0.0)), 0.0)

    vols = {w: deviation(w) for w in (20, 60, 120)}
    full = total("n", 251) >= 60
    n = np.where(full, total("n", 251), 1.0)
    x, y = total("x", 251), total("y", 251)
    vx, vy, cov = total("xx", 251) / n - (x / n) * (x / n), total("yy", 251) / n - (y / n) * (y / n), total("xy", 251) / n - (x / n) * (y / n)
    beta = _over(cov, vy, full & (vy > 1e-12))
    n, sd = total("k", 120), vols[120]
    some, n = (n >= 20) & (sd > 1e-12), np.maximum(n, 1.0)
    mean = total("d", 120) / n
    third = total("ddd", 120) / n - 3 * mean * total("dd", 120) / n + 2 * mean * mean * mean
    marks = [now, *(lag(21 * i) for i in range(1, 7))]
    told = [(x > 0) & (y > 0) for x, y in zip(marks, marks[1:])]
    ups = [t & (x > y) for t, x, y in zip(told, marks, marks[1:])]
    n_up = sum(t.astype(float) for t in told)
    mom = {k: _log_ratio(now, lag(w)) for k, w in (("mom_1m", 21), ("mom_3m", 63), ("mom_6m", 126))} | {"mom_12_1": _log_ratio(lag(21), lag(252))}
    price = np.where(c > 0, c, np.nan)
    ratio = lambda x, y: np.where(y > 0, x / np.where(y > 0, y, 1.0), np.nan)
    cap = (now > 0) & (shares > 0)
    return mom | {
        "beta_252d": beta, **{f"vol_{w}d": v for w, v in vols.items()},
        "log_market_cap": np.where(cap, np.log(np.where(cap, now * shares, 1.0)), 0.0),
        "max_ret_21d": _zero(np.expm1(_extreme(b, d, at, 21, True))),
        "idio_vol": np.where(full, np.sqrt(np.maximum(vx - 2 * beta * cov + beta * beta * vy, 0.0)), sd),
        "dist_high_252": _log_ratio(now, _extreme(b, price, at, 252, True)),
        "dist_low_252": _log_ratio(now, _extreme(b, price, at, 252, False)),
        "ma_gap_50": _log_ratio(now, ratio(total("p", 50), total("pn", 50))),
        "ma_gap_200": _log_ratio(now, ratio(total("p", 200), total("pn", 200))),
        "vol_trend": _log_ratio(total("v", 20) / 20, total("v", 120) / 120),
        "ret_skew_120d": _over(third, sd * sd * sd, some),
        "downside_vol_ratio_120d": _over(np.sqrt(np.maximum(total("neg", 120), 0.0) / n), sd, some),
        "efficiency_ratio_120d": _over(np.abs(total("d", 120)), total("ad", 120), (total("k", 120) >= 20) & (total("ad", 120) > 1e-12)),
        "amihud_illiq_60d": _over(total("il", 60), total("iln", 60), total("iln", 60) > 0) * 1e6,
        "turnover_60d": _over(total("v", 60) / 60, shares, shares != 0),
        "resid_mom_12_1": mom["mom_12_1"] - beta * total("y", 231, 21),
        "resid_mom_6m": mom["mom_6m"] - beta * total("y", 126),
        "mom_accel_3_6": mom["mom_3m"] - mom["mom_6m"],
        "mom_consistency_6m": _over(sum(u.astype(float) for u in ups), n_up, n_up > 0),
    }


def _as_of(key: np.ndarray, values: np.ndarray, who: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The latest value that isn't missing; NaN where there is none."""
    there = ~np.isnan(values)
    return np.append(values[there], np.nan)[_latest(key[there], who, on)]


def _filings(key: np.ndarray, values: np.ndarray, b: _Bars, at: np.ndarray, who: np.ndarray, on: np.ndarray) -> dict:
    """Figures of the latest filing, the price's move around it, its age, and how many there were in 90 days."""
    i = _latest(key, who, on)
    some = i >= 0
    values = np.vstack([_zero(values), np.zeros(len(FUNDS))])
    out = {f: values[i, k] for k, f in enumerate(FUNDS)} | {"fund_available": some.astype(float)}
    filed = np.where(some, np.append(key, 0)[i] - _key(who, np.zeros(len(who), "int64")), 0)
    place = np.searchsorted(b.key, _key(who, filed), "left")  # its first bar
    fresh, cum, c, last = some & (place <= at), b.running([b.mkt])[0], b.c, len(b.c) - 1
    s0, s1, d0, d1 = np.maximum(place - 1, b.begin[who]), np.minimum(place + 1, at), place + 1, np.minimum(place + 31, at)

    def move(a: np.ndarray, z: np.ndarray, ok: np.ndarray) -> np.ndarray:
        a, z = np.clip(a, 0, last), np.clip(z, 0, last)
        ok = ok & (c[a] > 0) & (c[z] > 0)
        return np.where(ok, _log_ratio(c[z], c[a]) - (cum[z] - cum[a]), 0.0)

    count = np.searchsorted(key, _key(who, on), "right") - np.searchsorted(key, _key(who, on - 90), "left")
    return out | {"filing_surprise_3d": move(s0, s1, fresh & (s1 > s0)), "filing_drift_30d": move(d0, d1, fresh & (d1 - d0 >= 5)), "filings_recency_days": np.where(some, on - filed, 0).astype(float), "filings_in_90d": np.where(some, count, 0).astype(float)}


def _analysts(estimates: tuple[np.ndarray, np.ndarray], surprises: tuple[np.ndarray, np.ndarray], who: np.ndarray, on: np.ndarray) -> dict:
    key, values = estimates
    v = {(f, lag): _as_of(key, values[:, k], who, on - lag) for k, f in enumerate(ESTIMATE_FIELDS) for lag in (0, 30, 90)}
    now = {f: v[f, 0] for f in ESTIMATE_FIELDS}
    change = lambda f, lag: _over(now[f] - v[f, lag], np.abs(v[f, lag]), v[f, lag] != 0)
    inverse = lambda x: _over(np.ones(len(on)), x, x > 0)
    told, s = surprises
    with np.errstate(divide="ignore", invalid="ignore"):
        beats = [np.where(s[:, b] != 0, (s[:, a] - s[:, b]) / np.abs(s[:, b]), np.nan) for a, b in ((0, 1), (2, 3))]
    eps, revenue = (_zero(_as_of(told, x, who, on)) for x in beats)
    return {
        "rec_mean_level": _zero(now["rec_mean"]), "rec_rev_30d": _zero(v["rec_mean", 30] - now["rec_mean"]), "rec_rev_90d": _zero(v["rec_mean", 90] - now["rec_mean"]),
        "price_target_mean": _zero(now["price_target_mean"]), "price_target_rev_90d": change("price_target_mean", 90),
        "forward_earnings_yield": inverse(now["fwd_pe"]), "forward_ebitda_yield": inverse(now["fwd_ev_ebitda"]), "revenue_surprise": revenue, "eps_surprise": eps,
        "eps_est_rev_30d": change("eps_mean", 30), "eps_est_rev_90d": change("eps_mean", 90), "coverage_chg_90d": _zero(now["num_analysts"] - v["num_analysts", 90]), "pt_num_estimates": _zero(now["pt_num_estimates"]),
        "eps_dispersion": _over(now["eps_std"], np.abs(now["eps_mean"]), np.abs(now["eps_mean"]) >= 0.01),
    }


def _shorts(key: np.ndarray, values: np.ndarray, who: np.ndarray, on: np.ndarray) -> dict:
    cover, interest, volume = np.vstack([values, np.full(3, np.nan)])[_latest(key, who, on)].T
    return {"short_ratio": np.where(cover > 0, cover, _over(interest, volume, volume > 0))}


def _mood(key: np.ndarray, values: np.ndarray, who: np.ndarray, on: np.ndarray, max_days: int = 3) -> dict:
    i = _latest(key, who, on)
    near = (i >= 0) & (_key(who, on) - np.append(key, 0)[i] <= max_days)
    week, fortnight = np.where(near[:, None], _zero(np.vstack([values, np.zeros(2)])[i]), 0.0).T
    return {"sentiment_7d": week, "sentiment_14d": fortnight}
