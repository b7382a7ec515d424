"""Null- and zero-safe scalar expressions; each takes and gives columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def log_ratio(a, b) -> Column:
    """log(a / b); 0 where either is null or not positive."""
    a, b = col(a), col(b)
    return F.coalesce(F.when((a > 0) & (b > 0), F.ln(a / b)), F.lit(0.0))


def safe_ratio(a, b) -> Column:
    """a / b; 0 where either is null or the denominator is within 1e-9 of 0."""
    a, b = col(a), col(b)
    return F.coalesce(F.when(F.abs(b) > 1e-9, a / b), F.lit(0.0))


def months_before(d, months: int) -> Column:
    """The same day so many months earlier, clamped to the month's length."""
    return F.add_months(col(d), -months)


def close_bucket(ts, zone: str = "America/New_York") -> Column:
    """Date a headline counts for: from 16:00 local time on the next calendar day."""
    return F.to_date(F.from_utc_timestamp(col(ts), zone) + F.expr("INTERVAL 8 HOURS"))


def signed_sentiment(pos, neg, neu) -> tuple[Column, Column]:
    """Score (positive - negative) and the label of the largest probability."""
    pos, neg, neu = col(pos), col(neg), col(neu)
    top = F.greatest(pos, neg, neu)
    return pos - neg, F.when(pos == top, "pos").when(neg == top, "neg").otherwise("neu")


def seasonal(d) -> tuple[Column, Column]:
    angle = F.dayofyear(col(d)) * (2 * 3.141592653589793 / 365.25)
    return F.sin(angle), F.cos(angle)


def _bound(value: Column, use) -> Column:
    """``use(v)`` with ``value`` computed once: inside a lambda a plain expression is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def zscore_array(a) -> Column:
    """(x - mean) / population deviation of an array; zeros where the deviation is below 1e-9."""

    def centred(a):
        mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
        return _bound(mean, lambda m: F.transform(a, lambda x: x - m))

    def scaled(c):
        dev = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x) / F.size(c))
        return _bound(dev, lambda v: F.transform(c, lambda x: F.when(v < 1e-9, 0.0).otherwise(x / v)))

    return _bound(col(a), lambda v: _bound(centred(v), scaled))


def safe_corr(x, y) -> Column:
    """Aggregate: Pearson correlation, null for one row or no variance."""
    x, y = col(x), col(y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def tier(x, high: float, low: float, names=("high", "mid", "low")) -> Column:
    x = col(x)
    return F.when(x >= high, names[0]).when(x > low, names[1]).when(x.isNotNull(), names[2])
