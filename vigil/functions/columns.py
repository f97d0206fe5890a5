"""Pure Column expressions (JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite_or(c, default=0.0) -> Column:
    """null / NaN / +-inf -> default (feature alignment, P13)."""
    c = col(c)
    return F.when(is_finite(c), c).otherwise(F.lit(default))


def safe_div(a, b) -> Column:
    """a / b, null where b is 0 or null (ANSI mode would raise)."""
    return F.try_divide(col(a), col(b))


def rnd(c, d: int = 6) -> Column:
    return F.round(col(c), d)


EPOCH_NTZ = "1970-01-01 00:00:00"


def micros(ts) -> Column:
    """Wall-clock timestamp -> microseconds since 1970-01-01 00:00, without
    consulting the session time zone (readings carry no zone; the driver
    tables are TIMESTAMP_NTZ)."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), col(ts).cast("timestamp_ntz"))


def from_micros_ntz(us) -> Column:
    """Inverse of :func:`micros`: microseconds -> TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", col(us), F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def event_time(ts) -> Column:
    """A TIMESTAMP instant for watermarks / windows whose UTC reading equals
    the wall clock, whatever the session zone."""
    return F.timestamp_micros(micros(ts))


def epoch_seconds(ts) -> Column:
    """Timestamp -> double seconds, computed from exact microseconds."""
    return micros(ts) / F.lit(1_000_000.0)


def row_mean(cols) -> Column:
    """Mean of the non-null values among ``cols`` (pandas ``mean(axis=1)``)."""
    cols = [col(c) for c in cols]
    s = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    return F.try_divide(s, n)


def clip(c, lo=None, hi=None) -> Column:
    c = col(c)
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return c


def to_tinyint_bool(c) -> Column:
    """bool / 'True' / 'true' / 1 -> 1, else 0; null stays null."""
    s = F.lower(F.trim(col(c).cast("string")))
    return (F.when(s.isin("true", "1", "1.0"), 1)
            .when(s.isin("false", "0", "0.0"), 0)
            .cast("tinyint"))


def exp_response(t, start, target, tau) -> Column:
    """First-order response: target + (start - target) * exp(-t / tau) (F8)."""
    return col(target) + (col(start) - col(target)) * F.exp(-col(t) / col(tau))


def logistic_response(t, start, target, duration) -> Column:
    """S-curve from start to target over ``duration``: logistic of t/dur*10-5 (F8)."""
    z = col(t) / col(duration) * 10 - 5
    return col(start) + (col(target) - col(start)) / (1 + F.exp(-z))


def checksum8(binary) -> Column:
    """Sum of the bytes of a binary column, mod 256."""
    h = F.hex(col(binary))
    idx = F.sequence(F.lit(0), (F.length(h) / 2 - 1).cast("int"))
    byts = F.transform(idx, lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(F.length(h) == 0, F.lit(0)).otherwise(
        F.aggregate(byts, F.lit(0), lambda acc, b: acc + b) % 256)
