"""Column expressions shared by all layers. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from milepost import schemas as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- time -------------------------------------------------------------------
def parse_month_day_time(text, year: str = S.TECHNICAL_YEAR) -> Column:
    """``MM-DD HH:MM:SS`` with a pinned year; null if it is no real moment.

    A cast parses several times faster than a format pattern; the shape is
    checked first because a cast alone would accept more forms.
    """
    t = _c(text)
    moment = F.concat(F.lit(f"{year}-"), t).try_cast("timestamp")
    return F.when(t.rlike(r"^\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), moment)


def parse_day_partition(text, year: str = S.TECHNICAL_YEAR) -> Column:
    """``MMDD`` with a pinned year; null if it is no real day."""
    t = _c(text)
    day = F.concat_ws("-", F.lit(year), F.substring(t, 1, 2), F.substring(t, 3, 2))
    return F.when(t.rlike(r"^\d{4}$"), day.try_cast("timestamp"))


def minutes_between(start, end) -> Column:
    """``end - start`` in (fractional) minutes."""
    micros = F.unix_micros(_c(end)) - F.unix_micros(_c(start))
    return micros / F.lit(60_000_000.0)


def minus_minutes(moment, minutes) -> Column:
    """``moment`` moved back by fractional minutes."""
    micros = F.round(_c(minutes) * F.lit(60_000_000.0)).cast("bigint")
    return F.timestamp_micros(F.unix_micros(_c(moment)) - micros)


def rollover_duration(start, end) -> Column:
    """Minutes between two moments; a negative value gets one day, once."""
    raw = minutes_between(start, end)
    return F.when(raw < 0, raw + S.DAY_MINUTES).otherwise(raw)


def iso_weekday(moment) -> Column:
    """Monday 1 ... Sunday 7."""
    return F.weekday(_c(moment)) + 1


def day_period(hour) -> Column:
    h = _c(hour)
    return (
        F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon")
        .otherwise("evening")
    )


def utc_text(moment) -> Column:
    """A moment as ``2000-09-25 00:00:00+00``."""
    return F.concat(F.date_format(_c(moment), "yyyy-MM-dd HH:mm:ss"), F.lit("+00"))


# -- rounding and rates -------------------------------------------------------
def half_even(x, digits: int) -> Column:
    """Scale, round ties to even, scale back."""
    scale = float(10**digits)
    return F.rint(_c(x) * F.lit(scale)) / F.lit(scale)


def safe_rate(part, whole) -> Column:
    """Percentage with two digits, ties to even; 0.0 without a denominator."""
    n, d = F.coalesce(_c(part), F.lit(0)), F.coalesce(_c(whole), F.lit(0))
    return F.when(d > 0, half_even(n / d * 100, 2)).otherwise(F.lit(0.0))


def mart_rate(part, whole) -> Column:
    """Percentage with two digits, ties away from zero on exact decimals; else null."""
    n = (_c(part) * 100).cast("decimal(24,0)")
    d = F.nullif(_c(whole), F.lit(0)).cast("decimal(20,0)")
    return F.round(n / d, 2).cast("double")


def mart_mean(total, count) -> Column:
    """Mean with two digits, ties away from zero; null without rows."""
    mean = _c(total) / F.nullif(_c(count), F.lit(0))
    return F.round(mean.cast("decimal(30,12)"), 2).cast("double")


def ratio(part, whole) -> Column:
    """Plain ratio, 0.0 without a denominator."""
    n, d = _c(part), _c(whole)
    return F.when(d == 0, F.lit(0.0)).otherwise(n / F.nullif(d, F.lit(0)))


# -- coordinates --------------------------------------------------------------
def finite(x) -> Column:
    """True if the number is neither null, NaN nor infinite."""
    v = _c(x)
    return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def in_range(x, limit: float) -> Column:
    return _c(x).between(-limit, limit)


def gps_usable(lng, lat, near_zero: float = S.NEAR_ZERO_DEGREES) -> Column:
    """Both present, neither near zero, both within the globe."""
    x, y = _c(lng), _c(lat)
    ok = (
        (F.abs(x) >= near_zero) & (F.abs(y) >= near_zero)
        & in_range(x, 180.0) & in_range(y, 90.0)
    )
    return F.coalesce(ok, F.lit(False))


def gps_status(accept_ok, delivery_ok) -> Column:
    a, d = _c(accept_ok), _c(delivery_ok)
    return (
        F.when(a & d, "complete").when(d, "missing_or_invalid_accept")
        .when(a, "missing_or_invalid_delivery").otherwise("missing_or_invalid_both")
    )


def duration_status(minutes, long_limit: float = S.LONG_DURATION_MINUTES) -> Column:
    m = _c(minutes)
    return (
        F.when(m.isNull(), "missing").when(m <= 0, "zero_or_negative")
        .when(m > long_limit, "long").otherwise("normal")
    )


# -- hashes and ids -------------------------------------------------------------
def hash_byte(order_id, salt: str) -> Column:
    """First byte of ``md5(id:salt)``: a stable bucket 0..255."""
    text = F.concat(_c(order_id).cast("string"), F.lit(f":{salt}"))
    return F.conv(F.substring(F.md5(text), 1, 2), 16, 10).cast("int")


# Fixed value: the RFC 4122 namespace for URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name, namespace_hex: str = URL_NAMESPACE) -> Column:
    """Name-based UUID, version 5, as text."""
    digest = F.sha1(
        F.concat(F.unhex(F.lit(namespace_hex)), F.encode(_c(name), "UTF-8"))
    )
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((nibble.bitwiseAND(3)).bitwiseOR(8).cast("bigint")))
    parts = (
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
    return F.concat_ws("-", *parts)


def key_hash(*parts) -> Column:
    """md5 over the parts joined with ``||``; null parts are skipped."""
    return F.md5(F.concat_ws("||", *[_c(p) for p in parts]))


# -- probability ----------------------------------------------------------------
def shift_probability(p, pressure, strength) -> Column:
    """Move a probability by ``strength * ln(pressure)`` on the log-odds scale."""
    p, pressure, strength = _c(p), _c(pressure), _c(strength)
    z = F.ln(p) - F.log1p(-p) + strength * F.ln(pressure)
    sigmoid = F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))
    return (
        F.when(p <= 0, F.lit(0.0)).when(p >= 1, F.lit(1.0)).when(strength == 0, p)
        .otherwise(sigmoid)
    )


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)
