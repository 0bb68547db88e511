"""Time expressions: parsing, zones, day bounds, freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Tokyo"


def parsed_utc(value: Column) -> Column:
    """ISO text, with or without zone, as a UTC timestamp; null if it is none."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])


def to_local(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def to_utc(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_utc_timestamp(ts, zone)


def local_day(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(to_local(ts, zone))


def day_start_utc(day: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def in_local_days(ts: Column, first: Column, last: Column, zone: str = LOCAL_ZONE) -> Column:
    """Whether ``ts`` lies in the inclusive range of local days."""
    return (ts >= day_start_utc(first, zone)) & (ts < day_start_utc(F.date_add(last, 1), zone))


def age_days(ts: Column, now: Column) -> Column:
    """Days before ``now``, not below 0; null for a null time."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000)


def freshness(ts: Column, now: Column) -> Column:
    age = age_days(ts, now)
    return F.when(age <= 7, 1.0).when(age <= 30, 0.8).when(age <= 90, 0.6).otherwise(0.4)


def recency_boost(ts: Column, now: Column, exempt: Column) -> Column:
    boost = F.greatest(F.lit(-0.05), F.least(F.lit(0.05), 0.05 * (60 - age_days(ts, now)) / 60))
    return F.when(exempt | ts.isNull(), 0.0).otherwise(boost)


def recency_signal(ts: Column, now: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age_days(ts, now) / 365)), F.lit(0.5))
