"""Column expressions that several operators share. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.timeaxis import Window

#: What lies between the bucket starts of a grid.
STEPS = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}


def stamp(moment: datetime | date) -> Column:
    """A literal without a zone, as the tables' times are."""
    return F.lit(str(moment)).cast("timestamp_ntz")


def bucket_of(ts: Column, bucket: str) -> Column:
    """The start of the bucket that holds ts, as a date; weeks start on Monday."""
    return ts.cast("date") if bucket == "day" else F.to_date(F.date_trunc(bucket, ts.cast("date")))


def bucket_key(day: Column, bucket: str) -> Column:
    """The key that a bucket's start stands for: 2026-08-20, 2026-W33 (of the year that holds the week's Thursday) or 2026-08."""
    week = F.concat_ws("-W", F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    return {"day": F.date_format(day, "yyyy-MM-dd"), "week": week, "month": F.date_format(day, "yyyy-MM")}[bucket]


def night_of(ts: Column) -> Column:
    """The day on which the night that holds ts ends: nights run from noon to noon."""
    return (ts + F.expr("interval 12 hours")).cast("date")


def in_window(ts: Column, window: Window) -> Column:
    return (ts >= stamp(window.start)) & (ts < stamp(window.end))


def grid(spark: SparkSession, window: Window, bucket: str) -> DataFrame:
    """(ordinal, bucket): the buckets of a window; at most MOST_POINTS rows."""
    window.guard(bucket)
    days = window.grid(bucket)
    return spark.createDataFrame([(k, d) for k, d in enumerate(days)], "ordinal int, bucket date")


def source_rank(source: Column, metric: Column, priority: dict[str, tuple[str, ...]]) -> Column:
    """The place of the first pattern that the source's name holds; a source without one comes last."""
    rank = F.lit(0)
    for name, patterns in priority.items():
        own = F.lit(len(patterns))
        for k in range(len(patterns) - 1, -1, -1):
            own = F.when(F.contains(F.lower(source), F.lit(patterns[k])), k).otherwise(own)
        rank = F.when(metric == name, own).otherwise(rank)
    return rank


def snake(s: Column) -> Column:
    """CamelCase to snake_case, one underscore before every capital but the first character."""
    return F.lower(F.regexp_replace(s, "(?<!^)([A-Z])", "_$1"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points of a sphere with the Earth's mean radius; null where a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))


def content_key(*parts: Column) -> Column:
    """A digest of the parts, with nulls as empty strings."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
