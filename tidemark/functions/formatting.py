"""Figures as they are read: durations, paces and speeds, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a figure that there is none of.
NOTHING = "—"


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def duration(minutes: Column) -> Column:
    """Minutes as hours and minutes: 432 is 7h 12m, 47 is 47m."""
    total = F.round(F.abs(minutes)).cast("bigint")
    h, m = F.floor(total / 60).cast("bigint"), total % 60
    text = F.when(h == 0, F.concat(m.cast("string"), F.lit("m"))).otherwise(F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m")))
    return F.concat(F.when(minutes < 0, "-").otherwise(""), text)


def session_duration(seconds: Column) -> Column:
    """Seconds as 1h 04m, 48m or, under a minute, 30s."""
    total = F.greatest(F.round(seconds), F.lit(0.0)).cast("bigint")
    h, m = F.floor(total / 3600).cast("bigint"), F.floor(total % 3600 / 60).cast("bigint")
    short = F.when(m == 0, F.concat((total % 60).cast("string"), F.lit("s"))).otherwise(F.concat(m.cast("string"), F.lit("m")))
    return F.when(seconds.isNotNull(), F.when(h == 0, short).otherwise(F.concat(h.cast("string"), F.lit("h "), _two(m), F.lit("m"))))


def pace(kmh: Column) -> Column:
    """Minutes for a kilometre, to the second: 10 km/h is 6:00/km."""
    seconds = F.round(F.lit(3600) / F.nullif(kmh, F.lit(0.0))).cast("bigint")
    text = F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), _two(seconds % 60), F.lit("/km"))
    return F.coalesce(F.when((kmh > 0) & (kmh < float("inf")), text), F.lit(NOTHING))


def speed(kmh: Column) -> Column:
    """Kilometres an hour with at most one decimal: 28,4 km/h."""
    shown = F.regexp_replace(F.format_string("%.1f", F.round(kmh, 1)), "\\.0$", "")
    return F.coalesce(F.when(kmh.isNotNull() & ~F.isnan(kmh) & (F.abs(kmh) < float("inf")), F.concat(F.replace(shown, F.lit("."), F.lit(",")), F.lit(" km/h"))), F.lit(NOTHING))


def reading(kind: Column, kmh: Column) -> Column:
    """A session's speed as its activity is read: as a pace, as a speed, or not at all."""
    return F.when(kind == "pace", pace(kmh)).when(kind == "speed", speed(kmh))
