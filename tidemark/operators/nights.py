"""Sleep: states into nights. A source is elected for each night, nights are folded into buckets by their label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.catalog import PRIORITY
from tidemark.functions.columns import bucket_of, night_of, source_rank, stamp
from tidemark.plans.timeaxis import Window, shift

ASLEEP = "asleep"
IN_BED = "in_bed"


def ceil_day(moment):
    """The day of a moment, or the next one if it isn't midnight."""
    day = moment.date()
    return day if moment == Window.of(day, day).start else shift(day, days=1)


def in_minutes(micros: Column) -> Column:
    return micros.cast("double") / F.lit(60e6)


def stage_minutes(states: DataFrame, window: Window, priority: dict | None = None) -> DataFrame:
    """(account_id, night, source, state_value, minutes, micros) of the rows that count; micros is the time in whole microseconds, so that sums of it are exact.

    Both bounds are rounded up to a day. The elected source is the best ranked of those that staged the night, or else of all that
    night; in-bed rows go where it staged the night. A bound on start_at, a day wider, lets the scan skip files.
    """
    lo, hi = ceil_day(window.start), ceil_day(window.end)
    near = states.filter((F.col("kind") == "sleep") & (F.col("start_at") >= stamp(shift(lo, days=-1))) & (F.col("start_at") < stamp(shift(hi, days=1))))
    rows = near.withColumn("night", night_of(F.col("start_at"))).filter((F.col("night") >= F.lit(lo)) & (F.col("night") < F.lit(hi)))
    micros = (F.unix_micros(F.col("end_at").cast("timestamp")) - F.unix_micros(F.col("start_at").cast("timestamp"))).cast("decimal(18,0)")
    # Once by night, source and stage; the election then sees a few rows a night.
    summed = rows.groupBy("account_id", "night", "source", "state_value").agg(F.sum(F.when(micros > 0, micros)).alias("micros"))
    night = W.partitionBy("account_id", "night")
    asleep = F.col("state_value").startswith(ASLEEP)
    ranked = F.struct(source_rank(F.col("source"), F.lit("sleep"), PRIORITY if priority is None else priority).alias("rank"), F.col("source"))
    best = F.coalesce(F.min(F.when(asleep, ranked)).over(night), F.min(ranked).over(night))
    marked = summed.withColumns({"_best": best, "_staged": F.max(asleep).over(night)})
    kept = marked.filter((F.col("source") == F.col("_best.source")) & ~((F.col("state_value") == IN_BED) & F.col("_staged")) & F.col("micros").isNotNull())
    return kept.select("account_id", "night", "source", "state_value", in_minutes(F.col("micros")).alias("minutes"), "micros")


def nights(stages: DataFrame) -> DataFrame:
    """(account_id, night, source, value): minutes asleep, or in bed where none are; awake never counts, but makes a night."""
    asleep = F.sum(F.when(F.col("state_value").startswith(ASLEEP), F.col("micros")).otherwise(0))
    in_bed = F.sum(F.when(F.col("state_value") == IN_BED, F.col("micros")).otherwise(0))
    return stages.groupBy("account_id", "night", "source").agg(in_minutes(F.when(asleep > 0, asleep).otherwise(in_bed)).alias("value"))


def fold_nights(found: DataFrame, bucket: str) -> DataFrame:
    """(account_id, bucket, value, count): sums of night values and the number of nights."""
    return found.groupBy("account_id", bucket_of(F.col("night"), bucket).alias("bucket")).agg(F.sum("value").alias("value"), F.count("*").alias("count"))


#: The order in which the stages of a night are shown; stages that are not named come last, by name.
STAGE_ORDER = ("asleep_deep", "asleep_core", "asleep_rem", "asleep", "in_bed", "awake")


def fold_stages(stages: DataFrame, bucket: str) -> DataFrame:
    """(account_id, bucket, states): minutes of each stage as a map, in STAGE_ORDER."""
    summed = stages.groupBy("account_id", bucket_of(F.col("night"), bucket).alias("bucket"), "state_value").agg(in_minutes(F.sum("micros")).alias("minutes"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STAGE_ORDER)), F.col("state_value")), F.lit(0)), F.lit(len(STAGE_ORDER) + 1))
    ordered = F.sort_array(F.collect_list(F.struct(place.alias("place"), "state_value", "minutes")))
    return summed.groupBy("account_id", "bucket").agg(F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["state_value"], x["minutes"]))).alias("states"))


def sleep_summary(found: DataFrame, priority: dict | None = None) -> DataFrame:
    """(account_id, value, nights, source): all nights together, and the best-ranked of their sources."""
    ranked = F.struct(source_rank(F.col("source"), F.lit("sleep"), PRIORITY if priority is None else priority).alias("rank"), F.col("source"))
    summed = found.groupBy("account_id").agg(F.sum("value").alias("value"), F.count("*").alias("nights"), F.min(ranked).alias("_best"))
    return summed.select("account_id", "value", "nights", F.col("_best.source").alias("source"))
