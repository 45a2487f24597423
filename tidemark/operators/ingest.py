"""Ingest: vendor records into families, by data and joins with small tables; idempotent by content key; nothing is dropped."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import METRICS, STATES, vendor_types
from tidemark.functions.columns import content_key, snake

# Units by dimension, as multiples of a base unit.
UNITS = {
    "mass": {"kg": 1000.0, "g": 1.0, "mg": 0.001, "mcg": 1e-6, "µg": 1e-6, "lb": 453.59237, "oz": 28.349523125, "st": 6350.29318},
    "length": {"km": 1000.0, "m": 1.0, "cm": 0.01, "mm": 0.001, "mi": 1609.344, "ft": 0.3048, "in": 0.0254, "yd": 0.9144},
    "energy": {"kcal": 1000.0, "cal": 1.0, "kJ": 239.005736, "J": 0.239005736},
    "volume": {"L": 1000.0, "mL": 1.0, "l": 1000.0, "ml": 1.0},
    "time": {"hr": 3600.0, "min": 60.0, "s": 1.0, "sec": 1.0, "ms": 0.001},
    "speed": {"m/s": 1.0, "km/hr": 1000 / 3600, "km/h": 1000 / 3600, "mph": 0.44704},
    "percent": {"%": 1.0},
    "count": {"count": 1.0},
}
# Kinds of states and their values by vendor name.
STATE_KINDS = {"HKCategoryTypeIdentifierSleepAnalysis": "sleep", "HKCategoryTypeIdentifierAppleStandHour": "stand"}
STATE_VALUES = {
    "HKCategoryValueSleepAnalysisInBed": "in_bed", "HKCategoryValueSleepAnalysisAsleepUnspecified": "asleep", "HKCategoryValueSleepAnalysisAsleepCore": "asleep_core",
    "HKCategoryValueSleepAnalysisAsleepDeep": "asleep_deep", "HKCategoryValueSleepAnalysisAsleepREM": "asleep_rem", "HKCategoryValueSleepAnalysisAwake": "awake",
    "HKCategoryValueAppleStandHourStood": "stood", "HKCategoryValueAppleStandHourIdle": "idle",
}
VENDOR_TIME = "yyyy-MM-dd HH:mm:ss Z"
MANUAL_SKEW = timedelta(minutes=5)
MOST_MANUAL = 200


def units_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, d, f) for d, us in UNITS.items() for u, f in us.items()], "unit string, dimension string, factor double")


def converted(value: Column, from_unit: Column, to_unit: Column, from_dim: Column, from_factor: Column, to_dim: Column, to_factor: Column) -> Column:
    """value in another unit: itself for equal units, affine for temperatures, by factor within a dimension, else null."""
    celsius = F.when(from_unit == "degC", value).when(from_unit == "degF", (value - 32) * 5 / 9).when(from_unit == "K", value - 273.15)
    degrees = F.when(to_unit == "degC", celsius).when(to_unit == "degF", celsius * 9 / 5 + 32).when(to_unit == "K", celsius + 273.15)
    scales = ["degC", "degF", "K"]
    either = from_unit.isin(scales) | to_unit.isin(scales)
    return F.when(from_unit == to_unit, value).when(either, degrees).when(from_dim == to_dim, value * from_factor / to_factor)


def convert_units(spark: SparkSession, df: DataFrame, value: str, from_unit: str, to_unit: str, out: str) -> DataFrame:
    """df with the column out: value converted, null if it can't be. The table of units is fixed and small."""
    side = lambda p: F.broadcast(units_table(spark).select(F.col("unit").alias(f"_{p}_unit"), F.col("dimension").alias(f"_{p}_dim"), F.col("factor").alias(f"_{p}_factor")))
    joined = df.join(side("f"), F.col(from_unit) == F.col("_f_unit"), "left").join(side("t"), F.col(to_unit) == F.col("_t_unit"), "left")
    made = converted(F.col(value), F.col(from_unit), F.col(to_unit), F.col("_f_dim"), F.col("_f_factor"), F.col("_t_dim"), F.col("_t_factor"))
    return joined.withColumn(out, made).select(*[c for c in df.columns if c != out], out)


def vendor_time(s: Column) -> Column:
    """A vendor's time as UTC without a zone; null if it doesn't parse."""
    return F.convert_timezone(None, F.lit("UTC"), F.try_to_timestamp(s, F.lit(VENDOR_TIME)).cast("timestamp_ntz"))


def state_value(s: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in STATE_VALUES.items() for x in kv))
    return F.coalesce(F.element_at(known, s), snake(F.regexp_replace(s, "^HKCategoryValue", "")))


def activity_type(s: Column) -> Column:
    return snake(F.regexp_replace(s, "^HKWorkoutActivityType", ""))


TIMES = ("account_id", "start_at", "end_at", "start_raw", "end_raw", "source", "seq")
#: What each family keeps of a tagged record, and under which name.
KEPT = {
    "measurements": {"metric": "metric", "canonical": "value", "unit": "original_unit"},
    "states": {"kind": "kind", "state": "state_value"},
    "unmapped": {"type": "source_type", "value": "value", "unit": "unit"},
}


def tag_records(spark: SparkSession, records: DataFrame, account_id: int | None = None) -> DataFrame:
    """records (type, unit, value, source, start_raw, end_raw, seq: all strings but seq; account_id, unless it is given) with their family, name in it (metric, state or vendor
    type), content_key and all that the families keep. Each record is typed, converted and keyed once."""
    if account_id is not None:
        records = records.withColumn("account_id", F.lit(account_id).cast("bigint"))
    typed = records.join(F.broadcast(vendor_types(spark)).withColumnRenamed("unit", "to_unit"), F.col("type") == F.col("vendor_type"), "left").withColumn("number", F.expr("try_cast(value AS double)"))
    typed = convert_units(spark, typed, "number", "unit", "to_unit", "canonical").withColumns({"start_at": vendor_time(F.col("start_raw")), "end_at": vendor_time(F.col("end_raw"))})
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in STATE_KINDS.items() for x in kv)), F.col("type"))
    family = F.when(kind.isNotNull(), "states").when(F.col("canonical").isNotNull(), "measurements").otherwise("unmapped")
    tagged = typed.withColumns({"kind": kind, "family": family, "state": state_value(F.col("value"))})
    spans = ("source", "start_raw", "end_raw", "value", "unit")
    keys = {
        "measurements": content_key(F.col("metric"), *map(F.col, spans)), "states": content_key(F.lit("state"), F.col("kind"), *map(F.col, spans[:-1])), "unmapped": content_key(F.col("type"), *map(F.col, spans)),
    }
    of = lambda by: F.when(F.col("family") == "measurements", by["measurements"]).when(F.col("family") == "states", by["states"]).otherwise(by["unmapped"])
    return tagged.withColumns({"content_key": of(keys), "name": of({"measurements": F.col("metric"), "states": F.col("state"), "unmapped": F.col("type")})})


def of_family(tagged: DataFrame, family: str) -> DataFrame:
    """The rows of one family of tagged records, with its columns."""
    return tagged.filter(F.col("family") == family).select(*(F.col(c).alias(n) for c, n in KEPT[family].items()), *TIMES, "content_key")


def route_records(spark: SparkSession, records: DataFrame, account_id: int | None = None) -> dict[str, DataFrame]:
    """records into measurements, states and unmapped ones. To read more than one of them, write what tag_records says by family first, as an import does."""
    tagged = tag_records(spark, records, account_id)
    return {family: of_family(tagged, family) for family in KEPT}


#: What makes a row one row: accounts never share rows.
UNIQUE = ("account_id", "content_key")


def first_of_each(batch: DataFrame, order: str = "seq", key: tuple[str, ...] = UNIQUE) -> DataFrame:
    """The first row of each key, in file order, with the row count of the key as copies."""
    row = F.struct(*batch.columns)
    return batch.groupBy(*key).agg(F.min_by(row, order).alias("_row"), F.count("*").alias("copies")).select("_row.*", "copies")


def new_rows(batch: DataFrame, stored: DataFrame, order: str = "seq", key: tuple[str, ...] = UNIQUE) -> DataFrame:
    """Rows of the batch that the store doesn't have, one for each account and content: adding them twice is a no-op."""
    return first_of_each(batch, order, key).join(stored.select(*key), list(key), "left_anti").drop("copies")


def report(batch: DataFrame, stored: DataFrame, family: str, by: str, key: tuple[str, ...] = UNIQUE) -> DataFrame:
    """(account_id, family, name, added, skipped) of a batch against the store."""
    seen = stored.select(*key).distinct().withColumn("_seen", F.lit(True))
    ruled = first_of_each(batch.select(*key, by, "seq"), key=key).join(seen, list(key), "left")
    added = F.col("_seen").isNull()
    return ruled.groupBy(key[0], F.lit(family).alias("family"), F.col(by).alias("name")).agg(F.count_if(added).alias("added"), F.sum(F.col("copies") - F.when(added, 1).otherwise(0)).alias("skipped"))


def duration_seconds(value: Column, unit: Column) -> Column:
    """A workout's duration: 0 if it doesn't parse, as it stands for unknown units."""
    number = F.coalesce(value.try_cast("double"), F.lit(0.0))
    return number * F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in UNITS["time"].items() for x in kv)), unit), F.lit(1.0))


class ManualError(ValueError):
    """A manual entry that can't be stored."""


def manual_entry(spark: SparkSession, account_id: int, metric: str, value: float, at, now) -> DataFrame:
    """One validated row: a known, imported, scalar metric; a finite value; not in the future but for a little skew."""
    known = METRICS.get(metric)
    if known is None or known.formula or known.rule == STATES:
        raise ManualError(f"{metric} can't be entered by hand")
    if value != value or value in (float("inf"), float("-inf")):
        raise ManualError("the value is not finite")
    if at > now + MANUAL_SKEW:
        raise ManualError("the time lies in the future")
    row = spark.createDataFrame([(account_id, metric, float(value), known.unit, at, at, "Manual")], "account_id bigint, metric string, value double, original_unit string, start_at timestamp_ntz, end_at timestamp_ntz, source string")
    return row.withColumn("content_key", content_key(*(F.col(n) for n in ("metric", "source", "start_at", "end_at", "value", "original_unit"))))


def delete_manual(measurements: DataFrame, account_id: int, row_id: int) -> DataFrame:
    """The store without one manual row; rows of devices stay whatever the id."""
    return measurements.filter(~((F.col("account_id") == account_id) & (F.col("id") == row_id) & (F.col("source") == "Manual")))


def list_manual(measurements: DataFrame, metric: str | None = None, limit: int = MOST_MANUAL) -> DataFrame:
    """Manual rows, newest first, MOST_MANUAL at most."""
    rows = measurements.filter(F.col("source") == "Manual")
    rows = rows.filter(F.col("metric") == metric) if metric else rows
    return rows.orderBy(F.desc("start_at"), F.desc("id")).limit(min(limit, MOST_MANUAL))
