"""Series: resolved days into points, by each metric's own rule, for all accounts and metrics at once; and formulas over points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import AVERAGE, LATEST, SUM
from tidemark.functions.columns import bucket_of, in_window
from tidemark.operators.nights import fold_nights, nights, sleep_summary, stage_minutes
from tidemark.operators.resolve import resolved_days
from tidemark.plans.timeaxis import Window

KEYS = ["account_id", "metric"]


def by_rule() -> Column:
    """The value of a group of daily rows by its metric's rule; the group has the column rule."""
    rule = F.col("rule")
    return F.when(rule == SUM, F.sum("total")).when(rule == AVERAGE, F.sum("total") / F.sum("k")).otherwise(F.max_by("latest", "latest_at"))


def _by_rule() -> list[Column]:
    """A group of daily rows by its metric's rule: value, band and count."""
    band = lambda f, c: F.when(F.col("rule") == AVERAGE, f(c))
    return [by_rule().alias("value"), band(F.min, "low").alias("min"), band(F.max, "high").alias("max"), F.sum("n").alias("count")]


def points(days: DataFrame, bucket: str, keys: list[str] = KEYS) -> DataFrame:
    """(keys, bucket, value, min, max, count) of daily rows: empty buckets are absent, bands belong to averages."""
    return days.groupBy(*keys, "rule", bucket_of(F.col("day"), bucket).alias("bucket")).agg(*_by_rule()).drop("rule")


def summary(days: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, value, min, max, count, mean): the window as one bucket over the same rows; mean for metrics that keep their latest value."""
    mean = F.when(F.col("rule") == LATEST, F.sum("total") / F.sum("k")).alias("mean")
    return days.groupBy(*keys, "rule").agg(*_by_rule(), mean).drop("rule")


def series(measurements: DataFrame, rules: DataFrame, window: Window, bucket: str, priority: dict | None = None) -> DataFrame:
    window.guard(bucket)
    return points(resolved_days(measurements, rules, [window], priority), bucket)


#: What a value may carry besides itself; derived values have none of it.
CARRIED = ("min", "max", "count", "mean")


def evaluate(values: DataFrame, terms: DataFrame, keys: list[str], with_operands: bool = False, carried: tuple[str, ...] = CARRIED) -> DataFrame:
    """Formulas over values (keys, metric, value): (keys, metric, value) of the derived metrics. A formula with a missing operand or a zero
    denominator has no value and no row. terms is a fixed, small table; one aggregation serves all formulas. with_operands: the values themselves
    are rows as well, with what they have of carried, out of the same aggregation."""
    carried = [c for c in carried if with_operands and c in values.columns]
    if with_operands:
        own = values.select(*keys, "metric", F.array(F.struct(F.col("metric").alias("derived"), F.lit(1.0).alias("num"), F.lit(0.0).alias("den"), F.lit(1.0).alias("scale"), F.lit(1).alias("n_operands"), F.lit(False).alias("has_den"))).alias("_own"), "value", *carried)
        uses = terms.groupBy("metric").agg(F.collect_list(F.struct("derived", "num", "den", "scale", "n_operands", "has_den")).alias("_uses"))
        met = own.join(F.broadcast(uses), "metric", "left")
        parts = met.select(*keys, "metric", "value", *carried, F.inline(F.concat("_own", F.coalesce("_uses", F.array().cast(met.schema["_uses"].dataType)))))
    else:
        parts = values.join(F.broadcast(terms), "metric")
    itself = F.col("derived") == F.col("metric")
    found = parts.groupBy(*keys, "derived").agg(
        F.sum(F.col("num") * F.col("value")).alias("n"), F.sum(F.col("den") * F.col("value")).alias("d"), F.first("scale").alias("scale"), F.first("has_den").alias("has_den"),
        F.count("value").alias("present"), F.first("n_operands").alias("n_operands"), *(F.max(F.when(itself, F.col(c))).alias(c) for c in carried),
    )
    below = F.when(F.col("has_den"), F.nullif(F.col("d"), F.lit(0.0))).otherwise(F.lit(1.0))
    whole = found.filter(F.col("present") == F.col("n_operands"))
    return whole.select(*keys, F.col("derived").alias("metric"), (F.col("scale") * F.col("n") / below).alias("value"), *carried).filter(F.col("value").isNotNull())


def derived_points(days: DataFrame, terms: DataFrame, bucket: str) -> DataFrame:
    """Each operand by its own rule and source in each bucket, then the formula."""
    return evaluate(points(days, bucket).select(*KEYS, "bucket", "value"), terms, ["account_id", "bucket"])


def derived_summary(days: DataFrame, terms: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Operands folded over the window, the formula once: never a mean of ratios."""
    return evaluate(summary(days, keys).select(*keys, "value"), terms, [k for k in keys if k != "metric"])


def route(measurements: DataFrame, states: DataFrame, rules: DataFrame, terms: DataFrame, window: Window, bucket: str, priority: dict | None = None) -> DataFrame:
    """(account_id, metric, bucket, value, min, max, count) of all metrics: imported ones by their rules, derived ones by their formulas, sleep by nights
    from its states; count is null for derived points and the number of nights for sleep."""
    window.guard(bucket)
    # One aggregation of the points gives them back and the formulas over them: one scan of the measurements, one of the states.
    measured = evaluate(points(resolved_days(measurements, rules, [window], priority), bucket), terms, ["account_id", "bucket"], with_operands=True)
    slept = fold_nights(nights(stage_minutes(states, window, priority)), bucket)
    none = {n: F.lit(None).cast("double") for n in ("min", "max")}
    return measured.select(*KEYS, "bucket", "value", "min", "max", "count").unionByName(slept.withColumns({"metric": F.lit("sleep")} | none))


def summaries(measurements: DataFrame, states: DataFrame, rules: DataFrame, terms: DataFrame, window: Window, priority: dict | None = None) -> DataFrame:
    """(account_id, metric, value, mean, nights): the window as one bucket, for imported and derived metrics out of one aggregation, and for sleep."""
    own = evaluate(summary(resolved_days(measurements, rules, [window], priority)).select(*KEYS, "value", "mean"), terms, ["account_id"], with_operands=True)
    slept = sleep_summary(nights(stage_minutes(states, window, priority)))
    slept = slept.select("account_id", F.lit("sleep").alias("metric"), "value", F.lit(None).cast("double").alias("mean"), F.col("nights").cast("double"))
    return own.withColumn("nights", F.lit(None).cast("double")).unionByName(slept)


def figures(summed: DataFrame, modes: DataFrame, days: int, average: bool = True) -> DataFrame:
    """(account_id, metric, mode, figure): what a summary shows. summed: (account_id, metric, value, mean, nights). With average on, what grows with
    the window is shown per day or, for sleep, per night that has data, and a latest metric by its mean; all else as its total. modes is a
    fixed, small table."""
    mode = F.col("mode") if average else F.lit("total")
    shown = summed.join(F.broadcast(modes), "metric").select(*KEYS, mode.alias("mode"), "value", "mean", "nights")
    figure = F.when(F.col("mode") == "per_day", F.col("value") / days).when(F.col("mode") == "per_night", F.col("value") / F.nullif("nights", F.lit(0))).when(F.col("mode") == "mean", F.col("mean")).otherwise(F.col("value"))
    return shown.select(*KEYS, "mode", figure.alias("figure"))


def panel(found: DataFrame, metrics: list[str]) -> DataFrame:
    """Points of several metrics side by side: one row per account and bucket, one column per metric, null where it has no point."""
    return found.groupBy("account_id", "bucket").pivot("metric", metrics).agg(F.first("value"))


def extremes(found: DataFrame) -> DataFrame:
    """(account_id, metric, high, high_bucket, low, low_bucket, covered): the first bucket wins a tie."""
    days = F.datediff(F.col("bucket"), F.lit("1970-01-01").cast("date"))
    high, low = F.max_by(F.struct("value", "bucket"), F.struct("value", (-days).alias("d"))), F.min_by(F.struct("value", "bucket"), F.struct("value", days.alias("d")))
    out = found.groupBy(*KEYS).agg(high.alias("h"), low.alias("l"), F.count("*").alias("covered"))
    return out.select(*KEYS, F.col("h.value").alias("high"), F.col("h.bucket").alias("high_bucket"), F.col("l.value").alias("low"), F.col("l.bucket").alias("low_bucket"), "covered")


def distinct_metrics(measurements: DataFrame) -> DataFrame:
    return measurements.select(*KEYS).distinct()


def latest_value(measurements: DataFrame, window: Window) -> DataFrame:
    rows = measurements.filter(in_window(F.col("start_at"), window))
    return rows.groupBy(*KEYS).agg(F.max_by("value", F.struct("start_at", "id")).alias("value"), F.max("start_at").cast("date").alias("bucket"))
