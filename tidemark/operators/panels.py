"""Panels and pins: which metrics are read together, in which order and drawn how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import AVERAGE, METRICS, STATES, SUM, Metric

MOST_METRICS, MOST_UNITS = 4, 2
#: Charts that any metric may have, and those that only some may.
CHARTS = ("bar", "line", "area", "band", "stacked_bar", "diverging_bar")
PANEL = ["account_id", "panel_id"]


def default_chart(m: Metric) -> str:
    """The chart of a metric that isn't given one."""
    return "diverging_bar" if m.signed else {SUM: "bar", AVERAGE: "band", STATES: "stacked_bar"}.get(m.rule, "line")


def charts(spark: SparkSession, metrics: dict[str, Metric] = METRICS) -> DataFrame:
    """(metric, unit, default_chart, fits): fits are the charts that the metric may have. A fixed, small table."""
    only = {"band": lambda m: m.rule == AVERAGE, "stacked_bar": lambda m: m.rule == STATES, "diverging_bar": lambda m: m.signed}
    rows = [(m.slug, m.unit, default_chart(m), [c for c in CHARTS if c not in only or only[c](m)]) for m in metrics.values()]
    return spark.createDataFrame(rows, "metric string, unit string, default_chart string, fits array<string>")


def _read(members: DataFrame, known: DataFrame) -> DataFrame:
    """members (account_id, panel_id, position, metric, chart) with what the catalog says, and the chart that is drawn."""
    return members.join(F.broadcast(known), "metric", "left").withColumn("chart", F.coalesce("chart", "default_chart"))


def problems(members: DataFrame, known: DataFrame) -> DataFrame:
    """(account_id, panel_id, problems): why a panel can't be stored; no problems for one that can. One aggregation over its members."""
    unknown = F.col("default_chart").isNull()
    wrong = ~unknown & ~F.coalesce(F.array_contains("fits", F.col("chart")), F.lit(False))
    found: dict[str, Column] = {
        "too many metrics": F.count("*") > MOST_METRICS, "too many units": F.size(F.collect_set("unit")) > MOST_UNITS, "unknown metric": F.max(unknown), "chart doesn't fit": F.max(wrong),
    }
    rows = _read(members, known).groupBy(*PANEL).agg(*(v.alias(n) for n, v in found.items()))
    return rows.select(*PANEL, F.array_compact(F.array(*(F.when(F.col(f"`{n}`"), F.lit(n)) for n in found))).alias("problems"))


def assemble(members: DataFrame, known: DataFrame) -> DataFrame:
    """(account_id, panel_id, metrics): each panel's metrics with unit and chart, in order of their position."""
    row = F.struct("position", "metric", "unit", "chart")
    rows = _read(members, known).groupBy(*PANEL).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    return rows.select(*PANEL, F.transform("_rows", lambda x: F.struct(x["metric"].alias("metric"), x["unit"].alias("unit"), x["chart"].alias("chart"))).alias("metrics"))


def drawn(members: DataFrame, known: DataFrame, points: DataFrame) -> DataFrame:
    """(account_id, panel_id, metric, chart, bucket, value): the points of all panels in one join; a metric without a point has a row without bucket."""
    return _read(members, known).select(*PANEL, "metric", "chart").join(points.select("account_id", "metric", "bucket", "value"), ["account_id", "metric"], "left")


def add_pins(pins: DataFrame, new: DataFrame) -> DataFrame:
    """pins (account_id, metric, position) and the new ones (account_id, metric, seq) behind each account's last; what is pinned already keeps its place, and pins twice
    given are one."""
    last = pins.groupBy("account_id").agg(F.max("position").alias("_last"))
    fresh = new.groupBy("account_id", "metric").agg(F.min("seq").alias("seq")).join(pins.select("account_id", "metric"), ["account_id", "metric"], "left_anti")
    ordered = fresh.groupBy("account_id").agg(F.sort_array(F.collect_list(F.struct("seq", "metric"))).alias("_new")).join(last, "account_id", "left")
    placed = ordered.select("account_id", "_last", F.posexplode("_new").alias("_k", "_pin"))
    return pins.select("account_id", "metric", "position").unionByName(placed.select("account_id", F.col("_pin.metric").alias("metric"), (F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_k")).cast(pins.schema["position"].dataType).alias("position")))
