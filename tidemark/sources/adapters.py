"""The driver's tables as families: plain projections, so scans read only the columns that a query needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import AVERAGE, LATEST, SUM, Formula, Metric

ACCOUNTS = 3
#: The rules that the event types stand for here.
METRICS = {
    m.slug: m
    for m in (
        Metric("view", "count", SUM), Metric("click", "count", SUM), Metric("purchase", "count", SUM), Metric("error", "count", AVERAGE), Metric("signup", "count", LATEST),
        Metric("engagement", "count", formula=Formula(((1.0, "view"), (1.0, "click")))),
        Metric("net", "count", formula=Formula(((1.0, "purchase"), (-1.0, "view"), (-1.0, "click"))), signed=True),
        Metric("purchase_share", "%", formula=Formula(((4.0, "purchase"),), ((1.0, "view"),), 100.0)),
        Metric("purchase_per_error", "1", formula=Formula(((1.0, "purchase"),), ((1.0, "error"),))),
    )
}
PRIORITY = {m: ("watch", "iphone") for m in ("view", "click", "sleep")}
STAGES = {"view": "asleep_core", "click": "asleep_rem", "purchase": "asleep_deep", "signup": "in_bed", "error": "awake"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, account: Column | None = None) -> DataFrame:
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int")
    source = F.when(k == 0, "Manual").when(k % 3 == 0, "My Apple Watch").when(k % 3 == 1, "An iPhone").otherwise("A Scale")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % ACCOUNTS if account is None else account).alias("account_id"), "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("start_at"), source.alias("source"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, account_id, metric, value, start_at, source) from events."""
    return _events(spark, sf_dir).withColumnRenamed("event_type", "metric")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, account_id, kind, state_value, start_at, end_at, source): an event lasts as many minutes as its value says."""
    stage = F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv))
    end = F.timestamp_micros(F.unix_micros(F.col("start_at").cast("timestamp")) + F.floor(F.col("value") * 60).cast("bigint") * 1_000_000).cast("timestamp_ntz")
    return _events(spark, sf_dir).select("id", "account_id", F.lit("sleep").alias("kind"), F.element_at(stage, F.col("event_type")).alias("state_value"), "start_at", end.alias("end_at"), "source")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, account_id, activity_type, start_at, duration, total_distance, total_energy) from orders; urgent ones have no distance."""
    activity = {"1-URGENT": "running", "2-HIGH": "cycling", "3-MEDIUM": "yoga", "4-NOT SPECIFIED": "parkour", "5-LOW": "swimming"}
    names = F.create_map(*(F.lit(x) for kv in activity.items() for x in kv))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % ACCOUNTS).alias("account_id"), F.coalesce(F.element_at(names, F.col("o_orderpriority")), F.lit("other")).alias("activity_type"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("start_at"), (F.col("o_totalprice") / 10).alias("duration"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice") / 1000).alias("total_distance"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 100).alias("total_energy"),
    )


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, metric, stat, value, seq) from lineitem."""
    stat = F.create_map(*(F.lit(x) for kv in {"A": "average", "N": "sum", "R": "max"}.items() for x in kv))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.lit("heart_rate").alias("metric"), F.element_at(stat, F.col("l_returnflag")).alias("stat"), F.col("l_quantity").alias("value"), F.col("l_linenumber").cast("bigint").alias("seq"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, account_id) of sessions that have a route: those with a returned line."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("session_id"))
    return lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_custkey") % ACCOUNTS).alias("account_id")), "session_id")


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(route_id, seq, lat, lon, ele, at): a user's events in order of id as a track."""
    e = table(spark, sf_dir, "events").filter("value IS NOT NULL")
    return e.select(F.col("user_id").alias("route_id"), F.col("event_id").alias("seq"), (48 + F.pmod("event_id", F.lit(997)) / 1000).alias("lat"), (2 + F.pmod("event_id", F.lit(613)) / 1000).alias("lon"), F.pmod("event_id", F.lit(37)).cast("double").alias("ele"), F.col("ts").cast("timestamp_ntz").alias("at"))


def user_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """measurements with each user as an account."""
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("account_id"), F.col("event_type").alias("metric"), "value", F.col("ts").cast("timestamp_ntz").alias("start_at"))
    return own.withColumn("source", F.lit("Shop"))


def body_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """measurements of each user as an account, with the event types as readings of a body and of what it eats and spends: even ids are read as the first of two metrics, odd
    ones as the second."""
    names = {"view": ("dietary_energy", "dietary_protein"), "click": ("height", "active_energy"), "purchase": ("body_fat_percentage", "basal_energy"), "signup": ("lean_body_mass", "body_mass"), "error": ("body_mass", "body_mass")}
    of = lambda k: F.element_at(F.create_map(*(F.lit(x) for n, v in names.items() for x in (n, v[k]))), F.col("event_type"))
    metric = F.when(F.col("id") % 2 == 0, of(0)).otherwise(of(1))
    value = F.when(metric == "body_fat_percentage", F.col("value") / 1000).otherwise(F.col("value"))
    return _events(spark, sf_dir, F.col("user_id")).select("id", "account_id", metric.alias("metric"), value.alias("value"), "start_at", "source")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account_id, born, sex, trust) from customers: some don't say what their composition is worth."""
    k = F.col("c_custkey")
    born = F.date_add(F.lit("1950-01-01").cast("date"), F.pmod(k * 37, F.lit(18_000)).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("account_id"), born.alias("born"), F.when(k % 3 == 0, "male").when(k % 3 == 1, "female").alias("sex"), F.when(k % 5 == 0, "measured").when(k % 5 == 1, "estimated").alias("trust"))


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account_id, id, rate_pct_per_week, started_at, ended_at) from orders: a customer has several, some of them open, some yet to begin."""
    k = F.col("o_orderkey")
    start = F.timestamp_micros(F.unix_micros(F.lit("2024-01-03").cast("timestamp")) + ((k % 28) * 24 + k % 24).cast("bigint") * 3_600_000_000).cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account_id"), k.alias("id"), ((k % 9 - 4) / 4).cast("double").alias("rate_pct_per_week"), start.alias("started_at"), F.when(k % 4 != 0, start + F.expr("interval 3 days")).alias("ended_at"))


def order_measurements(spark: SparkSession, sf_dir: str, account: Column | None = None) -> DataFrame:
    """A metric of several years: order totals as a sum, one source."""
    account = F.col("o_custkey") % ACCOUNTS if account is None else account
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), account.alias("account_id"), F.lit("purchase").alias("metric"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").cast("timestamp_ntz").alias("start_at"), F.lit("Shop").alias("source"))
