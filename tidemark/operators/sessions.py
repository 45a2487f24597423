"""Sessions: filters, pages, totals, statistics and routes of workout-like entities."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.catalog import GROUPS, activities
from tidemark.functions.columns import stamp
from tidemark.plans.timeaxis import Window, shift

PAGE = 50


def in_days(window: Window) -> Column:
    """Session reads include the day on which the window ends."""
    return (F.col("start_at") >= stamp(window.start)) & (F.col("start_at") < stamp(shift(window.end.date(), days=1)))


def of_groups(groups: list[str] | None = None, types: list[str] | None = None, excluded: list[str] | None = None) -> Column:
    """Activities of any of the groups or types, but none of the excluded types. "other" is whatever no named group holds, so unknown activities belong to it."""
    named = lambda g: [a for a in GROUPS.get(g, "").split()]
    wanted = F.lit(not groups and not types)
    for g in groups or []:
        wanted = wanted | (~F.col("activity_type").isin([a for k in GROUPS for a in named(k)]) if g == "other" else F.col("activity_type").isin(named(g)))
    wanted = wanted | F.col("activity_type").isin(types) if types else wanted
    return wanted & ~F.col("activity_type").isin(excluded) if excluded else wanted


def displayed(spark: SparkSession, sessions: DataFrame) -> DataFrame:
    """Sessions with label, group and reading; an unnamed activity shows its own slug."""
    dims = F.broadcast(activities(spark))
    out = sessions.join(dims, "activity_type", "left")
    own = F.initcap(F.replace("activity_type", F.lit("_"), F.lit(" ")))
    return out.withColumns({"label": F.coalesce("label", own), "activity_group": F.coalesce("activity_group", F.lit("other")), "reading": F.coalesce("reading", F.lit("none"))})


def with_route_flag(sessions: DataFrame, routes: DataFrame) -> DataFrame:
    """Sessions with has_route."""
    ids = routes.select(F.col("session_id").alias("id")).distinct().withColumn("has_route", F.lit(True))
    return sessions.join(ids, "id", "left").withColumn("has_route", F.coalesce("has_route", F.lit(False)))


def encode_cursor(start_at, session_id: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([str(start_at), session_id]).encode()).decode()


def decode_cursor(cursor: str) -> tuple[str, int]:
    start_at, session_id = json.loads(base64.urlsafe_b64decode(cursor))
    return start_at, session_id


def page(sessions: DataFrame, cursor: str | None = None, size: int = PAGE) -> DataFrame:
    """The newest sessions, or those that come after the cursor, newest first; ids break ties. A top-k, not a full sort."""
    if cursor:
        start_at, session_id = decode_cursor(cursor)
        at = F.lit(start_at).cast("timestamp_ntz")
        sessions = sessions.filter((F.col("start_at") < at) | ((F.col("start_at") == at) & (F.col("id") < session_id)))
    return sessions.orderBy(F.desc("start_at"), F.desc("id")).limit(size)


def cursor_of(start_at: Column, session_id: Column) -> Column:
    """encode_cursor as an expression."""
    text = F.concat(F.lit('["'), F.date_format(start_at, "yyyy-MM-dd HH:mm:ss"), F.lit('", '), session_id.cast("string"), F.lit("]"))
    return F.translate(F.base64(text.cast("binary")), "+/", "-_")


def page_with_next(sessions: DataFrame, cursor: str | None = None, size: int = PAGE) -> DataFrame:
    """page with next_cursor: on the last row of a full page what the page after it begins with, null on all others. The window runs over one page."""
    rows = page(sessions, cursor, size)
    order = W.orderBy(F.desc("start_at"), F.desc("id"))
    return rows.withColumn("_row", F.row_number().over(order)).withColumn("next_cursor", F.when(F.col("_row") == size, cursor_of(F.col("start_at"), F.col("id")))).drop("_row")


def detail(sessions: DataFrame, stats: DataFrame, routes: DataFrame, account_id: int | None = None, session_id: int | None = None) -> DataFrame:
    """Sessions with stats (metric, stat, value; by name) and routes (start_at, id and what else they have; in order of time), empty where a session has none. With an account and an id it
    is one session's detail, and no row if the account has no such session; the filter reaches the sessions' scan, and the others are read for its id only."""
    if session_id is not None:
        sessions = sessions.filter((F.col("id") == session_id) & (F.col("account_id") == account_id))
        stats, routes = stats.filter(F.col("session_id") == session_id), routes.filter(F.col("session_id") == session_id)
    listed = stats.groupBy(F.col("session_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("metric", "stat", "value"))).alias("stats"))
    own = routes_of(sessions, routes)
    first = [c for c in ("start_at", "id") if c in routes.columns]
    rest = [c for c in routes.columns if c not in (*first, "session_id", "account_id")]
    drawn = own.groupBy(F.col("session_id").alias("_session")).agg(F.sort_array(F.collect_list(F.struct(*first, *rest))).alias("routes")).withColumnRenamed("_session", "id")
    out = sessions.join(listed, "id", "left").join(drawn, "id", "left")
    none = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("stats", "routes")}
    return out.withColumns(none)


def totals(sessions: DataFrame) -> DataFrame:
    """(account_id, sessions, duration, distance, energy): over the filter, not a page; distance and energy are null if no session has one."""
    return sessions.groupBy("account_id").agg(F.count("*").alias("sessions"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("duration"), F.sum("total_distance").alias("distance"), F.sum("total_energy").alias("energy"))


def statistics(sessions: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics of the given sessions: (account_id, session_id, metric, stat, value)."""
    owned = sessions.select("account_id", F.col("id").alias("session_id"))
    return stats.join(owned, "session_id").select("account_id", "session_id", "metric", "stat", "value")


def upsert_statistics(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The last write of each (session, metric, stat): new rows carry seq and win over stored ones."""
    keys = ["session_id", "metric", "stat"]
    both = stored.select(*keys, "value", F.lit(-1).cast("bigint").alias("seq")).unionByName(new.select(*keys, "value", F.col("seq").cast("bigint").alias("seq")))
    return both.groupBy(*keys).agg(F.max_by("value", "seq").alias("value"))


def routes_of(sessions: DataFrame, routes: DataFrame) -> DataFrame:
    return routes.join(sessions.select("account_id", F.col("id").alias("session_id")), ["account_id", "session_id"], "left_semi")
