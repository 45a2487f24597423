"""A whole import: an export's records, states, workouts, statistics and routes into the store, idempotently, with a report.

The export is scanned once and its records are tagged once; both are written before families read them. Every family is appended as a version of its own, so an import that is lost
midway is begun again and adds what is missing. What the report counts is told before anything is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.sources import artifacts, health_xml, sinks
from tidemark.sources.shared import written

#: What a family's rows are counted by in the report.
COUNTED = {"measurements": "metric", "states": "kind", "unmapped": "source_type", "sessions": "activity_type", "routes": "source"}
STATISTIC = ["account_id", "session_id", "metric", "stat"]


def _counted(spark: SparkSession, rows: DataFrame, store: str, family: str) -> DataFrame:
    """What an import of rows would add and skip."""
    stored = sinks.read_family(spark, store, family)
    return ingest.report(rows, rows.limit(0) if stored is None else stored, family, COUNTED[family])


def put_statistics(spark: SparkSession, rows: DataFrame, store: str) -> None:
    """Statistics of sessions (STATISTIC, value): those that the store lacks or has with another value become its newest ones."""
    held = sinks.family_store(spark, store, "session_stats")

    def fresh(stored: DataFrame | None) -> DataFrame:
        given = rows.select(*STATISTIC, "value")
        if stored is None:
            return given.withColumn("seq", F.lit(0).cast("bigint"))
        known = newest_statistics(stored).select(*STATISTIC, F.col("value").alias("_known"), "seq")
        met = given.join(known, STATISTIC, "left").filter(F.col("_known").isNull() | (F.col("_known") != F.col("value")))
        return met.select(*STATISTIC, "value", (F.coalesce("seq", F.lit(-1)) + 1).cast("bigint").alias("seq"))

    held.append(fresh)


def newest_statistics(stored: DataFrame) -> DataFrame:
    """The last value of each statistic of the store."""
    return stored.groupBy(*STATISTIC).agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def import_export(spark: SparkSession, path: str, store: str, account_id: int, routes_folder: str | None = None, routes_path: str | None = None, at=None) -> DataFrame:
    """Import the exports under path into the store for an account and say what was added and skipped: (account_id, family, name, added, skipped). routes_path: a folder or an archive with
    the exports' route files, which are placed in routes_folder; without them routes are left out. at: when it is done, for the import log. A second import adds nothing."""
    elements = health_xml.read_elements(spark, path)
    tagged = written(ingest.tag_records(spark, health_xml.records(elements), account_id), "tagged")
    found = {family: ingest.of_family(tagged, family) for family in ingest.KEPT}
    parts = health_xml.workouts(elements)
    own = F.lit(account_id).cast("bigint")
    sessions = parts["sessions"].withColumns({"account_id": own, "seq": F.monotonically_increasing_id()})
    found["sessions"] = written(sessions, "sessions").withColumn("id", F.xxhash64("account_id", "content_key"))
    of_session = F.xxhash64(own, F.col("content_key"))
    if routes_path and routes_folder:
        stored = artifacts.store_artifacts(spark, routes_path, routes_folder)
        placed = artifacts.routes_of_export(parts["routes"], stored)
        missing = placed.filter(F.col("artifact").isNull()).select("route_path").first()
        if missing:
            raise FileNotFoundError(f"route {missing['route_path']} is not in {routes_path}")
        routes = placed.select(own.alias("account_id"), of_session.alias("session_id"), "artifact", "start_at", "end_at", "source", F.col("artifact_key").alias("content_key"), F.xxhash64("seq").alias("seq"), F.substring("artifact", 1, 2).alias("shelf"))
        found["routes"] = written(routes, "routes")
    told = None
    for family, rows in found.items():
        counts = _counted(spark, rows, store, family)
        told = counts if told is None else told.unionByName(counts)
    told = written(told, "report")
    for family, rows in found.items():
        sinks.append(spark, rows, store, family)
    put_statistics(spark, parts["session_stats"].select(own.alias("account_id"), of_session.alias("session_id"), "metric", "stat", "value"), store)
    if at is not None:
        n = {r["family"]: (r["a"] or 0, r["s"] or 0) for r in told.groupBy("family").agg(F.sum("added").alias("a"), F.sum("skipped").alias("s")).collect()}
        added, skipped = (sum(v[k] for f, v in n.items() if f != "unmapped") for k in (0, 1))
        sinks.record_import(spark, f"{store}/imports", account_id, path, added, skipped, n.get("unmapped", (0, 0))[0], at)
    return told
