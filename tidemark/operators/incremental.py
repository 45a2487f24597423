"""The daily aggregate as a table that follows the store: what an import adds is summed and merged into the days that it touches; other days aren't read.

The table is a family of the store of its own, parted by day, and its manifest says which version of the measurements it holds. Following is a difference of manifests: the
files that were added since are summed by day and merged, as all that daily keeps can be (counts, sums, extremes, the latest value with its place). Where
files went, as after a deletion, the days that were in them are summed anew. Days and version are committed together, so a job that is lost in between repeats
nothing and leaves nothing out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.resolve import daily
from tidemark.sources.sinks import family_store
from tidemark.sources.store import Manifest, Store

KEYS = ["account_id", "metric", "rule", "source", "day", "segment"]
FAMILY = "daily"


def daily_store(spark: SparkSession, store: str) -> Store:
    return Store(spark, store, FAMILY, "day")


def merged(parts: DataFrame) -> DataFrame:
    """Daily rows of several parts of the measurements as those of all of them."""
    return parts.groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.max_by("latest", "latest_at").alias("latest"), F.max("latest_at").alias("latest_at"),
    )


def _days_of(files: list[str]) -> list[str]:
    """The days of files of the daily table, by their folders."""
    return [f.split("/")[1].partition("=")[2] for f in files]


def follow(spark: SparkSession, store: str, rules: DataFrame) -> Manifest:
    """Bring the daily table up to the newest version of the measurements."""
    rows, table = family_store(spark, store, "measurements"), daily_store(spark, store)

    def change(base: Manifest) -> tuple[DataFrame | None, list[str], dict]:
        now = rows.manifest()
        then = rows.manifest(base.notes["measurements"]) if base.notes.get("measurements") else Manifest()
        if now.version == then.version:
            return None, [], {}
        notes = {"measurements": now.version}
        added, gone = sorted({*now.files} - {*then.files}), sorted({*then.files} - {*now.files})
        day = F.col("start_at").cast("date")
        if gone:
            # Rows may have gone or only moved: all days of these files are summed anew from what is there now.
            spoilt = rows.read(then, gone).select(day.alias("day"))
            spoilt = (spoilt.unionByName(rows.read(now, added).select(day.alias("day"))) if added else spoilt).filter("day IS NOT NULL").distinct()
            days = [str(r["day"]) for r in spoilt.collect()]
            fresh = daily(rows.read(now).filter(day.isin([F.lit(d).cast("date") for d in days]) if days else F.lit(False)), rules)
            wanted = {*days}
            return fresh, [f for f in base.files if _days_of([f])[0] in wanted], notes
        if not added:
            return None, [], notes
        fresh = daily(rows.read(now, added).filter(F.col("start_at").isNotNull()), rules)
        wanted = {str(r["day"]) for r in fresh.select("day").distinct().collect()}
        met = [f for f in base.files if _days_of([f])[0] in wanted]
        return (merged(fresh.unionByName(table.read(base, met))) if met else fresh), met, notes

    return table.change(change)
