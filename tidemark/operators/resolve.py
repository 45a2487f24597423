"""Which rows count: one source for each metric, and manual rows in place of a source's rows on the days that have any.

The row set is fixed here, before anything is bucketed, so day points, month points and summaries never disagree about rows. Reads of figures go by
``resolved_days``: one hash aggregation of the raw rows, whatever the number of windows, and everything after it on a few rows a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.catalog import LATEST, PRIORITY
from tidemark.functions.columns import in_window, source_rank, stamp
from tidemark.plans.timeaxis import Window, shift

MANUAL = "Manual"


#: Up to this many rows of windows of accounts' own go to every task; beyond it they are joined by key, salted.
BROADCAST_ROWS = 100_000
SALTS = 16


def _ranked(priority: dict | None) -> Column:
    return F.struct(source_rank(F.col("source"), F.col("metric"), PRIORITY if priority is None else priority).alias("rank"), F.col("source"))


def elect(days: DataFrame, windows: list[Window], priority: dict | None = None) -> DataFrame:
    """(account_id, metric, w, winner, has_manual): for each window (w, its place in the list) the best-ranked source but Manual, ties by name, and whether
    Manual rows are there. days: what daily says of these windows."""
    bounds = sorted({b for w in windows for b in (w.start, w.end)})
    manual = F.col("source") == MANUAL
    inside = F.explode(F.array_compact(F.array(*(F.when(F.col("segment").between(bounds.index(w.start) + 1, bounds.index(w.end)), k) for k, w in enumerate(windows)))))
    rows = days.select("account_id", "metric", "source", inside.alias("w"))
    best = rows.groupBy("account_id", "metric", "w").agg(F.min(F.when(~manual, _ranked(priority))).alias("_best"), F.max(manual).alias("has_manual"))
    return best.select("account_id", "metric", "w", F.col("_best.source").alias("winner"), "has_manual")


def resolve(measurements: DataFrame, rules: DataFrame, window: Window, priority: dict | None = None) -> DataFrame:
    """The daily rows of a window that count, for all accounts and metrics: daily's columns, and the reported source as reported_source.

    Manual days aren't cut by the window's bounds, but they matter only where a manual row lies inside the window.
    """
    return resolved_days(measurements, rules, [window], priority).withColumn("reported_source", F.coalesce(F.col("winner"), F.lit(MANUAL))).drop("winner", "w")


def with_own_windows(rows: DataFrame, own: DataFrame, keep_all: bool) -> DataFrame:
    """rows with own_start and own_end, the bounds of their account's own window. own: (account_id, own_start, own_end), a row an account. A few windows go to every
    task; more are joined by account and a salt, so that a hot account's rows are many tasks'. keep_all: rows outside of a window's days stay, too."""
    small = own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if small:
        met = rows.join(F.broadcast(own), "account_id", "left" if keep_all else "inner")
    else:
        salted = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("_salt", F.pmod(F.xxhash64("start_at", "id"), F.lit(SALTS)).cast("int")).join(salted, ["account_id", "_salt"], "left" if keep_all else "inner").drop("_salt")
    if keep_all:
        return met
    # Whole days around the window, as manual rows count for their day.
    return met.filter((F.col("start_at") >= F.col("own_start").cast("date").cast("timestamp_ntz")) & (F.col("start_at") < F.date_add(F.col("own_end").cast("date"), 1).cast("timestamp_ntz")))


def daily(measurements: DataFrame, rules: DataFrame, windows: list[Window] = (), own: DataFrame | None = None) -> DataFrame:
    """(account_id, metric, rule, source, day, segment, n, k, total, low, high, latest, latest_at): raw rows summed by day, source and the segment of
    time between the windows' bounds; k counts values. All buffers have a fixed width, so this is a hash aggregation without a sort. latest_at
    orders rows by time and then id. Whole days around the windows are read, as manual rows count for their day. rules is a fixed, small table.
    own: a window for each account, (account_id, own_start, own_end); then rows also have own, whether they lie in it."""
    bounds = sorted({b for w in windows for b in (w.start, w.end)})
    rows = measurements.filter((F.col("start_at") >= stamp(bounds[0].date())) & (F.col("start_at") < stamp(shift(bounds[-1].date(), days=1)))) if bounds else measurements
    segment = sum(((F.col("start_at") >= stamp(b)).cast("int") for b in bounds), F.lit(0))
    place = F.unix_micros(F.col("start_at").cast("timestamp")).cast("decimal(18,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col("id").cast("decimal(19,0)")
    latest_at = F.when(F.col("rule") == LATEST, place.cast("decimal(38,0)"))
    ruled = rows.join(F.broadcast(rules.select("metric", "rule")), "metric")
    keys = ["account_id", "metric", "rule", "source", F.col("start_at").cast("date").alias("day"), segment.alias("segment")]
    if own is not None:
        ruled = with_own_windows(ruled, own, bool(bounds))
        keys.append(F.coalesce((F.col("start_at") >= F.col("own_start")) & (F.col("start_at") < F.col("own_end")), F.lit(False)).alias("own"))
    return ruled.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("value").alias("k"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", latest_at).alias("latest"), F.max(latest_at).alias("latest_at"),
    )


def resolved_days(measurements: DataFrame, rules: DataFrame, windows: list[Window], priority: dict | None = None, own: DataFrame | None = None) -> DataFrame:
    """daily's rows that count, once for each window (w, its place in the list) that they count in, with the window's elected source as winner. A source is
    elected for each window. own: a window for each account, (account_id, own_start, own_end); its w comes after the list's. Accounts with differing
    windows of their own are one plan and one scan."""
    return counting(daily(measurements, rules, windows, own), windows, priority, own is not None)


def counting(days: DataFrame, windows: list[Window], priority: dict | None = None, own: bool = False) -> DataFrame:
    """The daily rows that count in each window; see resolved_days."""
    bounds = sorted({b for w in windows for b in (w.start, w.end)})
    # Both windows lie inside one account and metric: one exchange of a few rows a day.
    whole, one_day = W.partitionBy("account_id", "metric"), W.partitionBy("account_id", "metric", "day")
    manual = F.col("source") == MANUAL
    insides = [F.col("segment").between(bounds.index(w.start) + 1, bounds.index(w.end)) for w in windows] + ([F.col("own")] if own else [])
    marked, counts = days.withColumn("_manual_day", F.max(manual).over(one_day)), []
    for k, inside in enumerate(insides):
        best, has_manual = F.min(F.when(inside & ~manual, _ranked(priority))).over(whole), F.max(inside & manual).over(whole)
        marked = marked.withColumns({f"_best{k}": best, f"_has{k}": has_manual})
        device = (F.col("source") == F.col(f"_best{k}.source")) & ~(F.col(f"_has{k}") & F.col("_manual_day"))
        counts.append(F.when(inside & (manual | device), F.struct(F.lit(k).alias("w"), F.col(f"_best{k}.source").alias("winner"))))
    return marked.select(*(c for c in days.columns if c != "own"), F.inline(F.array_compact(F.array(*counts))))


def sources_in(measurements: DataFrame, window: Window) -> DataFrame:
    """(account_id, metric, source, rows) of a window."""
    return measurements.filter(in_window(F.col("start_at"), window)).groupBy("account_id", "metric", "source").agg(F.count("*").alias("rows"))


def has_rows(accounts: DataFrame, *families: DataFrame) -> DataFrame:
    """(account_id, has_any): whether each account has a row of any of the families."""
    rows = families[0].select("account_id")
    for more in families[1:]:
        rows = rows.unionByName(more.select("account_id"))
    held = rows.distinct().withColumn("has_any", F.lit(True))
    return accounts.select("account_id").distinct().join(held, "account_id", "left").select("account_id", F.coalesce("has_any", F.lit(False)).alias("has_any"))
