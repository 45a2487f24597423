"""The engine's operators as queries over the driver's tables. Times are fixed, never the clock's."""

from __future__ import annotations

from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import formatting
from tidemark.functions.columns import bucket_key, content_key, haversine
from tidemark.operators import compare as cmp
from tidemark.operators import covary, estimates, incremental, ingest, nights, panels, routes, series, sessions
from tidemark.operators.resolve import daily, elect, has_rows, resolve, resolved_days, sources_in
from tidemark.plans.timeaxis import Window
from tidemark.sources import adapters as ad
from tidemark.sources import health_xml, sinks
from tidemark.sources.shared import scratch, written

WINDOW = Window.of(date(2024, 1, 4), date(2024, 1, 25))
BEFORE = Window.of(date(2024, 1, 1), date(2024, 1, 15))
NOW = datetime(2024, 1, 29, 15, 30)
YEARS = Window.of(date(1997, 3, 1), date(1999, 6, 15))
LAST_YEAR = Window.of(date(1996, 3, 1), date(1998, 6, 15))
QUERIES: dict = {}


def _add(name: str, f) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """f's rows, with days as text."""
        out = f(spark, sf_dir)
        return out.select(*(F.col(c).cast("string").alias(c) if kind == "date" else F.col(c) for c, kind in out.dtypes))

    QUERIES[name] = run


def query(f):
    _add(f.__name__, f)
    return f


def r6(name: str | Column, alias: str | None = None) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.round(c.cast("double"), 6).alias(alias or name)


def _rules(spark):
    return catalog.rules(spark, ad.METRICS)


def _terms(spark):
    return catalog.formula_terms(spark, ad.METRICS)


def _days(spark, d, *windows):
    return resolved_days(ad.measurements(spark, d), _rules(spark), list(windows or (WINDOW,)), ad.PRIORITY)


def _points(spark, d, bucket, window=WINDOW):
    return series.points(_days(spark, d, window), bucket)


def _shown(points: DataFrame) -> DataFrame:
    return points.select("account_id", "metric", "bucket", r6("value"), r6("min"), r6("max"), "count")


def _series(rule: str, bucket: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ruled = _rules(spark).filter(F.col("rule") == rule)
        return _shown(series.series(ad.measurements(spark, sf_dir).filter(F.col("metric").isin([m for m, x in ad.METRICS.items() if x.rule == rule])), ruled, WINDOW, bucket, ad.PRIORITY))

    _add(f"series_{rule}_{bucket}", run)


for _rule in (catalog.SUM, catalog.AVERAGE, catalog.LATEST):
    for _bucket in ("day", "week", "month"):
        _series(_rule, _bucket)


@query
def series_summary(spark, d):
    return series.summary(_days(spark, d)).select("account_id", "metric", r6("value"), r6("min"), r6("max"), "count")


@query
def latest_mean(spark, d):
    return series.summary(_days(spark, d)).filter(F.col("mean").isNotNull()).select("account_id", "metric", r6("mean"))


def _summed(spark, d):
    """Summaries of imported and derived metrics and of sleep."""
    return series.summaries(ad.measurements(spark, d), ad.states(spark, d), _rules(spark), _terms(spark), WINDOW, ad.PRIORITY)


def _modes(spark):
    return catalog.modes(spark, ad.METRICS | {"sleep": catalog.METRICS["sleep"]})


@query
def summary_figures(spark, d):
    return series.figures(_summed(spark, d), _modes(spark), WINDOW.days).select("account_id", "metric", "mode", r6("figure"))


@query
def summary_totals(spark, d):
    return series.figures(_summed(spark, d), _modes(spark), WINDOW.days, average=False).select("account_id", "metric", "mode", r6("figure"))


@query
def series_routed(spark, d):
    """All metrics of a read by one function: imported, derived and sleep."""
    found = series.route(ad.measurements(spark, d), ad.states(spark, d), _rules(spark), _terms(spark), WINDOW, "week", ad.PRIORITY)
    return found.select("account_id", "metric", "bucket", r6("value"), "count")


@query
def compare_delta(spark, d):
    """Derived summaries of two windows: per cent, or the plain difference for signed metrics and zero baselines; and the change's direction."""
    found = series.derived_summary(_days(spark, d, WINDOW, BEFORE), _terms(spark), ["account_id", "metric", "w"])
    of = lambda k: F.max(F.when(F.col("w") == k, F.col("value")))
    both = found.groupBy("account_id", "metric").agg(of(0).alias("value"), of(1).alias("baseline")).filter(F.col("value").isNotNull())
    signed = F.col("metric").isin([m.slug for m in ad.METRICS.values() if m.signed])
    delta = cmp.change(F.col("value"), F.col("baseline"), signed)
    return both.select("account_id", "metric", r6("value"), r6("baseline"), r6(delta, "delta"), cmp.direction(F.col("value"), F.col("baseline"), signed).alias("direction"))


@query
def source_election(spark, d):
    return elect(daily(ad.measurements(spark, d), _rules(spark), [WINDOW]), [WINDOW], ad.PRIORITY).drop("w")


@query
def manual_overlay(spark, d):
    rows = resolve(ad.measurements(spark, d), _rules(spark), WINDOW, ad.PRIORITY)
    return rows.groupBy("account_id", "metric", "day").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("source") == "Manual", F.col("n")).otherwise(0)).alias("manual_rows"), r6(F.sum("total"), "value"))


@query
def derived_points_day(spark, d):
    return series.derived_points(_days(spark, d), _terms(spark), "day").select("account_id", "metric", "bucket", r6("value"))


@query
def derived_ratio_week(spark, d):
    return series.derived_points(_days(spark, d), _terms(spark), "week").filter("metric like 'purchase%'").select("account_id", "metric", "bucket", r6("value"))


@query
def derived_summary(spark, d):
    return series.derived_summary(_days(spark, d), _terms(spark)).select("account_id", "metric", r6("value"))


@query
def compare_previous(spark, d):
    found = cmp.points_of_both(ad.measurements(spark, d), _rules(spark), WINDOW, BEFORE, "day", ad.PRIORITY)
    out = cmp.compare(spark, found, WINDOW, BEFORE, "day")
    return out.select("account_id", "metric", "bucket", r6("value"), "baseline_bucket", r6("baseline_value"))


@query
def compare_last_year(spark, d):
    found = cmp.points_of_both(ad.order_measurements(spark, d), _rules(spark), YEARS, LAST_YEAR, "month")
    out = cmp.compare(spark, found, YEARS, LAST_YEAR, "month")
    return out.select("account_id", "metric", "bucket", r6("value"), "baseline_bucket", r6("baseline_value"))


def _sparse(spark, d):
    """Day points of single users: with gaps at any scale."""
    return series.points(daily(ad.user_measurements(spark, d), _rules(spark)), "day")


@query
def dense_gaps(spark, d):
    return cmp.dense(_sparse(spark, d), "day").select("account_id", "metric", "bucket", r6("value"))


@query
def gap_runs(spark, d):
    return cmp.gap_runs(cmp.dense(_sparse(spark, d), "day"))


def _history(spark, d):
    """Orders as each customer's measurements; events of the user with the same number as another family."""
    return ad.order_measurements(spark, d, F.col("o_custkey")), ad.user_measurements(spark, d)


@query
def history_band(spark, d):
    """Points and gaps over each account's real extent, whatever family its first row belongs to, in its own grain."""
    orders, other = _history(spark, d)
    return cmp.history_band(orders, _rules(spark), [other]).select("account_id", "bucket", "grain", r6("value"), "gap")


@query
def history_gaps(spark, d):
    """The dated runs of buckets without a point."""
    orders, other = _history(spark, d)
    return cmp.gap_runs(cmp.history_band(orders, _rules(spark), [other]))


@query
def history_phases(spark, d):
    """Phases as spans of buckets of their account's history."""
    notes = _notes(spark, d, "o_custkey").select("account_id", "id", ((F.col("id") % 5 - 2) / 2).cast("double").alias("rate_pct_per_week"), F.date_sub("starts_on", 15).alias("started_on"), F.when(F.col("id") % 3 != 0, F.col("starts_on")).alias("ended_on"))
    found = cmp.history_phases(notes, cmp.history_extent(*_history(spark, d)))
    return found.select("account_id", "id", "kind", r6("rate_pct_per_week"), "started_on", "ended_on", "from_bucket", "to_bucket")


@query
def lag_delta(spark, d):
    return cmp.deltas(_points(spark, d, "day")).select("account_id", "metric", "bucket", r6("value"), r6("delta"))


def _members(spark, d):
    """Orders as members of their customer's panel: a metric for each priority, some with a chart of their own."""
    names = {"1-URGENT": "view", "2-HIGH": "error", "3-MEDIUM": "purchase_share", "4-NOT SPECIFIED": "nothing", "5-LOW": "net"}
    metric = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("o_orderpriority"))
    rows = ad.table(spark, d, "orders").select((F.col("o_custkey") % ad.ACCOUNTS).alias("account_id"), F.col("o_custkey").alias("panel_id"), F.col("o_orderkey").alias("position"), metric.alias("metric"))
    first = rows.filter("metric IS NOT NULL").groupBy("account_id", "panel_id", "metric").agg(F.min("position").alias("position"))
    return first.withColumn("chart", F.when(F.col("position") % 5 == 0, "band").when(F.col("position") % 5 == 1, "area"))


@query
def panel_assembly(spark, d):
    """Each panel's metrics in order, with unit and chart."""
    found = panels.assemble(_members(spark, d), panels.charts(spark, ad.METRICS))
    return found.select("account_id", "panel_id", F.array_join(F.transform("metrics", lambda x: F.concat_ws(":", x["metric"], F.coalesce(x["unit"], F.lit("?")), F.coalesce(x["chart"], F.lit("?")))), ",").alias("metrics"))


@query
def panel_problems(spark, d):
    return panels.problems(_members(spark, d), panels.charts(spark, ad.METRICS)).select("account_id", "panel_id", F.array_join("problems", ",").alias("problems"))


@query
def panel_points(spark, d):
    """The weekly points of all panels."""
    return panels.drawn(_members(spark, d), panels.charts(spark, ad.METRICS), _points(spark, d, "week")).select("account_id", "panel_id", "metric", "chart", "bucket", r6("value"))


@query
def pins_added(spark, d):
    """Pins of each panel's first metrics, and all of its metrics pinned again."""
    rows = _members(spark, d).select(F.col("panel_id").alias("account_id"), "metric", "position")
    held = rows.filter("metric IN ('view', 'net')").select("account_id", "metric", F.when(F.col("metric") == "view", 0).otherwise(3).alias("position"))
    return panels.add_pins(held, rows.withColumnRenamed("position", "seq"))


@query
def pivot_panel(spark, d):
    out = series.panel(_points(spark, d, "week"), ["view", "click", "error"])
    return out.select("account_id", "bucket", r6("view"), r6("click"), r6("error"))


@query
def ledger(spark, d):
    out = cmp.ledger(ad.measurements(spark, d), ad.states(spark, d), _rules(spark), NOW, ad.PRIORITY)
    return out.select("account_id", "metric", r6("latest"), "latest_day", r6("week"), r6("month"), r6("delta"), r6("delta_pct"))


@query
def series_extremes(spark, d):
    out = series.extremes(_points(spark, d, "day"))
    return out.select("account_id", "metric", r6("high"), "high_bucket", r6("low"), "low_bucket", "covered")


def _stages(spark, d):
    return nights.stage_minutes(ad.states(spark, d), WINDOW, ad.PRIORITY)


@query
def sleep_nights(spark, d):
    return nights.nights(_stages(spark, d)).select("account_id", "night", "source", r6("value"))


@query
def sleep_stages(spark, d):
    return _stages(spark, d).select("account_id", "night", "state_value", r6("minutes"))


@query
def sleep_week(spark, d):
    return nights.fold_nights(nights.nights(_stages(spark, d)), "week").select("account_id", "bucket", r6("value"), "count")


@query
def sleep_summary(spark, d):
    return nights.sleep_summary(nights.nights(_stages(spark, d)), ad.PRIORITY).select("account_id", r6("value"), "nights", "source")


def _routed(spark, d, bucket):
    """Points of all natures: imported, derived, sleep."""
    return series.route(ad.measurements(spark, d), ad.states(spark, d), _rules(spark), _terms(spark), WINDOW, bucket, ad.PRIORITY)


def _paired(spark, d, bucket, lag=0):
    return covary.co_vary(_points(spark, d, bucket), bucket, len(WINDOW.grid(bucket)), lag).select("account_id", "a", "b", "shared", r6("rho"), "ranked")


@query
def covary_same(spark, d):
    return _paired(spark, d, "day")


@query
def covary_next_day(spark, d):
    return _paired(spark, d, "day", 1)


@query
def covary_next_week(spark, d):
    bucket, lag = covary.LAGS["next_week"]
    return _paired(spark, d, bucket, lag)


@query
def covary_strongest(spark, d):
    """The strongest ranked pair of each account, each undirected pair once."""
    found = covary.co_vary(_points(spark, d, "day"), "day", len(WINDOW.grid("day")))
    return covary.strongest(covary.undirected(found)).select("account_id", "a", "b", r6("rho"))


def _pins(spark, d):
    """Pins of every account, in order; two aren't in the catalog."""
    pinned = ["view", "nothing", "click", "purchase", "sleepless", "error", "signup", "engagement", "net", "sleep", "purchase_share"]
    accounts = ad.measurements(spark, d).select("account_id").distinct()
    return accounts.select("account_id", F.posexplode(F.array(*map(F.lit, pinned))).alias("position", "metric"))


def _pinned(spark, d, routed):
    """What each account pairs, from its pins."""
    return covary.inputs(_pins(spark, d), catalog.listing(spark, ad.METRICS | {"sleep": catalog.METRICS["sleep"]}), routed)


@query
def covary_inputs(spark, d):
    """Pinned metrics in order, and why one is left out."""
    return _pinned(spark, d, _routed(spark, d, "day"))


@query
def covary_routed(spark, d):
    """Every ordered pair of all natures of metrics: imported, derived and sleep."""
    found = covary.co_vary(_routed(spark, d, "day"), "day", len(WINDOW.grid("day")))
    return found.select("account_id", "a", "b", "shared", r6("rho"), "ranked")


@query
def covary_pinned(spark, d):
    """The strongest ranked pair among the pinned metrics of each account; pins decide ties."""
    # Points are few; those of all metrics are written once, as pins, pairs and places all read them.
    routed = written(_routed(spark, d, "day"), "points")
    chosen = written(_pinned(spark, d, routed), "pins")
    found = covary.co_vary(covary.of_pins(routed, chosen), "day", len(WINDOW.grid("day")))
    return covary.strongest(found, chosen).select("account_id", "a", "b", r6("rho"))


@query
def covary_fit(spark, d):
    out = covary.fit_lines(covary.aligned(_points(spark, d, "day"), "day"))
    return out.select("account_id", "a", "b", *(r6(c) for c in ("slope", "intercept", "x0", "y0", "x1", "y1")))


@query
def ols_slope(spark, d):
    return covary.slopes(_points(spark, d, "day")).select("account_id", "metric", r6("slope"), "points")


def _estimate_inputs(spark, d):
    """Views as intake, errors as mass, purchases as recorded expenditure; height, age, sex and body fat are fixed."""
    names = {"view": "dietary_energy", "error": "body_mass", "purchase": "total_energy_expenditure"}
    renamed = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    points = _points(spark, d, "day").withColumn("metric", F.element_at(renamed, F.col("metric")))
    out = estimates.daily_inputs(points, WINDOW.start.date())
    fixed = {"height": F.lit(178.0), "age": F.lit(41.5), "sex": F.when(F.col("account_id") == 0, "male").when(F.col("account_id") == 1, "female"), "lean_body_mass": F.lit(None).cast("double"), "body_fat_percentage": F.lit(0.2)}
    return out.withColumns(fixed).withColumn("lean_mass", estimates.lean_mass())


@query
def basal_estimates(spark, d):
    return estimates.basal_estimates(_estimate_inputs(spark, d)).select("account_id", "equation", r6("kcal"), F.concat_ws(",", "missing").alias("missing"))


@query
def expenditure(spark, d):
    return estimates.expenditure(_estimate_inputs(spark, d).withColumn("basal_kcal", estimates.basal("katch_mcardle"))).select("account_id", r6("kcal"), "basis")


@query
def adherence(spark, d):
    """One account's phase hasn't begun yet."""
    plan = _targets(spark, d).select("account_id", "kcal", "protein", F.col("rate").alias("target_rate"))
    inputs = _estimate_inputs(spark, d).join(plan, "account_id").withColumns({"elapsed": F.when(F.col("account_id") != 2, 12.6).otherwise(0.0), "protein_eaten": F.col("recorded")})
    return estimates.adherence(inputs).select("account_id", "days", "thin", r6("target_rate"), r6("rate"), r6("target_kcal"), r6("intake"), r6("target_protein"), r6("protein"))


def _resolved_inputs(spark, d):
    return estimates.resolve_inputs(ad.body_measurements(spark, d), catalog.rules(spark), NOW)


@query
def resolve_inputs(spark, d):
    return _resolved_inputs(spark, d).select("account_id", r6("mass"), r6("height"), r6("lean_mass"), "lean_mass_derived", "lean_source")


@query
def equation_choice(spark, d):
    """The equation to begin with, by the trust that follows from where the composition comes from."""
    inputs = _resolved_inputs(spark, d).withColumns({"age": F.lit(41.5), "sex": F.when(F.col("account_id") % 3 != 2, "female"), "trust": estimates.derived_trust(F.col("lean_source"))})
    return inputs.select("account_id", "trust", estimates.preselect(F.col("trust")).alias("equation"))


@query
def adherence_phase(spark, d):
    """Each account's open phase over its own window, from its start up to now."""
    own = estimates.own_windows(ad.phases(spark, d), NOW)
    figures = estimates.phase_figures(ad.body_measurements(spark, d), catalog.rules(spark), own)
    planned = ad.profiles(spark, d).select("account_id", (F.col("account_id") % 100 * 10.0 + 1500).alias("kcal"), (F.col("account_id") % 50 + 100.0).alias("protein"))
    found = estimates.adherence_of(own, figures, planned)
    return found.select("account_id", "days", "thin", r6("target_rate"), r6("rate"), r6("target_kcal"), r6("intake"), r6("target_protein"), r6("protein"))


@query
def plan(spark, d):
    """All that a plan page reads, a row an account."""
    found = estimates.plan(ad.body_measurements(spark, d), ad.profiles(spark, d), ad.phases(spark, d), catalog.rules(spark), catalog.formula_terms(spark), NOW)
    numbers = ("mass", "height", "lean_mass", "basal_kcal", "expenditure", "actual_rate", "rate", "kcal", "protein", "fat", "carbs", "phase_actual_rate", "actual_kcal", "actual_protein")
    return found.select("account_id", "trust", "equation", "basis", "phase_id", "days", "thin", F.concat_ws(",", "warnings").alias("warnings"), *(r6(n) for n in numbers))


@query
def planned_rate(spark, d):
    """The rate a plan starts from: an open phase's for one account, else the actual one."""
    inputs = _estimate_inputs(spark, d).withColumns({"preview_rate": F.lit(None).cast("double"), "phase_rate": F.when(F.col("account_id") == 0, -0.4), "actual_rate": estimates.actual_rate()})
    return inputs.select("account_id", r6("actual_rate"), r6(estimates.planned_rate(), "rate"))


def _targets(spark, d):
    rate = F.when(F.col("account_id") == 0, -0.5).when(F.col("account_id") == 1, -2.0).otherwise(0.5)
    inputs = _estimate_inputs(spark, d).select("account_id", "mass", "lean_mass", (F.lit(2000.0) + F.col("mass")).alias("expenditure"), rate.alias("rate"), estimates.basal("katch_mcardle").alias("basal_kcal"))
    return estimates.targets(inputs)


@query
def targets(spark, d):
    return _targets(spark, d).select("account_id", r6("kcal"), r6("protein"), r6("fat"), r6("carbs"))


@query
def guardrails(spark, d):
    eaten = _estimate_inputs(spark, d).select("account_id", (F.col("recorded") / 10).alias("actual_protein"))
    return estimates.guardrails(_targets(spark, d).join(eaten, "account_id")).select("account_id", F.concat_ws(",", "warnings").alias("warnings"))


def _sessions(spark, d):
    return ad.sessions(spark, d).filter(sessions.in_days(YEARS))


@query
def session_page(spark, d):
    """A top-k report: the second page of an account's sessions."""
    own = _sessions(spark, d).filter("account_id = 1")
    after = sessions.encode_cursor(datetime(1999, 1, 1), 10**9)
    return sessions.page(own, after).select("id", "activity_type", F.col("start_at").cast("date").alias("day"), r6("duration"))


@query
def session_totals(spark, d):
    return sessions.totals(_sessions(spark, d).filter(sessions.of_groups(["cardio"]))).select("account_id", "sessions", r6("duration"), r6("distance"), r6("energy"))


@query
def session_has_route(spark, d):
    return sessions.with_route_flag(_sessions(spark, d), ad.routes(spark, d)).groupBy("account_id", "activity_type", "has_route").agg(F.count("*").alias("n"))


@query
def activity_other(spark, d):
    out = sessions.displayed(spark, _sessions(spark, d).filter(sessions.of_groups(["other"])))
    return out.groupBy("account_id", "activity_type", "label", "activity_group", "reading").agg(F.count("*").alias("n"))


@query
def session_statistics(spark, d):
    stored = sessions.upsert_statistics(ad.session_stats(spark, d).filter("seq <= 3").drop("seq"), ad.session_stats(spark, d).filter("seq > 3"))
    out = sessions.statistics(_sessions(spark, d), stored)
    return out.groupBy("account_id", "metric", "stat").agg(F.count("*").alias("n"))


@query
def session_readings(spark, d):
    """Durations and speeds of sessions as they are read: a run by its pace, a ride by its speed."""
    shown = sessions.displayed(spark, _sessions(spark, d).withColumn("total_distance", F.col("id") % 50 + 1.0))
    kmh = F.col("total_distance") / (F.col("duration") / 3600)
    return shown.select("id", "reading", formatting.session_duration(F.col("duration")).alias("duration"), formatting.reading(F.col("reading"), kmh).alias("shown"))


@query
def sleep_labels(spark, d):
    """Nights as hours and minutes."""
    return nights.nights(_stages(spark, d)).select("account_id", "night", formatting.duration(F.col("value")).alias("slept"))


@query
def session_next(spark, d):
    """A top-k report: a full page, and the cursor of the one after it on its last row."""
    own = _sessions(spark, d).filter("account_id = 2").filter(sessions.of_groups(excluded=["yoga", "parkour"]))
    return sessions.page_with_next(own).select("id", "activity_type", "next_cursor")


@query
def session_detail(spark, d):
    """Sessions with what belongs to them: statistics by name, and routes."""
    stats = ad.session_stats(spark, d).withColumn("seq", (F.col("seq") * 1000 + F.col("value")).cast("bigint"))
    found = sessions.detail(_sessions(spark, d), sessions.upsert_statistics(stats.filter("seq < 0"), stats), ad.routes(spark, d).distinct())
    shown = F.array_join(F.transform("stats", lambda x: F.concat_ws(":", x["metric"], x["stat"], F.format_number(x["value"], 2))), ",")
    return found.select("account_id", "id", "activity_type", shown.alias("stats"), F.size("routes").alias("routes"))


@query
def existence_probes(spark, d):
    """Whether each customer has rows of any family."""
    return has_rows(ad.profiles(spark, d), ad.user_measurements(spark, d), ad.order_measurements(spark, d, F.col("o_custkey")))


@query
def bucket_keys(spark, d):
    """Weekly points under the keys of their weeks, days and months."""
    found = series.points(daily(ad.order_measurements(spark, d), _rules(spark)), "week")
    return found.select("account_id", *(bucket_key(F.col("bucket"), b).alias(b) for b in ("day", "week", "month")), r6("value"))


def _notes(spark, d, account=f"o_custkey % {ad.ACCOUNTS}"):
    """Orders as notes: some with an end."""
    day = F.col("o_orderdate").cast("date")
    return ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(account).alias("account_id"), F.col("o_orderstatus").alias("label"), day.alias("starts_on"), F.when(F.col("o_orderkey") % 3 != 0, F.date_add(day, 20)).alias("ends_on"))


@query
def annotation_overlap(spark, d):
    """Notes folded onto months; one without an end is a single day."""
    return cmp.fold_spans(_notes(spark, d), YEARS, "month").select("id", "account_id", "starts_on", "ends_on", "first_bucket", "last_bucket")


@query
def phases_folded(spark, d):
    """The same spans as phases: one without an end lasts to the window's."""
    return cmp.fold_spans(_notes(spark, d), YEARS, "month", open_ends=True).select("id", "account_id", "starts_on", "ends_on", "first_bucket", "last_bucket")


@query
def annotation_axis(spark, d):
    """Notes folded onto months, then onto the months that their customer's figures have: an axis that the data gives."""
    axis = series.points(resolved_days(ad.order_measurements(spark, d, F.col("o_custkey")), _rules(spark), [YEARS]), "month")
    notes = _notes(spark, d, "o_custkey").withColumns({"starts_on": F.date_sub("starts_on", 70), "ends_on": F.date_add(F.coalesce("ends_on", "starts_on"), 70)})
    folded = cmp.fold_spans(notes, YEARS, "month").select("account_id", "id", "first_bucket", "last_bucket")
    return cmp.onto_axis(folded, axis).select("id", "account_id", "from_bucket", "to_bucket")


@query
def annotation_marks(spark, d):
    """How many notes begin in each bucket of the axis that an account's panel has."""
    axis = series.points(resolved_days(ad.order_measurements(spark, d), _rules(spark), [YEARS]), "month")
    return cmp.axis_marks(cmp.onto_axis(cmp.alike(cmp.fold_spans(_notes(spark, d), YEARS, "month")), axis))


@query
def source_spans(spark, d):
    out = cmp.source_spans(ad.measurements(spark, d), ad.states(spark, d))
    return out.select("account_id", "source", F.col("first_at").cast("string").alias("first_at"), F.col("last_at").cast("string").alias("last_at"), "rows")


@query
def distinct_sources(spark, d):
    return sources_in(ad.measurements(spark, d), WINDOW)


@query
def overall_span(spark, d):
    out = cmp.overall_span(ad.measurements(spark, d), ad.states(spark, d), ad.sessions(spark, d))
    return out.select("account_id", F.col("first_at").cast("date").alias("first_day"), F.col("last_at").cast("date").alias("last_day"))


@query
def history_events(spark, d):
    notes = _notes(spark, d)
    k = F.col("id")
    phases = notes.filter("label = 'F'").select("account_id", F.col("starts_on").alias("started_at"), F.col("ends_on").alias("ended_at"), (k % 3 - 1).cast("double").alias("rate_pct_per_week"))
    imports = notes.filter("label = 'P'").select("account_id", F.concat(F.lit("export-"), k.cast("string")).alias("source_file"), F.col("starts_on").alias("imported_at"), (k % 500).alias("added_count"), (k % 7).alias("skipped_count"), (k % 3).alias("unmapped_count"))
    spans = cmp.source_spans(ad.measurements(spark, d), ad.states(spark, d))
    unmapped = ingest.route_records(spark, _records(spark, d))["unmapped"].groupBy("account_id").agg(F.count("*").alias("n"))
    found = cmp.history_events(imports, phases, notes.filter("label = 'O'").withColumn("body", F.when(k % 2 == 0, F.concat(F.lit("about "), k.cast("string")))), spans, unmapped)
    return found.select("account_id", "day", "kind", "kind_rank", "label", "body", "ends_on", r6("rate"), "added", "skipped", "unmapped", "rows")


def _records(spark, d):
    kinds = {"view": "HKQuantityTypeIdentifierBodyMass", "click": "HKQuantityTypeIdentifierBodyTemperature", "purchase": "HKCategoryTypeIdentifierSleepAnalysis", "error": "HKQuantityTypeIdentifierUnknown", "signup": "HKQuantityTypeIdentifierStepCount"}
    units = {"view": "lb", "click": "degF", "purchase": "", "error": "count", "signup": "kg"}
    at = lambda m: F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), F.col("metric"))
    start = F.date_format("start_at", "yyyy-MM-dd HH:mm:ss")
    value = F.when(F.col("metric") == "purchase", "HKCategoryValueSleepAnalysisAsleepCore").when(F.col("id") % 11 == 0, "n/a").otherwise((F.col("id") % 200).cast("string"))
    rows = ad.measurements(spark, d)
    return rows.select("account_id", at(kinds).alias("type"), at(units).alias("unit"), value.alias("value"), "source", F.concat(start, F.lit(" +0200")).alias("start_raw"), F.concat(start, F.lit(" +0200")).alias("end_raw"), F.col("id").alias("seq"))


@query
def unmapped_route(spark, d):
    """All families out of one pass over the records."""
    tagged = ingest.tag_records(spark, _records(spark, d))
    return tagged.groupBy("family", "name").agg(F.count("*").alias("n"), r6(F.sum(F.when(F.col("family") == "measurements", F.col("canonical"))), "total"))


@query
def count_unmapped(spark, d):
    return ingest.route_records(spark, _records(spark, d))["unmapped"].groupBy("source_type").agg(F.count("*").alias("n"))


@query
def vendor_times(spark, d):
    return _records(spark, d).select("seq", ingest.vendor_time(F.col("start_raw")).cast("string").alias("start_at"))


@query
def unit_convert(spark, d):
    """Every line is given one of ten conversions by its order's key."""
    given = [("lb", "kg"), ("km/hr", "m/s"), ("degF", "degC"), ("degC", "K"), ("kJ", "kcal"), ("kg", "m"), ("%", "%"), ("opaque", "opaque"), ("degC", "kg"), ("oz", "g")]
    pairs = spark.createDataFrame([(k, *p) for k, p in enumerate(given)], "k bigint, from_unit string, to_unit string")
    rows = ad.table(spark, d, "lineitem").select(F.pmod(F.col("l_orderkey"), F.lit(len(given))).cast("bigint").alias("k"), F.col("l_quantity").alias("v"))
    out = ingest.convert_units(spark, rows.join(F.broadcast(pairs), "k"), "v", "from_unit", "to_unit", "converted")
    return out.groupBy("from_unit", "to_unit").agg(F.count("converted").alias("n"), F.round(F.sum("converted"), 4).alias("total"))


def _keyed(spark, d):
    rows = ad.measurements(spark, d).withColumn("value", F.floor("value"))
    key = content_key(F.col("metric"), F.col("source"), F.col("value"))
    return rows.select("id", "account_id", "metric", "value", key.alias("content_key"), F.col("id").alias("seq"))


@query
def dedupe_content_key(spark, d):
    rows = _keyed(spark, d)
    return ingest.new_rows(rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0")).select("id", "account_id", "metric", "content_key")


@query
def import_report(spark, d):
    rows = _keyed(spark, d)
    return ingest.report(rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0"), "measurements", "metric").select("account_id", "family", "name", "added", "skipped")


@query
def manual_list(spark, d):
    """A top-k report: the newest manual rows of each metric's store."""
    return ingest.list_manual(ad.measurements(spark, d), "view").select("id", "account_id", r6("value"))


def _batches(spark, d):
    """Events as three imports: the last one brings late rows of every day, and rows of the first one again."""
    rows = ad.measurements(spark, d).withColumns({"seq": F.col("id"), "content_key": F.sha2(F.col("id").cast("string"), 256)})
    early, part = F.col("start_at") < F.lit("2024-01-15").cast("timestamp_ntz"), F.pmod(F.xxhash64("id"), F.lit(3))
    return [rows.filter(early & (part > 0)), rows.filter(~early & (part > 0)), rows.filter((part == 0) | early)]


@query
def daily_followed(spark, d):
    """The daily table after three imports, one of them late: each is merged into the days that it touches."""
    store = scratch(spark, "store")
    for batch in _batches(spark, d):
        sinks.append_measurements(spark, batch, store)
        incremental.follow(spark, store, _rules(spark))
    return incremental.daily_store(spark, store).read().select("account_id", "metric", "source", "day", "n", r6("total"), r6("low"), r6("high"), r6("latest"))


@query
def store_delete(spark, d):
    """What a store holds after imports that overlap, the deletion of all manual rows of one account, and a compaction."""
    store = scratch(spark, "store")
    for batch in _batches(spark, d):
        stored = sinks.append_measurements(spark, batch, store)
    held = sinks.family_store(spark, store, "measurements")
    held.delete((F.col("account_id") == 1) & (F.col("source") == "Manual"))
    held.compact()
    return held.read().groupBy("account_id", "metric", "source").agg(F.count("*").alias("n"), r6(F.sum("value"), "total"))


def _export(spark, d) -> str:
    """Records as vendor exports, a file a task: every eleventh one is told again inside a correlation."""
    folder = scratch(spark, "export")
    spans = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    names = {"type": "type", "unit": "unit", "value": "value", "sourceName": "source", "startDate": "start_raw", "endDate": "end_raw"}
    tag = F.concat(F.lit("<Record"), *(F.concat(F.lit(f' {a}="'), spans(F.col(c)), F.lit('"')) for a, c in names.items()), F.lit("/>"))
    rows = _records(spark, d).select(F.concat(tag, F.when(F.col("seq") % 11 == 0, F.concat(F.lit('<Correlation type="c">'), tag, F.lit("</Correlation>"))).otherwise("")).alias("value"))

    def document(frames):
        yield pd.DataFrame({"value": ['<?xml version="1.0"?>', "<HealthData>"]})
        yield from frames
        yield pd.DataFrame({"value": ["</HealthData>"]})

    rows.mapInPandas(document, "value string").write.text(folder)
    return folder


@query
def export_scan(spark, d):
    """The records of exports that stand under the root, found again by one scan of their files."""
    found = health_xml.read_records(spark, _export(spark, d)).withColumns({"account_id": F.lit(1).cast("bigint")})
    tagged = ingest.tag_records(spark, found.withColumn("seq", F.xxhash64("seq")))
    return tagged.groupBy("family", "name").agg(F.count("*").alias("n"), r6(F.sum(F.when(F.col("family") == "measurements", F.col("canonical"))), "total"))


@query
def distinct_metrics(spark, d):
    return series.distinct_metrics(ad.measurements(spark, d))


@query
def haversine_length(spark, d):
    return routes.lengths(ad.track_points(spark, d)).select("route_id", "points", F.round("km", 4).alias("km"))


@query
def ascent_hysteresis(spark, d):
    return routes.ascent(ad.track_points(spark, d)).select("route_id", r6("ascent"), r6("descent"))


@query
def route_samples(spark, d):
    return routes.samples(ad.track_points(spark, d), 20).select("route_id", "seq", F.round("km", 4).alias("km"), F.round("speed", 3).alias("speed"))


@query
def route_simplify(spark, d):
    return routes.simplify(ad.track_points(spark, d), 30, None).withColumn("at", F.col("at").cast("string"))


@query
def point_distance(spark, d):
    p = ad.track_points(spark, d)
    return p.select("seq", F.round(haversine(F.lit(48.5), F.lit(2.25), F.col("lat"), F.col("lon")), 6).alias("km"))


@query
def metric_listing(spark, d):
    """The catalog against the data: how many rows of each listed event metric there are."""
    rows = ad.measurements(spark, d).groupBy(F.col("metric").alias("slug")).agg(F.count("*").alias("rows"))
    return catalog.listing(spark, ad.METRICS).join(rows, "slug", "left").select("slug", "unit", "nature", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))


@query
def stream_daily(spark, d):
    """A stream over the events: daily sums by way of Structured Streaming, read until all is there."""
    from tidemark.streaming import ingest as st

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(d)
    rows = source.select((F.col("user_id") % ad.ACCOUNTS).alias("account_id"), F.col("event_type").alias("metric"), "value", F.col("ts").cast("timestamp").alias("start_at"))
    folder = scratch(spark, "stream")
    # Updates go to a folder for each batch, which a repeated batch writes anew: state ends with the watermark, the sink is idempotent.
    out = st.daily(rows, late="365 days").writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    out.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    keys = ["account_id", "metric", "bucket"]
    last = spark.read.parquet(f"{folder}/out").groupBy(*keys).agg(F.max_by("sum", "batch").alias("sum"), F.max_by("count", "batch").alias("count"))
    return last.select(*keys, r6("sum"), "count")
