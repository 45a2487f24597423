"""The engine's rules on literal rows."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import formatting
from tidemark.functions.columns import bucket_key
from tidemark.operators import compare, covary, estimates, ingest, nights, panels, routes, series, sessions
from tidemark.operators.resolve import has_rows, resolve, resolved_days
from tidemark.plans.timeaxis import Window

WATCH, PHONE = "My Apple Watch", "An iPhone"
JAN = Window.of(date(2024, 1, 1), date(2024, 2, 1))


def at(text):
    return datetime.fromisoformat(f"2024-{text}" + (":00" if "T" in text else "T12:00:00"))


def measured(spark, rows):
    full = [(k, r[4] if len(r) > 4 else 1, r[0], float(r[1]), at(r[2]), r[3] if len(r) > 3 else WATCH) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, "id bigint, account_id bigint, metric string, value double, start_at timestamp_ntz, source string")


def values(df, account=1):
    return {(r["metric"], str(r["bucket"])[5:]): r["value"] for r in df.collect() if r["account_id"] == account}


def day_points(spark, rows, window=JAN, bucket="day"):
    return series.series(measured(spark, rows), catalog.rules(spark), window, bucket)


def whole(spark, rows, window=JAN):
    return {r["metric"]: r for r in series.summary(resolved_days(measured(spark, rows), catalog.rules(spark), [window])).collect()}


def test_catalog():
    assert len(catalog.METRICS) == 108 and catalog.problems(catalog.METRICS) == []
    by_rule = [sum(m.rule == r for m in catalog.METRICS.values()) for r in ("sum", "average", "latest", "duration_by_state")]
    assert by_rule == [56, 38, 7, 1]
    assert catalog.vendor_type("dietary_vitamin_b12") == "HKQuantityTypeIdentifierDietaryVitaminB12"
    bad = {"x": catalog.Metric("x", "g", formula=catalog.Formula(((1.0, "nothing"),)))}
    assert catalog.problems(bad)


def test_sum_average_latest(spark):
    rows = [("steps", 100, "01-01T08:00"), ("steps", 200, "01-01T18:00"), ("steps", 50, "01-02T09:00"), ("heart_rate", 60, "01-01T01:00"), ("heart_rate", 80, "01-01T02:00"), ("heart_rate", 100, "01-01T03:00")]
    rows += [("body_mass", 80.0, "01-01T08:00"), ("body_mass", 79.5, "01-01T20:00"), ("body_mass", 79.0, "01-05")]
    found = day_points(spark, rows)
    assert values(found) == {("steps", "01-01"): 300, ("steps", "01-02"): 50, ("heart_rate", "01-01"): 80, ("body_mass", "01-01"): 79.5, ("body_mass", "01-05"): 79.0}
    band = found.filter("metric = 'heart_rate'").first()
    assert (band["min"], band["max"], band["count"]) == (60, 100, 3)
    assert whole(spark, rows)["steps"]["value"] == 350


def test_weeks_and_months(spark):
    rows = [("steps", 10, "01-01"), ("steps", 20, "01-07"), ("steps", 30, "01-08")]
    assert values(day_points(spark, rows, bucket="week")) == {("steps", "01-01"): 30, ("steps", "01-08"): 30}
    assert values(day_points(spark, rows, bucket="month")) == {("steps", "01-01"): 60}


def test_election_and_isolation(spark):
    rows = [("steps", 300, "01-01", WATCH), ("steps", 280, "01-01", PHONE), ("steps", 9999, "01-01", PHONE, 2)]
    assert values(day_points(spark, rows)) == {("steps", "01-01"): 300}


def test_average_summary_is_not_a_mean_of_means(spark):
    rows = [("heart_rate", 60, "01-01T01:00"), ("heart_rate", 60, "01-01T02:00"), ("heart_rate", 60, "01-01T03:00"), ("heart_rate", 180, "01-02")]
    r = whole(spark, rows)["heart_rate"]
    assert (r["value"], r["min"], r["max"]) == (90, 60, 180)


def test_manual_overlay(spark):
    rows = [("steps", 4000, "01-01"), ("steps", 3000, "01-02T08:00"), ("steps", 2000, "01-02T09:00"), ("steps", 9000, "01-02T10:00", "Manual")]
    assert values(day_points(spark, rows)) == {("steps", "01-01"): 4000, ("steps", "01-02"): 9000}
    assert whole(spark, rows)["steps"]["value"] == 13000
    rows = [("body_fat_percentage", 0.27, "01-03T08:00"), ("body_fat_percentage", 0.22, "01-03T06:00", "Manual")]
    assert values(day_points(spark, rows)) == {("body_fat_percentage", "01-03"): 0.22}
    rows = [("steps", 5, "01-10", "Manual")]
    found = resolve(measured(spark, rows), catalog.rules(spark), JAN).first()
    assert found["reported_source"] == "Manual"
    outside = [("steps", 7, "01-02T12:00"), ("steps", 9, "01-02T08:00", "Manual")]
    late = Window(datetime(2024, 1, 2, 10), datetime(2024, 1, 5))
    assert values(series.series(measured(spark, outside), catalog.rules(spark), late, "day")) == {("steps", "01-02"): 7}


def test_derived(spark):
    rows = [("active_energy", 400, "01-01"), ("active_energy", 600, "01-02"), ("basal_energy", 1600, "01-01"), ("basal_energy", 1400, "01-02"), ("dietary_protein", 100, "01-01"), ("dietary_protein", 140, "01-02"), ("body_mass", 80, "01-01"), ("body_mass", 78, "01-02")]
    rules, terms = catalog.rules(spark), catalog.formula_terms(spark)
    week = values(series.derived_points(resolved_days(measured(spark, rows), rules, [JAN]), terms, "week"))
    assert week == {("total_energy_expenditure", "01-01"): 4000, ("protein_per_kg", "01-01"): pytest.approx(240 / 78)}
    rows = [("dietary_protein", 100, "01-01"), ("dietary_protein", 200, "01-02"), ("body_mass", 100, "01-01"), ("body_mass", 50, "01-02")]
    resolved = resolved_days(measured(spark, rows), rules, [JAN])
    assert [r["value"] for r in series.derived_summary(resolved, terms).collect()] == [6]
    assert values(series.derived_points(resolved, terms, "day")) == {("protein_per_kg", "01-01"): 1, ("protein_per_kg", "01-02"): 4}


def test_compare(spark):
    now, before = Window.of(date(2024, 1, 8), date(2024, 1, 11)), Window.of(date(2024, 1, 5), date(2024, 1, 8))
    rows = [("steps", 100, "01-08"), ("steps", 300, "01-10"), ("steps", 10, "01-05"), ("steps", 20, "01-06"), ("steps", 30, "01-07")]
    found = compare.compare(spark, compare.points_of_both(measured(spark, rows), catalog.rules(spark), now, before, "day"), now, before, "day").orderBy("bucket").collect()
    assert [(str(r["baseline_bucket"])[5:], r["baseline_value"]) for r in found] == [("01-05", 10), ("01-07", 30)]
    rows = [("steps", 100, "01-08"), ("steps", 200, "01-09"), ("steps", 300, "01-10"), ("steps", 10, "01-05"), ("steps", 30, "01-07")]
    found = compare.compare(spark, compare.points_of_both(measured(spark, rows), catalog.rules(spark), now, before, "day"), now, before, "day").orderBy("bucket").collect()
    assert [r["baseline_value"] for r in found] == [10, None, 30]


def slept(spark, rows):
    full = [(1, "sleep", s, at(a), at(b), src) for s, a, b, src in rows]
    return spark.createDataFrame(full, "account_id bigint, kind string, state_value string, start_at timestamp_ntz, end_at timestamp_ntz, source string")


def nightly(spark, rows, window=JAN):
    return {str(r["night"])[5:]: r["value"] for r in nights.nights(nights.stage_minutes(slept(spark, rows), window)).collect()}


def test_sleep(spark):
    assert nightly(spark, [("asleep_core", "01-03T23:00", "01-04T06:00", WATCH)]) == {"01-04": 420}
    assert nightly(spark, [("asleep_core", "01-03T23:00", "01-04T02:00", WATCH), ("awake", "01-04T02:00", "01-04T02:20", WATCH), ("asleep_rem", "01-04T02:20", "01-04T06:00", WATCH)]) == {"01-04": 400}
    two = [("asleep_core", "01-01T23:00", "01-02T06:00", WATCH), ("in_bed", "01-01T22:00", "01-02T07:00", PHONE), ("in_bed", "01-02T22:00", "01-03T06:00", PHONE)]
    assert nightly(spark, two) == {"01-02": 420, "01-03": 480}
    edge = [("asleep_core", "01-07T23:00", "01-07T23:59", WATCH), ("asleep_core", "01-08T00:00", "01-08T06:00", WATCH)]
    assert nightly(spark, edge, Window.of(date(2024, 1, 1), date(2024, 1, 8))) == {}
    assert nightly(spark, edge, Window.of(date(2024, 1, 8), date(2024, 1, 15))) == {"01-08": 419}
    week = [("asleep", "01-02T00:00", "01-02T06:00", WATCH), ("asleep", "01-03T00:00", "01-03T05:00", WATCH), ("asleep", "01-07T23:00", "01-08T06:00", WATCH)]
    folded = nights.fold_nights(nights.nights(nights.stage_minutes(slept(spark, week), JAN)), "week").orderBy("bucket").collect()
    assert [(r["value"], r["count"]) for r in folded] == [(660, 2), (420, 1)]
    stages = nights.fold_stages(nights.stage_minutes(slept(spark, week), JAN), "month").first()["states"]
    assert stages == {"asleep": 1080.0}
    many = [(s, "01-10T0%d:00" % k, "01-10T0%d:30" % k, WATCH) for k, s in enumerate(("awake", "asleep_rem", "zone", "asleep_deep", "asleep_core"))]
    shown = nights.fold_stages(nights.stage_minutes(slept(spark, many), JAN), "day").select(F.map_keys("states").alias("k")).first()["k"]
    assert list(shown) == ["asleep_deep", "asleep_core", "asleep_rem", "awake", "zone"]


def test_minutes_of_a_night_are_summed_exactly(spark):
    """Times of half a minute in all, in parts of uneven seconds and in any order, are rounded as what they are."""
    at_second = lambda k: datetime(2024, 1, 10, 0, 0, 0) + timedelta(seconds=k)
    for lengths in ([119, 81, 118, 76, 123, 77, 228, 23, 6, 29, 188, 182, 186, 198, 16], [1, 149, 131, 137, 192, 102, 80, 15, 107, 161, 226, 89, 5, 71, 244]):
        ends = [sum(lengths[: k + 1]) for k in range(len(lengths))]
        assert ends[-1] % 60 == 30
        rows = [(1, "sleep", ("asleep_core", "asleep_rem", "asleep_deep")[k % 3], at_second(end - n), at_second(end), WATCH) for k, (n, end) in enumerate(zip(lengths, ends, strict=True))]
        frame = spark.createDataFrame(rows, "account_id int, kind string, state_value string, start_at timestamp_ntz, end_at timestamp_ntz, source string")
        (night,) = nights.nights(nights.stage_minutes(frame, JAN)).select("value", formatting.duration(F.col("value")).alias("shown")).collect()
        assert night["value"] == ends[-1] / 60 and night["shown"] == f"{(ends[-1] + 30) // 60}m"



def test_covary(spark):
    rows = [(1, m, date(2024, 1, 1 + k + (lag if m == "resting_heart_rate" else 0)), float(v)) for lag in (1,) for m, vs in (("steps", [1000, 2000, 3000, 4000]), ("resting_heart_rate", [50, 52, 54, 56])) for k, v in enumerate(vs)]
    points = spark.createDataFrame(rows, "account_id bigint, metric string, bucket date, value double")
    lagged = {(r["a"], r["b"]): (r["shared"], r["rho"]) for r in covary.co_vary(points, "day", 5, 1).collect()}
    assert lagged["steps", "resting_heart_rate"] == (4, pytest.approx(1))
    flat = spark.createDataFrame([(1, m, date(2024, 1, d), v) for d in range(1, 6) for m, v in (("x", 1.0), ("y", float(d)))], "account_id bigint, metric string, bucket date, value double")
    assert {r["rho"] for r in covary.co_vary(flat, "day", 5).collect()} == {0.0}
    ranks = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 20.0), (1, 30.0)], "k int, v double").select(covary.average_rank("v", ["k"]).alias("r")).collect()
    assert sorted(r["r"] for r in ranks) == [1, 2.5, 2.5, 4]
    assert [covary.shared_threshold(n) for n in (5, 10, 30)] == [5, 8, 18]


def test_estimates(spark):
    row = spark.range(1).select(F.lit(1).alias("account_id"), *(F.lit(v).alias(k) for k, v in {"mass": 91.0, "height": 184.0, "lean_mass": 66.4, "age": 30.0, "sex": "male"}.items()))
    found = {r["equation"]: r["kcal"] for r in estimates.basal_estimates(row).collect()}
    assert found == {"katch_mcardle": pytest.approx(1804.24), "cunningham": pytest.approx(1960.8), "mifflin_st_jeor": pytest.approx(1915), "harris_benedict": pytest.approx(2020.195)}
    plan = spark.range(1).select(F.lit(1).alias("account_id"), *(F.lit(v).alias(k) for k, v in {"expenditure": 2390.0, "rate": -0.5, "mass": 91.6, "lean_mass": 66.8, "basal_kcal": 1900.0}.items()))
    r = estimates.targets(plan).first()
    assert r["kcal"] == pytest.approx(1886.3, abs=1) and r["protein"] == pytest.approx(133.6)
    assert estimates.guardrails(estimates.targets(plan).withColumn("actual_protein", F.lit(None).cast("double"))).first()["warnings"] == ["below_basal"]
    rates = spark.createDataFrame([(-0.25,), (-1.0,), (-2.5,), (0.3,)], "r double").select(estimates.protein_per_kg(F.col("r")).alias("p")).collect()
    assert [x["p"] for x in rates] == [pytest.approx(v) for v in (1.8, 2.4, 2.4, 1.6)]
    days = [(1, m, date(2024, 1, 1 + i), v) for i in range(28) for m, v in (("dietary_energy", 2078.0), ("body_mass", 92.75 - 1.75 * i / 27))]
    inputs = estimates.daily_inputs(spark.createDataFrame(days, "account_id bigint, metric string, bucket date, value double"), date(2024, 1, 1)).withColumn("basal_kcal", F.lit(1900.0))
    got = estimates.expenditure(inputs).first()
    assert got["basis"] == "observed" and got["kcal"] == pytest.approx(2577, abs=15)


def test_units(spark):
    df = spark.createDataFrame([(1.0, "lb", "kg"), (3.6, "km/hr", "m/s"), (32.0, "degF", "degC"), (0.0, "degC", "K"), (1.0, "kg", "m"), (5.0, "odd", "odd"), (1.0, "odd", "kg")], "v double, f string, t string")
    got = [r["out"] for r in ingest.convert_units(spark, df, "v", "f", "t", "out").collect()]
    assert got == [pytest.approx(0.45359237), pytest.approx(1), pytest.approx(0), pytest.approx(273.15), None, 5.0, None]


def track(spark, points):
    return spark.createDataFrame([("r", k, float(a), float(b), None if e is None else float(e), None) for k, (a, b, e) in enumerate(points)], "route_id string, seq int, lat double, lon double, ele double, at timestamp_ntz")


def test_routes(spark):
    assert routes.summaries(track(spark, [(48, 2, None), (49, 2, None)])).first()["km"] == pytest.approx(111.2, abs=0.5)
    jitter = routes.summaries(track(spark, [(48 + k / 1e5, 2, 1.5 * (k % 2)) for k in range(200)])).first()
    assert (jitter["ascent"], jitter["descent"]) == (0, 0)
    assert 45 <= routes.summaries(track(spark, [(48 + k / 1e5, 2, k) for k in range(51)])).first()["ascent"] <= 50
    zigzag = track(spark, [(48 + k / 1e4, 2 + (k % 2) / 100, None) for k in range(4000)])
    kept = sorted(r["seq"] for r in routes.simplify(zigzag, 500).collect())
    assert len(kept) <= 500 and kept[0] == 0 and kept[-1] == 3999
    assert routes.simplify(track(spark, [(48, 2, None), (48.5, 2, None), (49, 2, None)]), 2).count() == 2
    assert routes.samples(zigzag, 100).count() <= 101


def test_sessions(spark):
    rows = [(k, 1, t, at(f"01-0{d}"), 60.0, None, 5.0) for k, (t, d) in enumerate([("running", 1), ("parkour", 2), ("yoga", 2), ("swimming", 3)])]
    s = spark.createDataFrame(rows, "id bigint, account_id bigint, activity_type string, start_at timestamp_ntz, duration double, total_distance double, total_energy double")
    assert [r["id"] for r in sessions.page(s, size=3).collect()] == [3, 2, 1]
    assert [r["id"] for r in sessions.page(s, sessions.encode_cursor(at("01-02"), 2)).collect()] == [1, 0]
    assert [r["id"] for r in s.filter(sessions.of_groups(["other"])).collect()] == [1]
    assert s.filter(sessions.of_groups(["other", "cardio"], ["yoga"])).count() == 3
    assert s.filter(sessions.of_groups()).count() == 4
    t = sessions.totals(s).first()
    assert (t["sessions"], t["duration"], t["distance"], t["energy"]) == (4, 240, None, 20)


def test_manual_entries(spark):
    now = datetime(2024, 1, 1, 12)
    assert ingest.manual_entry(spark, 1, "body_mass", 80.0, now, now).first()["original_unit"] == "kg"
    for metric, value, when in (("nothing", 1.0, now), ("calorie_balance", 1.0, now), ("sleep", 1.0, now), ("steps", float("nan"), now), ("steps", 1.0, datetime(2024, 1, 1, 12, 6))):
        with pytest.raises(ingest.ManualError):
            ingest.manual_entry(spark, 1, metric, value, when, now)


def test_heights_count_beyond_the_step(spark):
    r = routes.ascent(track(spark, [(48, 2, e) for e in (0, 3, 6, 9)])).first()
    assert (r["ascent"], r["descent"]) == (6, 0)


def test_open_spans(spark):
    rows = spark.createDataFrame([(1, date(2024, 1, 3), None), (2, date(2024, 1, 3), date(2024, 3, 1)), (3, date(2024, 1, 9), date(2024, 1, 2))], "id int, starts_on date, ends_on date")
    of = lambda open_ends: {r["id"]: (r["first_bucket"].day, r["last_bucket"].day) for r in compare.fold_spans(rows, JAN, "day", open_ends=open_ends).collect()}
    # A note that is the wrong way round is turned; a phase that ends before it starts is none.
    assert of(False) == {1: (3, 3), 2: (3, 31), 3: (2, 9)} and of(True) == {1: (3, 31), 2: (3, 31)}
    rates = spark.createDataFrame([(-0.5,), (0.0,), (0.2,)], "r double").select(compare.phase_kind(F.col("r")).alias("k")).collect()
    assert [r["k"] for r in rates] == ["cut", "maintenance", "bulk"]


def test_adherence_guardrails_and_choice(spark):
    row = {"account_id": 1, "elapsed": 0.0, "target_rate": -0.5, "kcal": 1900.0, "protein": 130.0, "intake": 2100.0, "protein_eaten": 100.0, "mass": 90.0, "mass_slope": -0.05, "mass_days": 5}
    make = lambda **more: spark.range(1).select(*(F.lit(v).alias(k) for k, v in (row | more).items()))
    r = estimates.adherence(make()).first()
    assert (r["days"], r["thin"], r["rate"], r["intake"], r["protein"], r["target_kcal"]) == (1, True, None, None, None, 1900.0)
    r = estimates.adherence(make(elapsed=20.4)).first()
    assert (r["days"], r["thin"], r["intake"], r["protein"]) == (20, False, 2100.0, 100.0) and r["rate"] == pytest.approx(-0.05 * 7 / 90 * 100)
    plan = lambda eaten, rate=-0.5: spark.range(1).select(*(F.lit(v).alias(k) for k, v in {"account_id": 1, "kcal": 2000.0, "basal_kcal": 1800.0, "rate": rate, "carbs": 50.0, "protein": 130.0, "actual_protein": eaten}.items()))
    warned = [estimates.guardrails(plan(*x)).first()["warnings"] for x in ((129.0,), (131.0,), (10.0, 0.5))]
    assert warned == [["protein_under_floor"], [], []]
    body = spark.createDataFrame([("measured", 60.0, 80.0), ("estimated", 60.0, 80.0), ("unknown", 60.0, None), ("measured", None, 80.0), ("unknown", None, None)], "trust string, lean_mass double, mass double")
    body = body.withColumns({"height": F.lit(180.0), "age": F.lit(30.0), "sex": F.lit("male")})
    chosen = [r["e"] for r in body.select(estimates.preselect(F.col("trust")).alias("e")).collect()]
    assert chosen == ["katch_mcardle", "mifflin_st_jeor", "katch_mcardle", "mifflin_st_jeor", None]


def test_resolved_body(spark):
    now = datetime(2024, 2, 20, 12)
    rows = [("body_mass", 80, "02-01"), ("body_mass", 82, "02-11"), ("body_mass", 99, "01-01"), ("height", 181, "01-01"), ("body_fat_percentage", 0.25, "01-02", "Manual")]
    r = estimates.resolve_inputs(measured(spark, rows), catalog.rules(spark), now).first()
    assert (r["mass"], r["height"], r["lean_mass"], r["lean_mass_derived"], r["lean_source"]) == (81, 181, pytest.approx(81 * 0.75), True, "Manual")


def test_ledger(spark):
    """This week against the seven days before, by the signed base; sleep by nights that have data; a metric without recent rows keeps its row."""
    now = datetime(2024, 1, 29, 15, 30)
    rows = [("steps", 700, "01-25"), ("steps", 1400, "01-20"), ("heart_rate", 60, "01-23T08:00"), ("heart_rate", 50, "01-17T08:00"), ("body_mass", 80, "01-28"), ("uv_exposure", 3, "01-01T01:00")]
    rows = [("flights_climbed", 5, "01-01T00:00"), *rows]
    slept_rows = [("asleep", "01-25T00:00", "01-25T06:00", WATCH), ("asleep", "01-24T00:00", "01-24T08:00", WATCH), ("asleep", "01-18T00:00", "01-18T05:00", WATCH)]
    late = Window(datetime(2023, 1, 1), datetime(2024, 1, 30))
    assert late.days
    found = {r["metric"]: r for r in compare.ledger(measured(spark, rows), slept(spark, slept_rows), catalog.rules(spark), now).collect()}
    figures = lambda m: tuple(found[m][c] for c in ("latest", "week", "month", "delta", "delta_pct"))
    assert figures("steps") == (700, 100, pytest.approx(70), pytest.approx(-100), pytest.approx(-50))
    assert figures("heart_rate") == (60, 60, 55, 10, pytest.approx(20))
    assert figures("body_mass") == (80, 80, 80, None, None)
    assert figures("sleep") == (360, 420, 380, 120, pytest.approx(40))
    assert set(found) == {"steps", "heart_rate", "body_mass", "uv_exposure", "flights_climbed", "sleep"}


def test_summary_modes(spark):
    summed = spark.createDataFrame([(1, "steps", 70.0, None, None), (1, "sleep", 900.0, None, 2.0), (1, "body_mass", 80.0, 81.0, None), (1, "protein_per_kg", 1.5, None, None), (1, "calorie_balance", -700.0, None, None)], "account_id int, metric string, value double, mean double, nights double")
    of = lambda average: {r["metric"]: (r["mode"], r["figure"]) for r in series.figures(summed, catalog.modes(spark), 7, average).collect()}
    assert of(True) == {"steps": ("per_day", 10), "sleep": ("per_night", 450), "body_mass": ("mean", 81), "protein_per_kg": ("total", 1.5), "calorie_balance": ("per_day", -100)}
    assert {m for m, _ in of(False).values()} == {"total"}


def test_reads_scan_once_and_dont_sort_raw_rows(spark):
    from tidemark.queries import QUERIES

    for name in ("series_sum_day", "series_summary", "compare_previous", "compare_delta", "derived_points_day", "source_election", "manual_overlay", "unmapped_route", "sleep_nights", "sleep_summary"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1, name
        raw = plan[plan.index("FileScan parquet") - 1500 :]
        assert "SortAggregate" not in raw.split("Exchange")[-1], name
    # Measurements once, and each other table as often as it is needed: states; other families; profiles and, for windows and for what is shown, phases twice.
    for name, scans in {"series_routed": 2, "summary_figures": 2, "ledger": 4, "history_band": 2, "adherence_phase": 4, "plan": 4}.items():
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == scans, (name, plan.count("FileScan parquet"))


def phased(spark, rows):
    return spark.createDataFrame(rows, "account_id bigint, id bigint, rate_pct_per_week double, started_at timestamp_ntz, ended_at timestamp_ntz")


def daily_of(metric, days, value, account=1, source="Scale"):
    return [(metric, value(k), f"01-{k + 1:02d}T08:00", source, account) for k in range(days)]


def test_adherence_over_windows_of_accounts_own(spark):
    """Three accounts in one plan: twenty days of a phase, one that opens now, and one whose readings before the phase don't count, nor does a source elected outside."""
    now = datetime(2024, 1, 21)
    rows = [*daily_of("dietary_energy", 20, lambda k: 2100), *daily_of("dietary_protein", 20, lambda k: 118), *daily_of("body_mass", 20, lambda k: 92 - 1.2 * k / 19), *daily_of("dietary_energy", 20, lambda k: 2100, 2)]
    rows += [("dietary_energy", 9000, "01-09T08:00", "A", 3), ("dietary_energy", 1000, "01-10T11:00", "A", 3), ("dietary_energy", 1500, "01-10T13:00", "B", 3), ("dietary_energy", 1700, "01-12T13:00", "B", 3)]
    rows += [("dietary_protein", 80, "01-11T08:00", "A", 3), ("dietary_protein", 90, "01-11T09:00", "Manual", 3)]
    phases = phased(spark, [(1, 1, -0.5, datetime(2024, 1, 1), None), (1, 9, 0.1, datetime(2023, 1, 1), datetime(2024, 1, 1)), (2, 2, -0.5, now, None), (3, 3, 0.2, datetime(2024, 1, 10, 12), None), (3, 4, 0.9, datetime(2023, 12, 1), None), (4, 5, 0.0, datetime(2024, 1, 5), None)])
    own = estimates.own_windows(phases, now)
    figures = estimates.phase_figures(measured(spark, rows), catalog.rules(spark), own)
    planned = spark.createDataFrame([(k, 2500.0, 133.0) for k in (1, 2, 3)], "account_id bigint, kcal double, protein double")
    found = {r["account_id"]: r for r in estimates.adherence_of(own, figures, planned).collect()}
    one = found[1]
    assert (one["days"], one["thin"], one["intake"], one["protein"], one["target_protein"]) == (20, False, 2100, 118, 133) and one["rate"] < 0
    assert (found[2]["days"], found[2]["thin"], found[2]["intake"], found[2]["rate"]) == (1, True, None, None)
    assert (found[3]["days"], found[3]["thin"], found[3]["intake"], found[3]["protein"], found[3]["target_rate"]) == (11, True, 1600, 90, 0.2)
    assert (found[4]["days"], found[4]["intake"], found[4]["target_kcal"]) == (16, None, None)


def test_many_windows_are_joined_by_key_and_salt(spark, monkeypatch):
    from tidemark.operators import resolve as r

    rows = [*daily_of("dietary_energy", 20, lambda k: 2000 + k), *daily_of("dietary_energy", 20, lambda k: 1000 + k, 2)]
    own = estimates.own_windows(phased(spark, [(1, 1, 0.0, datetime(2024, 1, 5), None), (2, 2, 0.0, datetime(2024, 1, 9, 12), None)]), datetime(2024, 1, 21))
    read = lambda: sorted(map(str, estimates.phase_figures(measured(spark, rows), catalog.rules(spark), own).collect()))
    few = read()
    monkeypatch.setattr(r, "BROADCAST_ROWS", 1)
    assert read() == few and len(few) == 2


def plan_of(spark, rows, profile, phases=(), now=datetime(2024, 1, 29), **more):
    people = spark.createDataFrame(profile, "account_id bigint, born date, sex string, trust string")
    found = estimates.plan(measured(spark, rows), people, phased(spark, list(phases)), catalog.rules(spark), catalog.formula_terms(spark), now, **more)
    return {r["account_id"]: r for r in found.collect()}


def test_plan_is_one_read(spark):
    """Observed expenditure and targets; the rate of an open phase before the measured one; an empty account; one by recorded and one by predicted expenditure."""
    rows = [*daily_of("dietary_energy", 28, lambda k: 2078), *daily_of("dietary_protein", 28, lambda k: 100), *daily_of("body_mass", 28, lambda k: 92.75 - 1.75 * k / 27), ("height", 184, "01-02"), ("lean_body_mass", 66.4, "01-03")]
    rows += [("active_energy", 500, "01-10T08:00", WATCH, 3), ("basal_energy", 1700, "01-10T09:00", WATCH, 3), ("active_energy", 900, "01-11T08:00", WATCH, 3)]
    rows += [("body_mass", 80, "01-20", "Scale", 4), ("height", 180, "01-02", "Scale", 4)]
    born = date(1994, 1, 29)
    people = [(1, born, "male", None), (2, born, "male", None), (3, born, None, None), (4, born, "female", None)]
    found = plan_of(spark, rows, people)
    one = found[1]
    assert one["basis"] == "observed" and one["expenditure"] == pytest.approx(2577, abs=15)
    assert (one["trust"], one["equation"], one["phase_id"], one["days"], one["lean_mass_derived"]) == ("estimated", "mifflin_st_jeor", None, None, False)
    assert one["rate"] == one["actual_rate"] < 0 and one["kcal"] == pytest.approx(one["expenditure"] + one["rate"] / 100 * one["mass"] * 1100) and one["warnings"] == []
    empty = found[2]
    assert empty["expenditure"] is None and empty["rate"] is None and empty["kcal"] is None and empty["carbs"] is None and empty["trust"] == "unknown"
    assert (found[3]["basis"], found[3]["expenditure"], found[3]["rate"], found[3]["kcal"]) == ("recorded", 2200, 0, None)
    assert (found[4]["basis"], found[4]["equation"]) == ("predicted", "mifflin_st_jeor") and found[4]["expenditure"] == pytest.approx(1.375 * (800 + 1125 - 5 * 30 - 161), abs=1)
    committed = plan_of(spark, rows, people, [(1, 7, -0.5, datetime(2024, 1, 9), None), (4, 8, -2.5, datetime(2024, 2, 1), None)])
    assert (committed[1]["phase_id"], committed[1]["rate"], committed[1]["days"], committed[1]["thin"], committed[1]["actual_protein"]) == (7, -0.5, 20, False, 100)
    assert committed[1]["protein"] == pytest.approx(2.0 * 66.4) and committed[1]["warnings"] == ["protein_under_floor"]
    assert (committed[4]["days"], committed[4]["actual_kcal"], committed[4]["rate"]) == (1, None, -2.5) and {"below_basal", "rate_too_fast"} <= {*committed[4]["warnings"]}
    assert plan_of(spark, rows, people, preview_rate=0.25)[1]["rate"] == 0.25
    measured_trust = plan_of(spark, rows, [(1, None, None, "measured")])[1]
    assert measured_trust["equation"] == "katch_mcardle" and measured_trust["basal_kcal"] == pytest.approx(370 + 21.6 * 66.4)


def test_trust_follows_any_manual_row(spark):
    """An old manual lean mass below a daily scale, or manual body fat beside a scale's lean mass: typed in, so measured."""
    scale = [("lean_body_mass", 60, f"01-{k:02d}T08:00", "Scale") for k in range(2, 29)]
    source = lambda rows: estimates.resolve_inputs(measured(spark, rows), catalog.rules(spark), datetime(2024, 2, 1)).first()["lean_source"]
    assert source(scale) == "Scale"
    assert source([("lean_body_mass", 61, "01-01T08:00", "Manual"), *scale]) == "Manual"
    assert source([("body_fat_percentage", 0.2, "01-01T08:00", "Manual"), *scale]) == "Manual"
    assert source([("body_fat_percentage", 0.2, "01-01T08:00", "Scale")]) == "Scale"


def test_history_band_phases_and_gaps(spark):
    """Two clusters a fortnight apart; phases on the drawn grid; a span that another family began."""
    mass = [("body_mass", 80, f"01-{d:02d}") for d in (1, 2, 3, 14, 15)]
    rules = catalog.rules(spark)
    band = compare.history_band(measured(spark, mass), rules)
    rows = sorted(band.collect(), key=lambda r: r["bucket"])
    assert len(rows) == 15 and {r["grain"] for r in rows} == {"day"} and sum(r["gap"] for r in rows) == 10
    assert [(str(r["first"]), str(r["last"]), r["buckets"]) for r in compare.gap_runs(band).collect()] == [("2024-01-04", "2024-01-13", 10)]
    every = measured(spark, [("body_mass", 80, f"01-{d:02d}") for d in range(1, 29)])
    kind = "account_id bigint, id bigint, rate_pct_per_week double, started_on date, ended_on date"
    phases = spark.createDataFrame([(1, 1, -0.5, date(2024, 1, 10), None), (1, 2, 0.2, date(2023, 12, 1), date(2023, 12, 31)), (1, 3, 0.0, date(2024, 1, 9), date(2024, 1, 3))], kind)
    (only,) = compare.history_phases(phases, compare.history_extent(every)).collect()
    assert (only["id"], only["kind"], only["rate_pct_per_week"], str(only["from_bucket"]), str(only["to_bucket"]), only["ended_on"]) == (1, "cut", -0.5, "2024-01-10", "2024-01-28", None)
    # A body mass half a year before ten days of steps: weeks from its first row on, with gaps.
    early = measured(spark, [("body_mass", 80, "01-10"), *[("steps", 5, f"07-{d:02d}") for d in range(10, 20)]])
    steps = [r for r in compare.history_band(early, rules).collect() if r["metric"] == "steps"]
    assert {r["grain"] for r in steps} == {"week"} and min(str(r["bucket"]) for r in steps) == "2024-01-08" and sum(not r["gap"] for r in steps) == 2
    other = spark.createDataFrame([(1, datetime(2022, 1, 1))], "account_id bigint, start_at timestamp_ntz")
    assert {r["grain"] for r in compare.history_band(early, rules, [other]).collect()} == {"month"}
    # A phase that ended in the first bucket before the first row is drawn there.
    met = spark.createDataFrame([(1, 4, 0.3, date(2024, 1, 1), date(2024, 1, 8))], kind)
    (only,) = compare.history_phases(met, compare.history_extent(early)).collect()
    assert (str(only["from_bucket"]), str(only["to_bucket"]), only["kind"]) == ("2024-01-08", "2024-01-08", "bulk")
    ages = spark.createDataFrame([(1, datetime(1900, 1, 1))], "account_id bigint, start_at timestamp_ntz")
    assert {(r["metric"], r["bucket"]) for r in compare.history_band(early, rules, [ages]).collect()} == {("steps", None), ("body_mass", None)}


def test_histories_are_dealt_to_tasks_by_their_rows(spark, monkeypatch):
    """Many accounts' histories go to more tasks than shuffles have by default, with the same rows."""
    day = F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 7 * 3).cast("int")).cast("timestamp_ntz")
    many = spark.range(2000).select("id", F.floor(F.col("id") / 7).alias("account_id"), F.lit("steps").alias("metric"), F.col("id").cast("double").alias("value"), day.alias("start_at"), F.lit(WATCH).alias("source"))
    drawn = lambda: compare.history_band(many, catalog.rules(spark), [many])
    plain = sorted(map(tuple, drawn().collect()), key=str)
    monkeypatch.setattr(compare, "ROWS_A_TASK", 100)
    assert drawn().select(F.spark_partition_id()).distinct().count() > 10
    assert sorted(map(tuple, drawn().collect()), key=str) == plain


def test_direction_follows_what_is_shown(spark):
    rows = spark.createDataFrame([(100.3, 100.0, False), (100.6, 100.0, False), (99.0, 100.0, False), (0.04, 0.0, False), (0.05, 0.0, False), (-0.3, -0.1, True), (5.0, None, False)], "v double, b double, s boolean")
    assert [r["d"] for r in rows.select(compare.direction(F.col("v"), F.col("b"), F.col("s")).alias("d")).collect()] == [0, 1, -1, 0, 1, -1, None]


def test_pins_take_places_among_known_ones(spark):
    pinned = ["nothing", "steps", "sleep", "sleepless", "protein_per_kg", *(f"m{k}" for k in range(5)), "body_mass"]
    pins = spark.createDataFrame([(1, k, m) for k, m in enumerate(pinned)], "account_id bigint, position int, metric string")
    known = spark.createDataFrame([(m,) for m in pinned if m not in ("nothing", "sleepless")], "slug string")
    points = spark.createDataFrame([(1, "steps"), (1, "protein_per_kg"), (1, "body_mass"), (2, "sleep")], "account_id bigint, metric string")
    found = {r["metric"]: (r["place"], r["skipped"]) for r in covary.inputs(pins, known, points).collect()}
    assert found["nothing"] == (None, "not in the catalog") and found["steps"] == (1, None) and found["sleep"] == (2, "no data in this window")
    assert found["protein_per_kg"] == (3, None) and found["m4"][0] == 8 and found["body_mass"] == (9, "beyond the 8 compared")


def test_notes_onto_an_accounts_own_axis(spark):
    d = lambda k: date(2024, 1, k)
    axis = spark.createDataFrame([(1, d(3)), (1, d(10)), (1, d(20)), (2, d(1))], "account_id bigint, bucket date")
    spans = [(1, 1, d(3), d(3)), (1, 2, d(4), d(9)), (1, 3, d(1), d(15)), (1, 4, d(11), d(25)), (1, 5, d(21), d(22)), (2, 6, d(1), d(9)), (3, 7, d(1), d(2))]
    frame = spark.createDataFrame(spans, "account_id bigint, id bigint, first_bucket date, last_bucket date")
    placed = compare.onto_axis(frame, axis)
    found = {r["id"]: (r["from_bucket"].day, r["to_bucket"].day) for r in placed.collect()}
    assert found == {1: (3, 3), 2: (10, 10), 3: (3, 10), 4: (20, 20), 6: (1, 1)}
    assert {(r["account_id"], r["bucket"].day): r["marks"] for r in compare.axis_marks(placed).collect()} == {(1, 3): 2, (1, 10): 1, (1, 20): 1, (2, 1): 1}


def test_many_notes_onto_one_axis(spark):
    """Notes of one account by the thousand: no frame runs to the account's end from every row, and no window sees more rows than there are days."""
    d = lambda k: date(2024, 1, k)
    axis = spark.createDataFrame([(1, d(3)), (1, d(10)), (1, d(20))], "account_id bigint, bucket date")
    day = lambda k: F.date_add(F.lit(d(1)), (k % 25).cast("int"))
    many = spark.range(0, 100_000, 1, 4).select(F.lit(1).cast("bigint").alias("account_id"), "id", day(F.col("id")).alias("first_bucket"), F.date_add(day(F.col("id")), 3).alias("last_bucket"))
    placed = compare.onto_axis(many, axis)
    assert "UnboundedFollowing" not in (plan := placed._jdf.queryExecution().optimizedPlan().toString()) and "unboundedfollowing" not in plan
    expected = {3: 3 * 4000, 10: 7 * 4000, 20: 10 * 4000}
    assert {r["bucket"].day: r["marks"] for r in compare.axis_marks(placed).collect()} == expected
    assert {r["bucket"].day: r["marks"] for r in compare.axis_marks(compare.onto_axis(compare.alike(many), axis)).collect()} == expected
    assert {(r["from_bucket"].day, r["to_bucket"].day) for r in placed.filter("id % 25 = 7").collect()} == {(10, 10)}


def test_week_keys(spark):
    days = spark.createDataFrame([(date(2024, 12, 30),), (date(2021, 1, 3),), (date(2026, 8, 20),)], "d date")
    of = lambda b: [r["k"] for r in days.select(bucket_key(F.col("d"), b).alias("k")).collect()]
    assert of("week") == ["2025-W01", "2020-W53", "2026-W34"] and of("month") == ["2024-12", "2021-01", "2026-08"] and of("day")[0] == "2024-12-30"


def test_session_details_cursors_and_exclusion(spark):
    rows = [(k, 1, t, at(f"01-0{d}"), 60.0, None, 5.0) for k, (t, d) in enumerate([("running", 1), ("parkour", 2), ("yoga", 2), ("swimming", 3)])]
    s = spark.createDataFrame(rows, "id bigint, account_id bigint, activity_type string, start_at timestamp_ntz, duration double, total_distance double, total_energy double")
    full = sessions.page_with_next(s, size=2).collect()
    assert [r["id"] for r in full] == [3, 2] and full[0]["next_cursor"] is None
    assert [r["id"] for r in sessions.page(s, full[1]["next_cursor"], 2).collect()] == [1, 0]
    assert {r["next_cursor"] for r in sessions.page_with_next(s, size=5).collect()} == {None}
    assert {r["id"] for r in s.filter(sessions.of_groups(excluded=["yoga", "parkour"])).collect()} == {0, 3}
    assert {r["id"] for r in s.filter(sessions.of_groups(["cardio"], excluded=["running"])).collect()} == {3} - ({3} if "swimming" not in catalog.GROUPS["cardio"].split() else set())
    stats = spark.createDataFrame([(2, "heart_rate", "max", 150.0), (2, "heart_rate", "average", 120.0)], "session_id bigint, metric string, stat string, value double")
    drawn = spark.createDataFrame([(8, 1, 2, "b.gpx", at("01-02T13:00")), (7, 1, 2, "a.gpx", at("01-02T12:00")), (9, 2, 2, "c.gpx", at("01-02T11:00"))], "id bigint, account_id bigint, session_id bigint, artifact string, start_at timestamp_ntz")
    (one,) = sessions.detail(s, stats, drawn, 1, 2).collect()
    assert [tuple(x) for x in one["stats"]] == [("heart_rate", "average", 120.0), ("heart_rate", "max", 150.0)] and [x["artifact"] for x in one["routes"]] == ["a.gpx", "b.gpx"]
    assert sessions.detail(s, stats, drawn, 2, 2).count() == 0
    assert {r["id"]: (len(r["stats"]), len(r["routes"])) for r in sessions.detail(s, stats, drawn).collect()} == {0: (0, 0), 1: (0, 0), 2: (2, 2), 3: (0, 0)}


def test_probes(spark):
    frame = lambda *ids: spark.createDataFrame([(k,) for k in ids], "account_id bigint")
    assert {r["account_id"]: r["has_any"] for r in has_rows(frame(1, 2, 3), frame(1, 1), frame(3, 9)).collect()} == {1: True, 2: False, 3: True}


def test_figures_as_they_are_read(spark):
    rows = spark.createDataFrame([(432.0, 3840.0, 10.0), (47.4, 2880.0, 28.44), (-61.0, 29.6, 0.0), (0.0, 3600.0, 12.0), (None, None, None)], "m double, s double, v double")
    of = lambda c: [r["x"] for r in rows.select(c.alias("x")).collect()]
    assert of(formatting.duration(F.col("m"))) == ["7h 12m", "47m", "-1h 1m", "0m", None]
    assert of(formatting.session_duration(F.col("s"))) == ["1h 04m", "48m", "30s", "1h 00m", None]
    assert of(formatting.pace(F.col("v"))) == ["6:00/km", "2:07/km", "\u2014", "5:00/km", "\u2014"]
    assert of(formatting.speed(F.col("v"))) == ["10 km/h", "28,4 km/h", "0 km/h", "12 km/h", "\u2014"]


def test_latest_value(spark):
    rows = [("steps", 5, "01-03T08:00"), ("steps", 7, "01-03T09:00"), ("steps", 9, "02-03")]
    (r,) = series.latest_value(measured(spark, rows), JAN).collect()
    assert (r["value"], str(r["bucket"])) == (7, "2024-01-03")


def test_history_events(spark):
    """Each kind once, with what it carries; of one day imports come before phases."""
    imports = spark.createDataFrame([(1, "export.zip", datetime(2024, 3, 1, 9), 412, 9, 14)], "account_id bigint, source_file string, imported_at timestamp_ntz, added_count bigint, skipped_count bigint, unmapped_count bigint")
    phases = spark.createDataFrame([(1, date(2024, 3, 1), None, 0.25)], "account_id bigint, started_at date, ended_at date, rate_pct_per_week double")
    notes = spark.createDataFrame([(1, date(2024, 1, 15), None, "Flu", None)], "account_id bigint, starts_on date, ends_on date, label string, body string")
    rows = measured(spark, [("body_mass", 80, "01-01", "Scale"), ("body_mass", 80, "02-01", "Scale")])
    spans = compare.source_spans(rows, slept(spark, [("asleep", "01-02T00:00", "01-02T06:00", WATCH)]))
    unmapped = spark.createDataFrame([(1, 3), (2, 0)], "account_id bigint, n bigint")
    found = [r.asDict() for r in compare.history_events(imports, phases, notes, spans, unmapped).orderBy(F.desc("day"), "kind_rank", "label").collect()]
    shown = [{k: v for k, v in r.items() if v is not None and k not in ("account_id", "kind_rank")} for r in found]
    assert shown == [
        {"day": date(2024, 3, 1), "kind": "import", "label": "export.zip", "added": 412, "skipped": 9, "unmapped": 14},
        {"day": date(2024, 3, 1), "kind": "phase", "label": "bulk", "rate": 0.25},
        {"day": date(2024, 1, 15), "kind": "note", "label": "Flu", "body": ""},
        {"day": date(2024, 1, 2), "kind": "source", "label": WATCH, "rows": 1},
        {"day": date(2024, 1, 1), "kind": "source", "label": "Scale", "rows": 2},
        {"day": date(2024, 1, 1), "kind": "origin", "label": "", "unmapped": 3},
    ]
    assert compare.history_events(imports, phases, notes, spans).filter("kind = 'origin'").first()["unmapped"] is None


def test_panels_and_pins(spark):
    known = panels.charts(spark)
    members = [(1, 1, 2, "steps", None), (1, 1, 1, "heart_rate", "line"), (1, 2, 1, "steps", "band"), (1, 3, 1, "nothing", None), (1, 4, 1, "sleep", None), (1, 4, 2, "calorie_balance", None), (1, 4, 3, "body_mass", None)]
    members += [(1, 5, k, m, None) for k, m in enumerate(("steps", "flights_climbed", "active_energy", "basal_energy", "dietary_energy"))]
    rows = spark.createDataFrame(members, "account_id bigint, panel_id bigint, position int, metric string, chart string")
    found = {r["panel_id"]: r["problems"] for r in panels.problems(rows, known).collect()}
    assert found == {1: [], 2: ["chart doesn't fit"], 3: ["unknown metric"], 4: ["too many units"], 5: ["too many metrics"]}
    drawn = {r["panel_id"]: [(x["metric"], x["chart"]) for x in r["metrics"]] for r in panels.assemble(rows, known).collect()}
    assert drawn[1] == [("heart_rate", "line"), ("steps", "bar")] and drawn[4] == [("sleep", "stacked_bar"), ("calorie_balance", "diverging_bar"), ("body_mass", "line")]
    points = spark.createDataFrame([(1, "steps", date(2024, 1, 1), 5.0)], "account_id bigint, metric string, bucket date, value double")
    assert {(r["metric"], r["value"]) for r in panels.drawn(rows, known, points).filter("panel_id = 1").collect()} == {("steps", 5.0), ("heart_rate", None)}
    pins = spark.createDataFrame([(1, "steps", 0), (1, "sleep", 4)], "account_id bigint, metric string, position int")
    new = spark.createDataFrame([(1, "body_mass", 2), (1, "steps", 0), (1, "heart_rate", 1), (1, "body_mass", 0), (2, "steps", 5)], "account_id bigint, metric string, seq int")
    assert {(r["account_id"], r["metric"]): r["position"] for r in panels.add_pins(pins, new).collect()} == {(1, "steps"): 0, (1, "sleep"): 4, (1, "body_mass"): 5, (1, "heart_rate"): 6, (2, "steps"): 0}
