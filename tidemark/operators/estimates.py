"""Estimates and planning: energy expenditure, targets, adherence and guardrails, as expressions over one row of inputs per account."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.resolve import resolved_days
from tidemark.operators.series import by_rule, evaluate, points
from tidemark.plans.timeaxis import Window

# Published constants.
KCAL_PER_KG, ACTIVITY_FACTOR = 7700.0, 1.375
WINDOW_DAYS, LEAST_INTAKE_SHARE, LEAST_MASS_DAYS = 28, 0.7, 10
PROTEIN_FLOOR, PROTEIN_TOP, FAT_PER_KG, FAT_SHARE = 1.6, 2.4, 0.6, 0.2
LOOKBACK_YEARS = 30
BODY = ("body_mass", "height", "lean_body_mass", "body_fat_percentage")
THIN_DAYS, LEAST_RATE_DAYS, MOST_RATE = 14, 2, 1.0
NEEDS = {"katch_mcardle": ("lean_mass",), "cunningham": ("lean_mass",), "mifflin_st_jeor": ("mass", "height", "age", "sex"), "harris_benedict": ("mass", "height", "age", "sex")}


def c(name: str) -> Column:
    return F.col(name)


def age(born: Column, today: Column) -> Column:
    return F.datediff(today, born) / 365.25


def basal(equation: str) -> Column:
    """Kilocalories a day from mass (kg), height (cm), age, sex and lean_mass (kg); null where an input is missing."""
    male = c("sex") == "male"
    return {
        "katch_mcardle": 370 + 21.6 * c("lean_mass"),
        "cunningham": 500 + 22 * c("lean_mass"),
        "mifflin_st_jeor": 10 * c("mass") + 6.25 * c("height") - 5 * c("age") + F.when(male, 5).when(c("sex") == "female", -161),
        "harris_benedict": F.when(male, 88.362 + 13.397 * c("mass") + 4.799 * c("height") - 5.677 * c("age")).when(c("sex") == "female", 447.593 + 9.247 * c("mass") + 3.098 * c("height") - 4.330 * c("age")),
    }[equation]


def missing(equation: str) -> Column:
    """Names of the inputs that the equation lacks."""
    return F.array_compact(F.array(*(F.when(c(n).isNull(), F.lit(n)) for n in NEEDS[equation])))


def basal_estimates(inputs: DataFrame) -> DataFrame:
    """(account_id, equation, kcal, missing), one row per account and equation."""
    rows = [F.struct(F.lit(e).alias("equation"), basal(e).alias("kcal"), missing(e).alias("missing")) for e in NEEDS]
    return inputs.select("account_id", F.explode(F.array(*rows)).alias("e")).select("account_id", "e.*")


def lean_mass() -> Column:
    """Measured lean mass, else mass without its fat (a fraction)."""
    return F.coalesce(c("lean_body_mass"), c("mass") * (1 - c("body_fat_percentage")))


#: What daily_columns says of a window.
DAILY = ("intake", "intake_days", "mass", "mass_days", "mass_slope", "recorded", "protein_eaten")


def daily_columns(origin, inside: Column | None = None) -> list[Column]:
    """Aggregates over an account's day points (metric, bucket, value) of dietary_energy, dietary_protein, body_mass and total_energy_expenditure, in the order of DAILY: means, counts,
    and the slope of mass per day. inside: which points count."""
    wanted = lambda m: c("metric") == m if inside is None else (c("metric") == m) & inside
    of = lambda m, x=None: F.when(wanted(m), c("value") if x is None else x)
    day = F.datediff(c("bucket"), F.lit(origin)).cast("double")
    slope = F.when(F.count(of("body_mass")) >= 2, F.regr_slope(of("body_mass"), of("body_mass", day)))
    return [F.avg(of("dietary_energy")), F.count(of("dietary_energy")), F.avg(of("body_mass")), F.count(of("body_mass")), slope, F.avg(of("total_energy_expenditure")), F.avg(of("dietary_protein"))]


def daily_inputs(points: DataFrame, origin) -> DataFrame:
    """One row per account with the columns of DAILY, from its day points. One pass, whatever the number of metrics."""
    return points.groupBy("account_id").agg(*(x.alias(n) for x, n in zip(daily_columns(origin), DAILY, strict=True)))


def observed(of: str = "") -> Column:
    enough = (c(f"{of}intake_days") / WINDOW_DAYS >= LEAST_INTAKE_SHARE) & (c(f"{of}mass_days") >= LEAST_MASS_DAYS)
    return F.when(enough, c(f"{of}intake") - c(f"{of}mass_slope") * KCAL_PER_KG)


def best_expenditure(of: str = "") -> Column:
    ways = (("observed", observed(of)), ("recorded", c(f"{of}recorded")), ("predicted", c("basal_kcal") * ACTIVITY_FACTOR))
    return F.coalesce(*(F.when(v.isNotNull(), F.struct(v.alias("kcal"), F.lit(n).alias("basis"))) for n, v in ways))


def expenditure(inputs: DataFrame) -> DataFrame:
    """(account_id, kcal, basis): observed from intake and mass, else recorded, else predicted from basal_kcal, else null."""
    return inputs.select("account_id", best_expenditure().alias("e")).select("account_id", "e.kcal", "e.basis")


def actual_rate(least: int = LEAST_MASS_DAYS, of: str = "") -> Column:
    """Per cent of body mass a week; null under least days of mass. of: a prefix of the inputs' names."""
    return F.when(c(f"{of}mass_days") >= least, c(f"{of}mass_slope") * 7 / F.nullif(c(f"{of}mass"), F.lit(0.0)) * 100)


def protein_per_kg(rate: Column) -> Column:
    """From the floor at no deficit up to the top at one per cent a week, and no further."""
    return PROTEIN_FLOOR + (PROTEIN_TOP - PROTEIN_FLOOR) * F.least(F.greatest(-rate, F.lit(0.0)), F.lit(1.0))


def targets(inputs: DataFrame) -> DataFrame:
    """inputs (account_id, expenditure, rate, mass, lean_mass) with kcal, protein, fat and carbs in grams; nothing without mass or expenditure."""
    kcal = c("expenditure") + c("rate") / 100 * c("mass") * KCAL_PER_KG / 7
    out = inputs.withColumn("kcal", kcal).withColumn("protein", F.when(c("kcal").isNotNull(), protein_per_kg(c("rate")) * F.coalesce("lean_mass", "mass")))
    out = out.withColumn("fat", F.when(c("kcal").isNotNull(), F.greatest(FAT_PER_KG * c("mass"), FAT_SHARE * c("kcal") / 9)))
    return out.withColumn("carbs", F.when(c("kcal").isNotNull(), F.greatest(F.lit(0.0), (c("kcal") - 4 * c("protein") - 9 * c("fat")) / 4)))


def warnings() -> Column:
    """What is worth a warning about targets with basal_kcal and actual_protein, the mean that was eaten in the phase (null if there is none)."""
    rules = {
        "below_basal": c("kcal") < c("basal_kcal"),
        "rate_too_fast": F.abs("rate") > MOST_RATE,
        "no_carbs": c("carbs") == 0,
        "protein_under_floor": (c("rate") < 0) & (c("actual_protein") < c("protein")),
    }
    return F.array_compact(F.array(*(F.when(v, F.lit(n)) for n, v in rules.items())))


def guardrails(planned: DataFrame) -> DataFrame:
    """(account_id, warnings)."""
    return planned.select("account_id", warnings().alias("warnings"))


def phase_days() -> Column:
    """The days of a phase so far: one at least."""
    return F.greatest(F.lit(1), F.round("elapsed").cast("int"))


def begun(x: Column) -> Column:
    """x, for a phase that has begun."""
    return F.when(c("elapsed") > 0, x)


def adherence(inputs: DataFrame) -> DataFrame:
    """inputs (account_id, elapsed days of the phase so far, target_rate, kcal and protein as planned, intake and protein_eaten, mass, mass_slope, mass_days)
    -> (account_id, days, thin, target and actual figures). A phase has at least one day; one that hasn't begun has no actual figures, and every
    account has its row."""
    days = phase_days()
    return inputs.select(
        "account_id", days.alias("days"), (days < THIN_DAYS).alias("thin"), c("target_rate"), begun(actual_rate(LEAST_RATE_DAYS)).alias("rate"),
        c("kcal").alias("target_kcal"), begun(c("intake")).alias("intake"), c("protein").alias("target_protein"), begun(c("protein_eaten")).alias("protein"),
    )


def planned_rate() -> Column:
    """A preview's rate, else the open phase's, else the actual one, else 0."""
    return F.coalesce(c("preview_rate"), c("phase_rate"), c("actual_rate"), F.lit(0.0))


def derived_trust(lean_mass_source: Column) -> Column:
    """What an account's body composition is worth if it doesn't say so itself: typed in, it is measured; from a device, estimated."""
    return F.when(lean_mass_source == "Manual", "measured").when(F.coalesce(lean_mass_source, F.lit("")) == "", "unknown").otherwise("estimated")


def preselect(trust: Column) -> Column:
    """The equation to begin with: the first that can be computed, those by lean mass first only where the composition is measured; null if none can.
    To be used on rows of inputs."""
    lean, body = ("katch_mcardle", "cunningham"), ("mifflin_st_jeor", "harris_benedict")
    first = lambda names: F.coalesce(*(F.when(basal(n).isNotNull(), n) for n in names))
    return F.when(trust == "measured", first(lean + body)).otherwise(first(body + lean))


LEAN = ("lean_body_mass", "body_fat_percentage")


def _ago(now: datetime) -> list[Window]:
    """The recent window, and the one that stands for ever."""
    return [Window(now - timedelta(days=WINDOW_DAYS), now), Window(datetime(now.year - LOOKBACK_YEARS, now.month, min(now.day, 28), now.hour, now.minute), now)]


def input_columns() -> list[Column]:
    """Aggregates over an account's resolved rows (metric, w, total, k, latest, latest_at, winner, manual) of the windows of _ago; see inputs_of."""
    recent, ever = c("w") == 0, c("w") == 1
    of = lambda m, w, x: F.when((c("metric") == m) & w, c(x))
    mean = lambda m: F.sum(of(m, recent, "total")) / F.nullif(F.sum(of(m, recent, "k")), F.lit(0))
    last = lambda m: F.max_by("latest", of(m, ever, "latest_at"))
    manual = F.max(c("metric").isin(*LEAN) & c("manual")).alias("_manual")
    bodies = [F.coalesce(mean(m), last(m)).alias(n) for m, n in (("body_mass", "mass"), ("lean_body_mass", "lean_body_mass"), ("body_fat_percentage", "body_fat_percentage"))]
    return [*bodies, last("height").alias("height"), manual, *(F.max(of(m, ever, "winner")).alias(f"_{m}_source") for m in LEAN)]


def with_inputs(rows: DataFrame) -> DataFrame:
    """Rows of input_columns with lean_mass, lean_mass_derived and lean_source."""
    source = F.when(c("_manual"), "Manual").otherwise(F.coalesce(*(f"_{m}_source" for m in LEAN)))
    return rows.withColumns({"lean_mass": lean_mass(), "lean_mass_derived": c("lean_body_mass").isNull() & lean_mass().isNotNull(), "lean_source": source})


def inputs_of(days: DataFrame) -> DataFrame:
    """(account_id, mass, height, lean_mass, lean_mass_derived, lean_source) of resolved days of the windows of _ago: mass, lean mass and body fat as means of the
    last WINDOW_DAYS, or the latest value ever (LOOKBACK_YEARS) where there is none; height as the latest ever; lean mass as measured, else mass without its
    fat. lean_source is Manual once a manual row of either composition metric was stored, whatever is newest and whatever source a series is named after;
    else the elected source of lean mass, else that of body fat."""
    found = days.filter(c("metric").isin(*BODY)).withColumn("manual", c("source") == "Manual").groupBy("account_id").agg(*input_columns())
    return with_inputs(found).select("account_id", "mass", "height", "lean_mass", "lean_mass_derived", "lean_source")


def resolve_inputs(measurements: DataFrame, rules: DataFrame, now, priority: dict | None = None) -> DataFrame:
    """inputs_of the rows up to now. One scan."""
    return inputs_of(resolved_days(measurements.filter(c("metric").isin(*BODY)), rules, _ago(now), priority))


def own_windows(phases: DataFrame, now) -> DataFrame:
    """(account_id, phase_id, target_rate, started_at, own_start, own_end, elapsed): each account's open phase, the last one opened, as a window up to now; elapsed in days.
    A phase that hasn't begun has an empty window. phases: (account_id, id, rate_pct_per_week, started_at, ended_at)."""
    opened = phases.filter(c("ended_at").isNull() & c("account_id").isNotNull())
    last = opened.groupBy("account_id").agg(F.max_by(F.struct("id", "rate_pct_per_week", "started_at"), F.struct("started_at", "id")).alias("p"))
    end = F.lit(str(now)).cast("timestamp_ntz")
    elapsed = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(c("p.started_at").cast("timestamp"))) / F.lit(86_400e6)
    return last.select("account_id", c("p.id").alias("phase_id"), c("p.rate_pct_per_week").alias("target_rate"), c("p.started_at").alias("started_at"), c("p.started_at").alias("own_start"), F.greatest(end, c("p.started_at")).alias("own_end"), elapsed.alias("elapsed"))


EATEN = ("dietary_energy", "dietary_protein", "body_mass")


def phase_figures(measurements: DataFrame, rules: DataFrame, own: DataFrame, priority: dict | None = None) -> DataFrame:
    """daily_inputs of each account over its own window: election and overlay are decided inside it. Accounts with differing windows are one plan, one scan."""
    days = resolved_days(measurements.filter(c("metric").isin(*EATEN)), rules, [], priority, own.select("account_id", "own_start", "own_end"))
    return daily_inputs(points(days, "day"), datetime(2000, 1, 1).date())


def adherence_of(phases: DataFrame, figures: DataFrame, planned: DataFrame) -> DataFrame:
    """adherence of each account with an open phase: phases as own_windows says, figures as phase_figures says, planned: (account_id, kcal, protein)."""
    return adherence(phases.join(planned, "account_id", "left").join(figures, "account_id", "left"))


def plan(measurements: DataFrame, profile: DataFrame, phases: DataFrame, rules: DataFrame, terms: DataFrame, now, preview_rate: float | None = None, priority: dict | None = None) -> DataFrame:
    """One row an account: inputs, the equation to begin with and its basal_kcal, expenditure and basis, actual_rate, the open phase, the rate in force and the targets for it,
    adherence, and warnings. profile: (account_id, born, sex, trust): trust is null where the account declares none; every account of it has its row.
    An account without any basis has no expenditure and nothing that follows from it; one without mass no targets; one without an open phase no adherence. All
    of it comes from one scan of the measurements: the recent window, the long one and each account's own are resolved side by side."""
    own = own_windows(phases, now)
    wanted = {*BODY, *EATEN, "active_energy", "basal_energy"}
    days = resolved_days(measurements.filter(c("metric").isin(*wanted)), rules, _ago(now), priority, own.select("account_id", "own_start", "own_end"))
    # Days of each metric and window, then the formulas beside them, then one row an account: one chain of aggregations.
    carried = ("total", "k", "latest", "latest_at", "winner", "manual")
    summed = [F.sum("total").alias("total"), F.sum("k").alias("k"), F.max_by("latest", "latest_at").alias("latest"), F.max("latest_at").alias("latest_at"), F.max("winner").alias("winner"), F.max(c("source") == "Manual").alias("manual")]
    by_day = days.groupBy("account_id", "metric", "rule", "w", c("day").alias("bucket")).agg(by_rule().alias("value"), *summed)
    found = evaluate(by_day, terms, ["account_id", "w", "bucket"], with_operands=True, carried=carried)
    origin = datetime(2000, 1, 1).date()
    figures = [x.alias(f"{of}_{n}") for of, w in (("recent", 0), ("own", 2)) for x, n in zip(daily_columns(origin, c("w") == w), DAILY, strict=True)]
    read = with_inputs(found.groupBy("account_id").agg(*input_columns(), *figures))
    rows = profile.join(read, "account_id", "left").join(own, "account_id", "left")
    rows = rows.withColumns({"age": age(c("born"), F.lit(now.date())), "trust": F.coalesce("trust", derived_trust(c("lean_source")))})
    rows = rows.withColumn("equation", preselect(c("trust")))
    rows = rows.withColumn("basal_kcal", F.coalesce(*(F.when(c("equation") == e, basal(e)) for e in NEEDS)))
    rows = rows.withColumn("_e", best_expenditure("recent_")).withColumns({"expenditure": c("_e.kcal"), "basis": c("_e.basis")})
    known = lambda x: F.when(c("expenditure").isNotNull(), x)
    rows = rows.withColumns({"actual_rate": known(actual_rate(of="recent_")), "preview_rate": F.lit(preview_rate).cast("double"), "phase_rate": c("target_rate"), "phase_id": known(c("phase_id"))})
    rows = targets(rows.withColumn("rate", known(planned_rate())))
    judged = lambda x: F.when(c("phase_id").isNotNull() & c("kcal").isNotNull(), x)
    rows = rows.withColumns(
        {"days": judged(phase_days()), "phase_actual_rate": judged(begun(actual_rate(LEAST_RATE_DAYS, "own_"))), "actual_kcal": judged(begun(c("own_intake"))), "actual_protein": judged(begun(c("own_protein_eaten")))}
    )
    shown = rows.withColumns({"thin": c("days") < THIN_DAYS, "warnings": F.when(c("kcal").isNotNull(), warnings())})
    return shown.select(
        "account_id", "mass", "height", "lean_mass", "lean_mass_derived", "trust", "equation", "basal_kcal", "expenditure", "basis", "actual_rate",
        "phase_id", "rate", "kcal", "protein", "fat", "carbs", "days", "thin", "phase_actual_rate", "actual_kcal", "actual_protein", "warnings",
    )
