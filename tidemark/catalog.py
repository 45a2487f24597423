"""The closed set of metrics, as data: unit, aggregation rule or formula, source priorities, and activities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SUM, AVERAGE, LATEST, STATES = "sum", "average", "latest", "duration_by_state"

# Imported metrics as "rule unit: slugs".
IMPORTED = """
sum kcal: active_energy basal_energy
latest kg: body_mass
latest count: body_mass_index
latest %: body_fat_percentage
latest kg: lean_body_mass
latest cm: height
sum count: steps
sum km: distance_walking_running distance_cycling
sum count: flights_climbed
average kcal/hr·kg: physical_effort
sum min: apple_exercise_time apple_stand_time time_in_daylight
average km/hr: walking_speed
average cm: walking_step_length
average %: walking_double_support_percentage walking_asymmetry_percentage walking_steadiness
average m/s: stair_ascent_speed stair_descent_speed
latest m: six_minute_walk_test_distance
average km/hr: running_speed
average W: running_power
average m: running_stride_length
average ms: running_ground_contact_time
average cm: running_vertical_oscillation
duration_by_state min: sleep
average count/min: heart_rate resting_heart_rate walking_heart_rate_average
average ms: heart_rate_variability_sdnn
average count/min: heart_rate_recovery_one_minute
average mL/min·kg: vo2_max
average count/min: respiratory_rate
average %: oxygen_saturation
average count: apple_sleeping_breathing_disturbances
average degC: apple_sleeping_wrist_temperature
average dBASPL: headphone_audio_exposure environmental_audio_exposure environmental_sound_reduction
sum kcal: dietary_energy
sum g: dietary_protein dietary_carbohydrates dietary_fat_total dietary_fat_saturated dietary_fat_monounsaturated dietary_fat_polyunsaturated dietary_fiber dietary_sugar
sum mg: dietary_cholesterol
sum mL: dietary_water
sum mg: dietary_sodium dietary_potassium dietary_calcium dietary_iron dietary_magnesium dietary_phosphorus dietary_zinc dietary_copper dietary_manganese
sum mcg: dietary_selenium dietary_iodine
sum mg: dietary_chloride
sum mcg: dietary_chromium dietary_molybdenum
sum mcg: dietary_vitamin_a
sum mg: dietary_vitamin_c
sum mcg: dietary_vitamin_d
sum mg: dietary_vitamin_e
sum mcg: dietary_vitamin_k
sum mg: dietary_thiamin dietary_riboflavin dietary_niacin dietary_vitamin_b6
sum mcg: dietary_vitamin_b12 dietary_folate
sum mg: dietary_pantothenic_acid
sum mcg: dietary_biotin
average mmHg: blood_pressure_systolic blood_pressure_diastolic
average mg/dL: blood_glucose
average degC: body_temperature basal_body_temperature
average %: peripheral_perfusion_index
average mcS: electrodermal_activity
average %: blood_alcohol_content
average L: forced_vital_capacity forced_expiratory_volume_1
average L/min: peak_expiratory_flow_rate
sum m: distance_swimming
sum count: swimming_stroke_count
sum km: distance_downhill_snow_sports distance_wheelchair
sum count: push_count
average count: uv_exposure
latest cm: waist_circumference
sum mg: dietary_caffeine
sum count: inhaler_usage number_of_times_fallen number_of_alcoholic_beverages
"""
# Patterns in the names of sources, the preferred one first.
PRIORITY = {m: ("watch", "iphone") for m in ("steps", "distance_walking_running", "flights_climbed", "sleep")}
# Vendor types whose names don't follow from the slug.
VENDOR_PREFIX = "HKQuantityTypeIdentifier"
VENDOR_NAMES = {
    "active_energy": "ActiveEnergyBurned", "basal_energy": "BasalEnergyBurned", "steps": "StepCount", "walking_steadiness": "AppleWalkingSteadiness",
    "heart_rate_variability_sdnn": "HeartRateVariabilitySDNN", "vo2_max": "VO2Max", "dietary_energy": "DietaryEnergyConsumed",
    "forced_expiratory_volume_1": "ForcedExpiratoryVolume1Second", "uv_exposure": "UVExposure",
}
# Activities by group; any other activity belongs to "other".
GROUPS = {
    "cardio": "running walking hiking cycling elliptical rowing stair_climbing stairs step_training high_intensity_interval_training mixed_cardio jump_rope cardio_dance dance social_dance wheelchair_walk_pace wheelchair_run_pace",
    "strength": "traditional_strength_training functional_strength_training core_training cross_training barre pilates yoga flexibility cooldown mind_and_body preparation_and_recovery",
    "water": "swimming water_fitness water_polo water_sports surfing_sports paddle_sports sailing",
    "winter": "downhill_skiing cross_country_skiing snowboarding snow_sports skating_sports hockey curling",
}
# How an activity's speed reads; none for all others.
READINGS = {
    "pace": "running walking hiking swimming",
    "speed": "cycling rowing wheelchair_walk_pace wheelchair_run_pace paddle_sports sailing downhill_skiing cross_country_skiing snowboarding snow_sports skating_sports",
}
# Labels that aren't the slug in title case.
LABELS = {
    "high_intensity_interval_training": "HIIT", "wheelchair_walk_pace": "Wheelchair (Walk Pace)", "wheelchair_run_pace": "Wheelchair (Run Pace)",
    "traditional_strength_training": "Strength Training", "functional_strength_training": "Functional Strength", "mind_and_body": "Mind and Body",
    "preparation_and_recovery": "Preparation and Recovery", "surfing_sports": "Surfing", "cross_country_skiing": "Cross-Country Skiing",
    "skating_sports": "Skating", "equestrian_sports": "Equestrian", "track_and_field": "Track and Field",
}


@dataclass(frozen=True)
class Formula:
    """scale x sum of weighted numerator metrics, over the sum of weighted denominator metrics (1 if there are none)."""

    numerator: tuple[tuple[float, str], ...]
    denominator: tuple[tuple[float, str], ...] = ()
    scale: float = 1.0

    def operands(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(m for _, m in (*self.numerator, *self.denominator)))


@dataclass(frozen=True)
class Metric:
    """An imported metric has a rule, a derived one a formula; signed ones may be negative."""

    slug: str
    unit: str
    rule: str | None = None
    formula: Formula | None = None
    signed: bool = False


def _imported() -> list[Metric]:
    rows = []
    for line in IMPORTED.strip().splitlines():
        head, slugs = line.split(": ")
        rule, unit = head.split(" ", 1)
        rows += [Metric(s, unit, rule) for s in slugs.split()]
    return rows


def _share(metric: str, kcal_per_gram: float) -> Formula:
    return Formula(((kcal_per_gram, metric),), ((1.0, "dietary_energy"),), 100.0)


DERIVED = (
    Metric("total_energy_expenditure", "kcal", formula=Formula(((1.0, "active_energy"), (1.0, "basal_energy")))),
    Metric("calorie_balance", "kcal", formula=Formula(((1.0, "dietary_energy"), (-1.0, "active_energy"), (-1.0, "basal_energy"))), signed=True),
    Metric("protein_per_kg", "g/kg", formula=Formula(((1.0, "dietary_protein"),), ((1.0, "body_mass"),))),
    Metric("protein_energy_share", "%", formula=_share("dietary_protein", 4.0)),
    Metric("carb_energy_share", "%", formula=_share("dietary_carbohydrates", 4.0)),
    Metric("fat_energy_share", "%", formula=_share("dietary_fat_total", 9.0)),
)
METRICS: dict[str, Metric] = {m.slug: m for m in (*_imported(), *DERIVED)}


def problems(metrics: dict[str, Metric]) -> list[str]:
    """What is ill formed: a metric with both or neither of rule and formula, unknown or nested operands, numerator terms of several units."""
    found = []
    for m in metrics.values():
        if (m.rule is None) == (m.formula is None):
            found.append(f"{m.slug}: needs a rule or a formula")
        if m.formula:
            known = [metrics.get(o) for o in m.formula.operands()]
            if any(o is None or o.formula for o in known):
                found.append(f"{m.slug}: an operand is unknown or derived")
            elif len({metrics[o].unit for _, o in m.formula.numerator}) > 1:
                found.append(f"{m.slug}: numerator terms differ in unit")
    return found


def vendor_type(slug: str) -> str:
    return VENDOR_PREFIX + VENDOR_NAMES.get(slug, "".join(p.capitalize() for p in slug.split("_")))


def vendor_types(spark: SparkSession) -> DataFrame:
    """(vendor_type, metric, unit) of all imported scalar metrics: a fixed, small table."""
    rows = [(vendor_type(m.slug), m.slug, m.unit) for m in METRICS.values() if m.rule and m.rule != STATES]
    return spark.createDataFrame(rows, "vendor_type string, metric string, unit string")


def rules(spark: SparkSession, metrics: dict[str, Metric] = METRICS) -> DataFrame:
    """(metric, unit, rule) of the imported metrics."""
    return spark.createDataFrame([(m.slug, m.unit, m.rule) for m in metrics.values() if m.rule], "metric string, unit string, rule string")


def formula_terms(spark: SparkSession, metrics: dict[str, Metric] = METRICS) -> DataFrame:
    """One row per derived metric and operand: (derived, metric, num, den, scale, n_operands, has_den); num and den are the operand's weights."""
    rows = []
    for m in metrics.values():
        if f := m.formula:
            for o in f.operands():
                weight = lambda terms, o=o: float(sum(w for w, x in terms if x == o))
                rows.append((m.slug, o, weight(f.numerator), weight(f.denominator), f.scale, len(f.operands()), bool(f.denominator)))
    return spark.createDataFrame(rows, "derived string, metric string, num double, den double, scale double, n_operands int, has_den boolean")


def modes(spark: SparkSession, metrics: dict[str, Metric] = METRICS) -> DataFrame:
    """(metric, mode): how a summary shows an average of each metric. What grows with its window (sums, plain weighted sums) is per day."""
    of = lambda m: "per_night" if m.rule == STATES else "per_day" if m.rule == SUM or (m.formula and not m.formula.denominator) else "mean" if m.rule == LATEST else "total"
    return spark.createDataFrame([(m.slug, of(m)) for m in metrics.values()], "metric string, mode string")


def activities(spark: SparkSession) -> DataFrame:
    """(activity_type, label, activity_group, reading) of the named activities."""
    reads = {a: r for r, names in READINGS.items() for a in names.split()}
    rows = [(a, LABELS.get(a, a.replace("_", " ").title()), g, reads.get(a, "none")) for g, names in GROUPS.items() for a in names.split()]
    return spark.createDataFrame(rows, "activity_type string, label string, activity_group string, reading string")


def listing(spark: SparkSession, metrics: dict[str, Metric] = METRICS) -> DataFrame:
    """All metrics by slug: unit, rule, formula as text, nature and sign."""

    def written(f: Formula | None) -> str | None:
        if f is None:
            return None
        part = lambda terms: " + ".join(f"{w:g}*{m}" for w, m in terms)
        return f"{f.scale:g} * ({part(f.numerator)})" + (f" / ({part(f.denominator)})" if f.denominator else "")

    rows = [(m.slug, m.unit, m.rule, written(m.formula), "derived" if m.formula else "imported", m.signed) for m in metrics.values()]
    return spark.createDataFrame(rows, "slug string, unit string, rule string, formula string, nature string, signed boolean").orderBy("slug")
