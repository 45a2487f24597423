"""SQL for the queries, in DuckDB's dialect, over the same tables."""

from __future__ import annotations

RULES = {"view": "sum", "click": "sum", "purchase": "sum", "error": "average", "signup": "latest"}
W = ("2024-01-04", "2024-01-25")
B = ("2024-01-01", "2024-01-15")

M = """m AS (SELECT event_id AS id, user_id % 3 AS account_id, event_type AS metric, value, ts AS start_at, CASE WHEN k = 0 THEN 'Manual' WHEN k % 3 = 0 THEN 'My Apple Watch' WHEN k % 3 = 1 THEN 'An iPhone' ELSE 'A Scale' END AS source
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k FROM events))"""
RANK = "CASE WHEN {m} THEN CASE WHEN lower(source) LIKE '%watch%' THEN 0 WHEN lower(source) LIKE '%iphone%' THEN 1 ELSE 2 END ELSE 0 END"


def resolved(lo: str, hi: str, p: str = "") -> str:
    """CTEs that end with {p}r: the rows that count between lo and hi."""
    rank = RANK.format(m="metric IN ('view', 'click')")
    return f"""{p}w AS (SELECT * FROM m WHERE start_at >= TIMESTAMP '{lo}' AND start_at < TIMESTAMP '{hi}'),
{p}best AS (SELECT account_id, metric, source AS winner FROM (SELECT DISTINCT account_id, metric, source, {rank} AS rk FROM {p}w WHERE source <> 'Manual') QUALIFY row_number() OVER (PARTITION BY account_id, metric ORDER BY rk, source) = 1),
{p}md AS (SELECT DISTINCT account_id, metric, CAST(start_at AS DATE) AS d FROM m WHERE source = 'Manual'),
{p}hm AS (SELECT DISTINCT account_id, metric, true AS has_manual FROM {p}w WHERE source = 'Manual'),
{p}r AS (SELECT w.* FROM {p}w w LEFT JOIN {p}best b USING (account_id, metric) LEFT JOIN {p}hm h USING (account_id, metric) LEFT JOIN {p}md x ON x.account_id = w.account_id AND x.metric = w.metric AND x.d = CAST(w.start_at AS DATE)
  WHERE w.source = 'Manual' OR (w.source = b.winner AND NOT (coalesce(has_manual, false) AND x.d IS NOT NULL)))"""


VALUE = "CASE WHEN metric = 'error' THEN avg(value) WHEN metric = 'signup' THEN first(value ORDER BY start_at DESC, id DESC) ELSE sum(value) END"
BAND = "CASE WHEN metric = 'error' THEN {f}(value) END"


def points(bucket: str, p: str = "", out: str = "p") -> str:
    return f"""{out} AS (SELECT account_id, metric, CAST(date_trunc('{bucket}', start_at) AS DATE) AS bucket, {VALUE} AS value, {BAND.format(f='min')} AS min, {BAND.format(f='max')} AS max, count(*) AS count FROM {p}r GROUP BY account_id, metric, bucket)"""


def cut(text: str) -> str:
    return "WITH " + text


def shown(where: str = "true", src: str = "p") -> str:
    return f"SELECT account_id, metric, bucket, round(value, 6) AS value, round(min, 6) AS min, round(max, 6) AS max, count FROM {src} WHERE {where}"


R = f"{M}, {resolved(*W)}"
SQL: dict[str, str] = {}
for _bucket in ("day", "week", "month"):
    for _rule in ("sum", "average", "latest"):
        _names = ", ".join(f"'{m}'" for m, x in RULES.items() if x == _rule)
        SQL[f"series_{_rule}_{_bucket}"] = cut(f"{R}, {points(_bucket)} {shown(f'metric IN ({_names})')}")
S = f"s AS (SELECT account_id, metric, {VALUE} AS value, {BAND.format(f='min')} AS min, {BAND.format(f='max')} AS max, count(*) AS count, CASE WHEN metric = 'signup' THEN avg(value) END AS mean FROM r GROUP BY account_id, metric)"
SQL["series_summary"] = cut(f"{R}, {S} SELECT account_id, metric, round(value, 6) AS value, round(min, 6) AS min, round(max, 6) AS max, count FROM s")
SQL["latest_mean"] = cut(f"{R}, {S} SELECT account_id, metric, round(mean, 6) AS mean FROM s WHERE mean IS NOT NULL")
SQL["source_election"] = cut(f"{R} SELECT account_id, metric, winner, coalesce(has_manual, false) AS has_manual FROM (SELECT DISTINCT account_id, metric FROM w) LEFT JOIN best USING (account_id, metric) LEFT JOIN hm USING (account_id, metric)")
SQL["manual_overlay"] = cut(f"{R} SELECT account_id, metric, CAST(start_at AS DATE) AS day, count(*) AS rows, count(*) FILTER (source = 'Manual') AS manual_rows, round(sum(value), 6) AS value FROM r GROUP BY ALL")


def formulas(src: str, key: str) -> str:
    k = f"account_id{key}"
    piv = f"v AS (SELECT {k}, max(value) FILTER (metric = 'view') AS v, max(value) FILTER (metric = 'click') AS c, max(value) FILTER (metric = 'purchase') AS u, max(value) FILTER (metric = 'error') AS e FROM {src} GROUP BY ALL)"
    one = lambda name, x: f"SELECT {k}, '{name}' AS metric, {x} AS value FROM v"
    return f"""{piv}, f AS ({one('engagement', 'v + c')} UNION ALL {one('net', 'u - v - c')} UNION ALL {one('purchase_share', '100 * 4 * u / nullif(v, 0)')} UNION ALL {one('purchase_per_error', 'u / nullif(e, 0)')})"""


SQL["derived_points_day"] = cut(f"{R}, {points('day')}, {formulas('p', ', bucket')} SELECT account_id, metric, bucket, round(value, 6) AS value FROM f WHERE value IS NOT NULL")
SQL["derived_ratio_week"] = cut(f"{R}, {points('week')}, {formulas('p', ', bucket')} SELECT account_id, metric, bucket, round(value, 6) AS value FROM f WHERE value IS NOT NULL AND metric LIKE 'purchase%'")
SQL["derived_summary"] = cut(f"{R}, {S}, {formulas('s', '')} SELECT account_id, metric, round(value, 6) AS value FROM f WHERE value IS NOT NULL")
SQL["compare_previous"] = cut(f"""{R}, {resolved(*B, p='b')}, {points('day')}, {points('day', 'b', 'q')},
  g AS (SELECT CAST(unnest(generate_series(DATE '{W[0]}', DATE '{W[1]}' - 1, INTERVAL 1 DAY)) AS DATE) AS bucket), h AS (SELECT bucket, CAST(bucket - CAST(DATE '{W[0]}' - DATE '{B[0]}' AS INT) AS DATE) AS baseline_bucket FROM g)
  SELECT p.account_id, p.metric, p.bucket, round(p.value, 6) AS value, baseline_bucket, round(q.value, 6) AS baseline_value FROM p JOIN h USING (bucket) LEFT JOIN q ON q.account_id = p.account_id AND q.metric = p.metric AND q.bucket = baseline_bucket WHERE baseline_bucket < DATE '{B[1]}'""")
SQL["compare_last_year"] = """WITH o AS (SELECT o_custkey % 3 AS account_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, o_orderdate AS tm, o_totalprice AS v FROM orders),
  p AS (SELECT account_id, bucket, sum(v) AS value FROM o WHERE tm >= TIMESTAMP '1997-03-01' AND tm < TIMESTAMP '1999-06-15' GROUP BY ALL), q AS (SELECT account_id, bucket, sum(v) AS value FROM o WHERE tm >= TIMESTAMP '1996-03-01' AND tm < TIMESTAMP '1998-06-15' GROUP BY ALL)
  SELECT p.account_id, 'purchase' AS metric, p.bucket, round(p.value, 6) AS value, CAST(p.bucket - INTERVAL 1 YEAR AS DATE) AS baseline_bucket, round(q.value, 6) AS baseline_value FROM p LEFT JOIN q ON q.account_id = p.account_id AND q.bucket = CAST(p.bucket - INTERVAL 1 YEAR AS DATE)"""
SPARSE = f"um AS (SELECT event_id AS id, user_id AS account_id, event_type AS metric, value, ts AS start_at FROM events), r AS (SELECT * FROM um), {points('day')}, x0 AS (SELECT account_id, metric, generate_series(min(bucket), max(bucket), INTERVAL 1 DAY) AS days FROM p GROUP BY ALL), x AS (SELECT account_id, metric, CAST(unnest(days) AS DATE) AS bucket FROM x0), d AS (SELECT x.*, p.value FROM x LEFT JOIN p USING (account_id, metric, bucket))"
SQL["dense_gaps"] = cut(f"{SPARSE} SELECT account_id, metric, bucket, round(value, 6) AS value FROM d")
SQL["gap_runs"] = cut(f"{SPARSE}, i AS (SELECT *, count(value) OVER (PARTITION BY account_id, metric ORDER BY bucket) AS run FROM d) SELECT account_id, metric, min(bucket) AS first, max(bucket) AS last, count(*) AS buckets FROM i WHERE value IS NULL GROUP BY account_id, metric, run")
SQL["lag_delta"] = cut(f"{R}, {points('day')} SELECT account_id, metric, bucket, round(value, 6) AS value, round(value - lag(value) OVER (PARTITION BY account_id, metric ORDER BY bucket), 6) AS delta FROM p")
SQL["pivot_panel"] = cut(f"{R}, {points('week')} SELECT account_id, bucket, round(max(value) FILTER (metric = 'view'), 6) AS view, round(max(value) FILTER (metric = 'click'), 6) AS click, round(max(value) FILTER (metric = 'error'), 6) AS error FROM p GROUP BY ALL")
NOW = "2024-01-29 15:30:00"
FIG = "SELECT account_id, metric, CASE WHEN metric IN ('view', 'click', 'purchase') THEN sum(value) / {n} WHEN metric = 'error' THEN avg(value) ELSE first(value ORDER BY start_at DESC, id DESC) END AS f FROM {t} GROUP BY account_id, metric"
SQL["series_extremes"] = cut(f"{R}, {points('day')} SELECT account_id, metric, round(max(value), 6) AS high, first(bucket ORDER BY value DESC, bucket) AS high_bucket, round(min(value), 6) AS low, first(bucket ORDER BY value, bucket) AS low_bucket, count(*) AS covered FROM p GROUP BY ALL")

STATES = f"""{M}, t AS (SELECT account_id, CASE metric WHEN 'view' THEN 'asleep_core' WHEN 'click' THEN 'asleep_rem' WHEN 'purchase' THEN 'asleep_deep' WHEN 'signup' THEN 'in_bed' ELSE 'awake' END AS state_value, start_at, floor(value * 60) / 60 AS minutes, source FROM m)"""
NIGHTS = f"""{STATES}, n AS (SELECT *, CAST(start_at + INTERVAL 12 HOUR AS DATE) AS night, state_value LIKE 'asleep%' AS st FROM t), nn AS (SELECT * FROM n WHERE night >= DATE '{W[0]}' AND night < DATE '{W[1]}'),
  any_st AS (SELECT account_id, night, bool_or(st) AS staged FROM nn GROUP BY ALL), win AS (SELECT account_id, night, source, staged FROM (SELECT DISTINCT account_id, night, source, staged, {RANK.format(m='true')} AS rk FROM nn JOIN any_st USING (account_id, night) WHERE source <> '' AND (NOT staged OR st)) QUALIFY row_number() OVER (PARTITION BY account_id, night ORDER BY rk, source) = 1),
  g AS (SELECT account_id, night, source, state_value, sum(minutes) AS minutes FROM nn JOIN win USING (account_id, night, source) WHERE NOT (state_value = 'in_bed' AND staged) AND minutes > 0 GROUP BY ALL),
  v AS (SELECT account_id, night, source, CASE WHEN coalesce(sum(minutes) FILTER (state_value LIKE 'asleep%'), 0) > 0 THEN sum(minutes) FILTER (state_value LIKE 'asleep%') ELSE coalesce(sum(minutes) FILTER (state_value = 'in_bed'), 0) END AS value FROM g GROUP BY ALL)"""
_nights = lambda lo, hi: NIGHTS[len(M) + 2 :].replace(W[0], lo).replace(W[1], hi)
SQL["ledger"] = cut(f"""{M}, {resolved('2024-01-22 15:30:00', NOW, 'a')}, {resolved('2024-01-15 15:30:00', '2024-01-22 15:30:00', 'c')}, {resolved('2023-12-30 15:30:00', NOW)}, {points('day')}, wk AS ({FIG.format(n=7, t='ar')}), pw AS ({FIG.format(n=7, t='cr')}), mo AS ({FIG.format(n=30, t='r')}),
  l AS (SELECT account_id, metric, arg_max(value, bucket) AS latest, max(bucket) AS latest_day FROM p GROUP BY ALL), {_nights('2023-12-31', '2024-01-30')},
  y AS (SELECT account_id, 'sleep' AS metric, arg_max(value, night) AS latest, max(night) AS latest_day, avg(value) FILTER (night BETWEEN DATE '2024-01-23' AND DATE '2024-01-29') AS w, avg(value) AS m, avg(value) FILTER (night BETWEEN DATE '2024-01-16' AND DATE '2024-01-22') AS b FROM v GROUP BY account_id),
  z AS (SELECT e.account_id, e.metric, latest, latest_day, wk.f AS w, mo.f AS m, pw.f AS b FROM (SELECT DISTINCT account_id, metric FROM m) e LEFT JOIN l USING (account_id, metric) LEFT JOIN wk USING (account_id, metric) LEFT JOIN pw USING (account_id, metric) LEFT JOIN mo USING (account_id, metric)
    UNION ALL SELECT a.account_id, 'sleep', latest, latest_day, w, m, b FROM (SELECT DISTINCT account_id FROM t) a LEFT JOIN y USING (account_id))
  SELECT account_id, metric, round(latest, 6) AS latest, latest_day, round(w, 6) AS week, round(m, 6) AS month, round(w - b, 6) AS delta, round(100 * (w - b) / nullif(b, 0), 6) AS delta_pct FROM z""")
SQL["sleep_nights"] = cut(f"{NIGHTS} SELECT account_id, night, source, round(value, 6) AS value FROM v")
SQL["sleep_stages"] = cut(f"{NIGHTS} SELECT account_id, night, state_value, round(minutes, 6) AS minutes FROM g")
SQL["sleep_week"] = cut(f"{NIGHTS} SELECT account_id, CAST(date_trunc('week', night) AS DATE) AS bucket, round(sum(value), 6) AS value, count(*) AS count FROM v GROUP BY ALL")
SQL["sleep_summary"] = cut(f"{NIGHTS} SELECT account_id, round(sum(value), 6) AS value, count(*) AS nights, first(source ORDER BY {RANK.format(m='true')}, source) AS source FROM v GROUP BY ALL")


def pairs(lag: int) -> str:
    return f"{R}, {points('day')}, ab AS (SELECT a.account_id, a.metric AS a, b.metric AS b, a.bucket, a.value AS x, b.value AS y FROM p a JOIN p b ON b.account_id = a.account_id AND b.bucket = a.bucket + {lag} AND a.metric <> b.metric)"


def covary(lag: int) -> str:
    rank = lambda v: f"rank() OVER (PARTITION BY account_id, a, b ORDER BY {v}) + (count(*) OVER (PARTITION BY account_id, a, b, {v}) - 1) / 2.0"
    return cut(f"""{pairs(lag)}, k AS (SELECT account_id, a, b, {rank('x')} AS x, {rank('y')} AS y FROM ab),
  c AS (SELECT account_id, a, b, count(*) AS shared, CASE WHEN count(*) < 3 OR var_pop(x) * var_pop(y) = 0 THEN 0 ELSE covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END AS rho FROM k GROUP BY ALL)
  SELECT account_id, a, b, shared, round(rho, 6) AS rho, shared >= 13 AS ranked FROM c""")


SQL["covary_same"] = covary(0)
SQL["covary_next_day"] = covary(1)
SQL["covary_fit"] = cut(f"{pairs(0)}, z AS (SELECT account_id, a, b, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, min(x) AS lo, max(x) AS hi FROM ab GROUP BY ALL HAVING min(x) < max(x)) SELECT account_id, a, b, round(s, 6) AS slope, round(i, 6) AS intercept, round(lo, 6) AS x0, round(i + s * lo, 6) AS y0, round(hi, 6) AS x1, round(i + s * hi, 6) AS y1 FROM z")
SQL["ols_slope"] = cut(f"{R}, {points('day')} SELECT account_id, metric, round(CASE WHEN count(*) >= 2 THEN regr_slope(value, bucket - DATE '2000-01-01') END, 6) AS slope, count(*) AS points FROM p GROUP BY ALL")
INPUTS = f"""{R}, {points('day')}, i AS (SELECT account_id, avg(value) FILTER (metric = 'view') AS intake, count(*) FILTER (metric = 'view') AS intake_days, avg(value) FILTER (metric = 'error') AS mass, count(*) FILTER (metric = 'error') AS mass_days,
  CASE WHEN count(*) FILTER (metric = 'error') >= 2 THEN regr_slope(value, bucket - DATE '{W[0]}') FILTER (metric = 'error') END AS slope, avg(value) FILTER (metric = 'purchase') AS recorded, CASE account_id WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS sex FROM p GROUP BY account_id), j AS (SELECT *, mass * 0.8 AS lean, 178.0 AS height, 41.5 AS age FROM i)"""
_one = lambda name, kcal, need: f"SELECT account_id, '{name}' AS equation, {kcal} AS kcal, {need} AS missing FROM j"
_lean = "CASE WHEN lean IS NULL THEN 'lean_mass' ELSE '' END"
_body = "concat_ws(',', CASE WHEN mass IS NULL THEN 'mass' END, CASE WHEN sex IS NULL THEN 'sex' END)"
SQL["basal_estimates"] = cut(f"""{INPUTS}, q AS ({_one('katch_mcardle', '370 + 21.6 * lean', _lean)} UNION ALL {_one('cunningham', '500 + 22 * lean', _lean)}
  UNION ALL {_one('mifflin_st_jeor', "10 * mass + 6.25 * height - 5 * age + CASE sex WHEN 'male' THEN 5 WHEN 'female' THEN -161 END", _body)}
  UNION ALL {_one('harris_benedict', "CASE sex WHEN 'male' THEN 88.362 + 13.397 * mass + 4.799 * height - 5.677 * age WHEN 'female' THEN 447.593 + 9.247 * mass + 3.098 * height - 4.330 * age END", _body)}) SELECT account_id, equation, round(CAST(kcal AS DOUBLE), 6) AS kcal, missing FROM q""")
SQL["expenditure"] = cut(f"{INPUTS}, o AS (SELECT *, CASE WHEN intake_days / 28.0 >= 0.7 AND mass_days >= 10 THEN intake - slope * 7700 END AS observed, (370 + 21.6 * lean) * 1.375 AS predicted FROM j) SELECT account_id, round(coalesce(observed, recorded, predicted), 6) AS kcal, CASE WHEN observed IS NOT NULL THEN 'observed' WHEN recorded IS NOT NULL THEN 'recorded' WHEN predicted IS NOT NULL THEN 'predicted' END AS basis FROM o")
TARGETS = f"""{INPUTS}, a AS (SELECT account_id, mass, lean, 2000 + mass AS e, CASE account_id WHEN 0 THEN -0.5 WHEN 1 THEN -2.0 ELSE 0.5 END::DOUBLE AS rate, 370 + 21.6 * lean AS basal FROM j), b AS (SELECT *, e + rate / 100 * mass * 7700 / 7 AS kcal, (1.6 + 0.8 * least(greatest(-rate, 0), 1)) * coalesce(lean, mass) AS protein FROM a),
  c AS (SELECT *, greatest(0.6 * mass, 0.2 * kcal / 9) AS fat FROM b), d AS (SELECT *, greatest(0, (kcal - 4 * protein - 9 * fat) / 4) AS carbs FROM c)"""
SQL["targets"] = cut(f"{TARGETS} SELECT account_id, round(kcal, 6) AS kcal, round(protein, 6) AS protein, round(fat, 6) AS fat, round(carbs, 6) AS carbs FROM d")
SQL["guardrails"] = cut(f"{TARGETS} SELECT d.account_id, concat_ws(',', CASE WHEN kcal < basal THEN 'below_basal' END, CASE WHEN abs(rate) > 1 THEN 'rate_too_fast' END, CASE WHEN carbs = 0 THEN 'no_carbs' END, CASE WHEN rate < 0 AND recorded / 10 < protein THEN 'protein_under_floor' END) AS warnings FROM d JOIN j USING (account_id)")
# Readings of users as accounts; windows that all share, and each account's own.
Y = """y AS (SELECT event_id AS id, user_id AS account_id, CASE event_type WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'dietary_energy' ELSE 'dietary_protein' END WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'height' ELSE 'active_energy' END
    WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'body_fat_percentage' ELSE 'basal_energy' END WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'lean_body_mass' ELSE 'body_mass' END ELSE 'body_mass' END AS metric,
    CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN value / 1000 ELSE value END AS value, ts AS start_at, CASE WHEN k = 0 THEN 'Manual' WHEN k % 3 = 0 THEN 'My Apple Watch' WHEN k % 3 = 1 THEN 'An iPhone' ELSE 'A Scale' END AS source FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k FROM events))"""
PHASES = """ph AS (SELECT o_custkey AS account_id, o_orderkey AS id, (o_orderkey % 9 - 4) / 4.0::DOUBLE AS rate, TIMESTAMP '2024-01-03' + to_hours(CAST(o_orderkey % 28 * 24 + o_orderkey % 24 AS INT)) AS started_at, o_orderkey % 4 = 0 AS open FROM orders),
  ow AS (SELECT account_id, arg_max(id, (started_at, id)) AS phase_id, arg_max(rate, (started_at, id)) AS target_rate, max(started_at) AS own_start FROM ph WHERE open GROUP BY account_id)"""


def own(p: str, rows: str) -> str:
    """CTEs that end with {p}p: day points of the rows (a condition on y and ow) that count in a window of the account's own."""
    return f"""{p}w AS (SELECT y.* FROM y {rows}), {p}b AS (SELECT account_id, metric, min(source) AS winner FROM {p}w WHERE source <> 'Manual' GROUP BY ALL), {p}h AS (SELECT DISTINCT account_id, metric, true AS hm FROM {p}w WHERE source = 'Manual'), {p}d AS (SELECT DISTINCT account_id, metric, CAST(start_at AS DATE) AS d FROM y WHERE source = 'Manual'),
  {p}r AS (SELECT w.*, b.winner FROM {p}w w LEFT JOIN {p}b b USING (account_id, metric) LEFT JOIN {p}h h USING (account_id, metric) LEFT JOIN {p}d x ON x.account_id = w.account_id AND x.metric = w.metric AND x.d = CAST(w.start_at AS DATE) WHERE w.source = 'Manual' OR (w.source = b.winner AND NOT (coalesce(hm, false) AND x.d IS NOT NULL))),
  {p}p AS (SELECT account_id, metric, CAST(start_at AS DATE) AS day, CASE WHEN metric LIKE 'dietary%' OR metric LIKE '%energy' THEN sum(value) ELSE first(value ORDER BY start_at DESC, id DESC) END AS v FROM {p}r GROUP BY account_id, metric, CAST(start_at AS DATE))"""


_span = lambda lo: f"WHERE start_at >= TIMESTAMP '{lo}' AND start_at < TIMESTAMP '{NOW}'"
_own_span = f"JOIN ow USING (account_id) WHERE start_at >= own_start AND start_at < TIMESTAMP '{NOW}'"
RESOLVED = f"""{Y}, {own('n', _span('2024-01-01 15:30:00'))}, {own('e', _span('1994-01-28 15:30:00'))}, g AS (SELECT account_id, metric, avg(value) AS mean FROM nr GROUP BY ALL), f AS (SELECT account_id, metric, first(value ORDER BY start_at DESC, id DESC) AS ever, max(winner) AS src FROM er GROUP BY ALL),
  mn AS (SELECT DISTINCT account_id, true AS typed FROM y WHERE source = 'Manual' AND metric IN ('lean_body_mass', 'body_fat_percentage') AND start_at < TIMESTAMP '{NOW}'),
  q AS (SELECT account_id, max(coalesce(mean, ever)) FILTER (metric = 'body_mass') AS mass, max(ever) FILTER (metric = 'height') AS height, max(coalesce(mean, ever)) FILTER (metric = 'lean_body_mass') AS lean, max(coalesce(mean, ever)) FILTER (metric = 'body_fat_percentage') AS fat, max(src) FILTER (metric = 'lean_body_mass') AS ls, max(src) FILTER (metric = 'body_fat_percentage') AS fs
    FROM f LEFT JOIN g USING (account_id, metric) WHERE metric IN ('body_mass', 'height', 'lean_body_mass', 'body_fat_percentage') GROUP BY account_id),
  u AS (SELECT account_id, mass, height, coalesce(lean, mass * (1 - fat)) AS lean_mass, lean IS NULL AND mass * (1 - fat) IS NOT NULL AS lean_mass_derived, CASE WHEN typed THEN 'Manual' ELSE coalesce(ls, fs) END AS lean_source FROM q LEFT JOIN mn USING (account_id))"""
SQL["resolve_inputs"] = cut(f"{RESOLVED} SELECT account_id, round(mass, 6) AS mass, round(height, 6) AS height, round(lean_mass, 6) AS lean_mass, lean_mass_derived, lean_source FROM u")
_trust = "CASE WHEN coalesce(lean_source, '') = '' THEN 'unknown' WHEN lean_source = 'Manual' THEN 'measured' ELSE 'estimated' END"
SQL["equation_choice"] = cut(f"""{RESOLVED}, t AS (SELECT *, {_trust} AS trust, account_id % 3 <> 2 AND mass IS NOT NULL AND height IS NOT NULL AS body FROM u)
  SELECT account_id, trust, CASE WHEN trust = 'measured' AND lean_mass IS NOT NULL THEN 'katch_mcardle' WHEN body THEN 'mifflin_st_jeor' WHEN lean_mass IS NOT NULL THEN 'katch_mcardle' END AS equation FROM t""")
OWN = f"""{PHASES}, {own('z', _own_span)}, eaten AS (SELECT account_id, avg(v) FILTER (metric = 'dietary_energy') AS ate, avg(v) FILTER (metric = 'dietary_protein') AS protein_ate, CASE WHEN count(*) FILTER (metric = 'body_mass') >= 2 THEN regr_slope(v, day - DATE '2024-01-01') FILTER (metric = 'body_mass') * 7 / nullif(avg(v) FILTER (metric = 'body_mass'), 0) * 100 END AS own_rate FROM zp GROUP BY account_id),
  oe AS (SELECT ow.*, greatest(1, CAST(round(epoch(TIMESTAMP '{NOW}' - own_start) / 86400) AS INT)) AS days, own_start < TIMESTAMP '{NOW}' AS begun FROM ow)"""
SQL["adherence_phase"] = cut(f"""{Y}, {OWN} SELECT account_id, days, days < 14 AS thin, round(target_rate, 6) AS target_rate, round(CASE WHEN begun THEN own_rate END, 6) AS rate, round(CASE WHEN c_custkey IS NOT NULL THEN account_id % 100 * 10.0::DOUBLE + 1500 END, 6) AS target_kcal, round(CASE WHEN begun THEN ate END, 6) AS intake,
  round(CASE WHEN c_custkey IS NOT NULL THEN account_id % 50 + 100.0::DOUBLE END, 6) AS target_protein, round(CASE WHEN begun THEN protein_ate END, 6) AS protein FROM oe LEFT JOIN eaten USING (account_id) LEFT JOIN customer ON c_custkey = account_id""")
SQL["plan"] = cut(f"""{RESOLVED}, {OWN}, te AS (SELECT a.account_id, avg(a.v + b.v) AS recorded FROM np a JOIN np b ON a.account_id = b.account_id AND a.day = b.day AND a.metric = 'active_energy' AND b.metric = 'basal_energy' GROUP BY ALL),
  rf AS (SELECT account_id, avg(v) FILTER (metric = 'dietary_energy') AS intake, count(*) FILTER (metric = 'dietary_energy') AS intake_days, count(*) FILTER (metric = 'body_mass') AS mass_days, avg(v) FILTER (metric = 'body_mass') AS mean_mass, regr_slope(v, day - DATE '2024-01-01') FILTER (metric = 'body_mass') AS slope FROM np GROUP BY account_id),
  a AS (SELECT c_custkey AS account_id, (DATE '2024-01-29' - (DATE '1950-01-01' + CAST(c_custkey * 37 % 18000 AS INT))) / 365.25 AS age, CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS sex, CASE c_custkey % 5 WHEN 0 THEN 'measured' WHEN 1 THEN 'estimated' END AS declared FROM customer),
  b AS (SELECT a.*, u.mass, height, lean_mass, lean_mass_derived, coalesce(declared, {_trust}) AS trust, 370 + 21.6 * lean_mass AS katch, 10 * u.mass + 6.25 * height - 5 * age + CASE sex WHEN 'male' THEN 5 WHEN 'female' THEN -161 END AS mifflin FROM a LEFT JOIN u USING (account_id)),
  c AS (SELECT *, CASE WHEN trust = 'measured' AND katch IS NOT NULL THEN 'katch_mcardle' WHEN mifflin IS NOT NULL THEN 'mifflin_st_jeor' WHEN katch IS NOT NULL THEN 'katch_mcardle' END AS equation FROM b),
  d AS (SELECT c.*, CASE equation WHEN 'katch_mcardle' THEN katch WHEN 'mifflin_st_jeor' THEN mifflin END AS basal_kcal, CASE WHEN intake_days / 28.0 >= 0.7 AND mass_days >= 10 THEN intake - slope * 7700 END AS observed, recorded, CASE WHEN mass_days >= 10 THEN slope * 7 / nullif(mean_mass, 0) * 100 END AS act FROM c LEFT JOIN rf USING (account_id) LEFT JOIN te USING (account_id)),
  e2 AS (SELECT d.*, coalesce(observed, recorded, basal_kcal * 1.375) AS expenditure, CASE WHEN observed IS NOT NULL THEN 'observed' WHEN recorded IS NOT NULL THEN 'recorded' WHEN basal_kcal IS NOT NULL THEN 'predicted' END AS basis FROM d),
  f2 AS (SELECT e2.*, phase_id, target_rate, days, begun, CASE WHEN expenditure IS NOT NULL THEN coalesce(target_rate, act, 0) END AS rate FROM e2 LEFT JOIN oe USING (account_id)),
  g2 AS (SELECT *, expenditure + rate / 100 * mass * 7700 / 7 AS kcal FROM f2), h2 AS (SELECT *, CASE WHEN kcal IS NOT NULL THEN (1.6 + 0.8 * least(greatest(-rate, 0), 1)) * coalesce(lean_mass, mass) END AS protein, CASE WHEN kcal IS NOT NULL THEN greatest(0.6 * mass, 0.2 * kcal / 9) END AS fat FROM g2),
  i2 AS (SELECT h2.*, CASE WHEN kcal IS NOT NULL THEN greatest(0, (kcal - 4 * protein - 9 * fat) / 4) END AS carbs, phase_id IS NOT NULL AND kcal IS NOT NULL AS judged, CASE WHEN phase_id IS NOT NULL AND kcal IS NOT NULL AND begun THEN ate END AS actual_kcal, CASE WHEN phase_id IS NOT NULL AND kcal IS NOT NULL AND begun THEN protein_ate END AS actual_protein, CASE WHEN phase_id IS NOT NULL AND kcal IS NOT NULL AND begun THEN own_rate END AS phase_actual_rate FROM h2 LEFT JOIN eaten USING (account_id))
  SELECT account_id, trust, equation, basis, CASE WHEN expenditure IS NOT NULL THEN phase_id END AS phase_id, CASE WHEN judged THEN days END AS days, CASE WHEN judged THEN days < 14 END AS thin,
    concat_ws(',', CASE WHEN kcal < basal_kcal THEN 'below_basal' END, CASE WHEN kcal IS NOT NULL AND abs(rate) > 1 THEN 'rate_too_fast' END, CASE WHEN carbs = 0 THEN 'no_carbs' END, CASE WHEN rate < 0 AND actual_protein < protein THEN 'protein_under_floor' END) AS warnings,
    round(mass, 6) AS mass, round(height, 6) AS height, round(lean_mass, 6) AS lean_mass, round(basal_kcal, 6) AS basal_kcal, round(expenditure, 6) AS expenditure, round(CASE WHEN expenditure IS NOT NULL THEN act END, 6) AS actual_rate, round(rate, 6) AS rate, round(kcal, 6) AS kcal, round(protein, 6) AS protein, round(fat, 6) AS fat, round(carbs, 6) AS carbs, round(phase_actual_rate, 6) AS phase_actual_rate, round(actual_kcal, 6) AS actual_kcal, round(actual_protein, 6) AS actual_protein FROM i2""")

SESS = """s AS (SELECT o_orderkey AS id, o_custkey % 3 AS account_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'running' WHEN '2-HIGH' THEN 'cycling' WHEN '3-MEDIUM' THEN 'yoga' WHEN '4-NOT SPECIFIED' THEN 'parkour' WHEN '5-LOW' THEN 'swimming' ELSE 'other' END AS activity_type,
  o_orderdate AS start_at, o_totalprice / 10 AS duration, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice / 1000 END AS distance, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 100 END AS energy FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1999-06-16')"""
SQL["session_page"] = cut(f"{SESS} SELECT id, activity_type, CAST(start_at AS DATE) AS day, round(duration, 6) AS duration FROM s WHERE account_id = 1 AND (start_at < TIMESTAMP '1999-01-01' OR (start_at = TIMESTAMP '1999-01-01' AND id < 1000000000)) ORDER BY start_at DESC, id DESC LIMIT 50")
SQL["session_totals"] = cut(f"{SESS} SELECT account_id, count(*) AS sessions, round(coalesce(sum(duration), 0), 6) AS duration, round(sum(distance), 6) AS distance, round(sum(energy), 6) AS energy FROM s WHERE activity_type IN ('running', 'cycling') GROUP BY ALL")
SQL["session_has_route"] = cut(f"{SESS} SELECT account_id, activity_type, EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey = s.id) AS has_route, count(*) AS n FROM s GROUP BY ALL")
SQL["activity_other"] = cut(f"{SESS} SELECT account_id, activity_type, upper(activity_type[1]) || activity_type[2:] AS label, 'other' AS activity_group, 'none' AS reading, count(*) AS n FROM s WHERE activity_type IN ('parkour', 'other') GROUP BY ALL")
SQL["session_statistics"] = cut(f"{SESS}, t AS (SELECT DISTINCT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'average' WHEN 'N' THEN 'sum' ELSE 'max' END AS stat FROM lineitem) SELECT account_id, 'heart_rate' AS metric, stat, count(*) AS n FROM s JOIN t USING (id) GROUP BY ALL")
SQL["session_next"] = cut(f"""{SESS}, k AS (SELECT * FROM s WHERE account_id = 2 AND activity_type NOT IN ('yoga', 'parkour') ORDER BY start_at DESC, id DESC LIMIT 50) SELECT id, activity_type, CASE WHEN row_number() OVER (ORDER BY start_at DESC, id DESC) = 50 THEN base64(encode('["' || strftime(start_at, '%Y-%m-%d %H:%M:%S') || '", ' || id || ']')) END AS next_cursor FROM k""")
SQL["session_detail"] = cut(f"""{SESS}, t0 AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'average' WHEN 'N' THEN 'sum' ELSE 'max' END AS stat, arg_max(l_quantity, l_linenumber * 1000 + l_quantity) AS v FROM lineitem GROUP BY ALL),
  t AS (SELECT id, string_agg('heart_rate:' || stat || ':' || printf('%.2f', v), ',' ORDER BY stat) AS stats FROM t0 GROUP BY id), r AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R')
  SELECT account_id, s.id, activity_type, coalesce(stats, '') AS stats, CASE WHEN r.id IS NULL THEN 0 ELSE 1 END AS routes FROM s LEFT JOIN t ON t.id = s.id LEFT JOIN r ON r.id = s.id""")
SQL["existence_probes"] = "SELECT c_custkey AS account_id, c_custkey IN (SELECT user_id FROM events UNION SELECT o_custkey FROM orders) AS has_any FROM customer"
SQL["bucket_keys"] = "WITH w AS (SELECT o_custkey % 3 AS account_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS b, sum(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT account_id, strftime(b, '%Y-%m-%d') AS day, strftime(b, '%G-W%V') AS week, strftime(b, '%Y-%m') AS month, round(v, 6) AS value FROM w"
NOTES = "n AS (SELECT o_orderkey AS id, o_custkey % 3 AS account_id, o_orderstatus AS label, CAST(o_orderdate AS DATE) AS starts_on, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + 20 END AS ends_on FROM orders)"
FOLDED = "SELECT id, account_id, starts_on, ends_on, CAST(date_trunc('month', greatest(starts_on, DATE '1997-03-01')) AS DATE) AS first_bucket, CAST(date_trunc('month', least({end}, DATE '1999-06-14')) AS DATE) AS last_bucket FROM n WHERE starts_on <= DATE '1999-06-14' AND {end} >= DATE '1997-03-01'"
SQL["annotation_overlap"] = cut(f"{NOTES} {FOLDED.format(end='coalesce(ends_on, starts_on)')}")
SQL["phases_folded"] = cut(f"{NOTES} {FOLDED.format(end="coalesce(ends_on, greatest(starts_on, DATE '1999-06-14'))")}")
WIDE = "n AS (SELECT o_orderkey AS id, o_custkey AS account_id, CAST(o_orderdate AS DATE) - 70 AS starts_on, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + 90 ELSE CAST(o_orderdate AS DATE) + 70 END AS ends_on FROM orders)"
_months = "x AS (SELECT DISTINCT {a} AS account_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1999-06-15')"
_placed = "z AS (SELECT id, k.account_id, (SELECT min(bucket) FROM x WHERE x.account_id = k.account_id AND bucket >= first_bucket) AS from_bucket, (SELECT max(bucket) FROM x WHERE x.account_id = k.account_id AND bucket <= last_bucket) AS to_bucket FROM k)"
SQL["annotation_axis"] = cut(f"{WIDE}, {_months.format(a='o_custkey')}, k AS ({FOLDED.format(end='ends_on')}), {_placed} SELECT id, account_id, from_bucket, greatest(from_bucket, to_bucket) AS to_bucket FROM z WHERE from_bucket IS NOT NULL")
SQL["annotation_marks"] = cut(f"{NOTES}, {_months.format(a='o_custkey % 3')}, k AS ({FOLDED.format(end='coalesce(ends_on, starts_on)')}), {_placed} SELECT account_id, from_bucket AS bucket, count(*) AS marks FROM z WHERE from_bucket IS NOT NULL GROUP BY ALL")
SQL["source_spans"] = cut(f"{M}, u AS (SELECT account_id, source, start_at FROM m UNION ALL SELECT account_id, source, start_at FROM m) SELECT account_id, source, CAST(min(start_at) AS VARCHAR) AS first_at, CAST(max(start_at) AS VARCHAR) AS last_at, count(*) AS rows FROM u GROUP BY ALL")
SQL["overall_span"] = cut(f"{M} SELECT account_id, CAST(min(t) AS DATE) AS first_day, CAST(max(t) AS DATE) AS last_day FROM (SELECT account_id, start_at AS t FROM m UNION ALL SELECT o_custkey % 3, o_orderdate FROM orders) GROUP BY ALL")
REC = f"{M}, c AS (SELECT *, CASE WHEN id % 11 = 0 THEN NULL ELSE (id % 200)::DOUBLE END AS v FROM m)"
SQL["history_events"] = cut(f"""{NOTES}, {REC}, f AS (SELECT account_id, source, CAST(min(start_at) AS DATE) AS d, 2 * count(*) AS rows FROM m GROUP BY account_id, source), un AS (SELECT account_id, count(*) AS u FROM c WHERE metric IN ('error', 'signup') OR (metric IN ('view', 'click') AND v IS NULL) GROUP BY account_id)
  SELECT account_id, starts_on AS day, 'import' AS kind, 0 AS kind_rank, 'export-' || id AS label, NULL::VARCHAR AS body, NULL::DATE AS ends_on, NULL::DOUBLE AS rate, id % 500 AS added, id % 7 AS skipped, id % 3 AS unmapped, NULL::BIGINT AS rows FROM n WHERE label = 'P'
  UNION ALL SELECT account_id, starts_on, 'phase', 1, CASE id % 3 WHEN 0 THEN 'cut' WHEN 1 THEN 'maintenance' ELSE 'bulk' END, NULL, ends_on, id % 3 - 1, NULL, NULL, NULL, NULL FROM n WHERE label = 'F'
  UNION ALL SELECT account_id, starts_on, 'note', 2, label, CASE WHEN id % 2 = 0 THEN 'about ' || id ELSE '' END, ends_on, NULL, NULL, NULL, NULL, NULL FROM n WHERE label = 'O'
  UNION ALL SELECT account_id, d, 'source', 3, source, NULL, NULL, NULL, NULL, NULL, NULL, rows FROM f UNION ALL SELECT account_id, min(d), 'origin', 4, '', NULL, NULL, NULL, NULL, NULL, max(u), NULL FROM f LEFT JOIN un USING (account_id) GROUP BY account_id""")
SQL["unmapped_route"] = cut(f"""{REC} SELECT 'measurements' AS family, 'body_mass' AS name, count(*) AS n, round(sum(v * 453.59237 / 1000), 6) AS total FROM c WHERE metric = 'view' AND v IS NOT NULL HAVING count(*) > 0
  UNION ALL SELECT 'measurements', 'body_temperature', count(*), round(sum((v - 32) * 5 / 9), 6) FROM c WHERE metric = 'click' AND v IS NOT NULL HAVING count(*) > 0 UNION ALL SELECT 'states', 'asleep_core', count(*), NULL FROM c WHERE metric = 'purchase' HAVING count(*) > 0
  UNION ALL SELECT 'unmapped', CASE metric WHEN 'view' THEN 'HKQuantityTypeIdentifierBodyMass' WHEN 'click' THEN 'HKQuantityTypeIdentifierBodyTemperature' WHEN 'error' THEN 'HKQuantityTypeIdentifierUnknown' ELSE 'HKQuantityTypeIdentifierStepCount' END, count(*), NULL FROM c WHERE metric IN ('error', 'signup') OR (metric IN ('view', 'click') AND v IS NULL) GROUP BY 2""")
SQL["vendor_times"] = cut(f"{M} SELECT id AS seq, CAST(date_trunc('second', start_at) - INTERVAL 2 HOUR AS VARCHAR) AS start_at FROM m")
SQL["unit_convert"] = """WITH l AS (SELECT l_orderkey % 10 AS k, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1), c(k, from_unit, to_unit, f, o) AS (VALUES (0, 'lb', 'kg', 453.59237 / 1000, 0.0), (1, 'km/hr', 'm/s', 1000.0 / 3600, 0.0), (2, 'degF', 'degC', 5.0 / 9, -160.0 / 9), (3, 'degC', 'K', 1.0, 273.15), (4, 'kJ', 'kcal', 239.005736 / 1000, 0.0), (5, 'kg', 'm', NULL, NULL), (6, '%', '%', 1.0, 0.0), (7, 'opaque', 'opaque', 1.0, 0.0), (8, 'degC', 'kg', NULL, NULL), (9, 'oz', 'g', 28.349523125, 0.0))
  SELECT from_unit, to_unit, CASE WHEN f IS NULL THEN 0 ELSE n END AS n, round(CAST(f AS DOUBLE) * s + CAST(o AS DOUBLE) * n, 4) AS total FROM c JOIN l USING (k)"""
KEYED = f"{M}, k AS (SELECT id, account_id, metric, sha256(concat_ws(chr(31), metric, source, CAST(floor(value) AS BIGINT)::VARCHAR)) AS content_key FROM m), b AS (SELECT * FROM k WHERE id % 3 <> 0), o AS (SELECT DISTINCT account_id, content_key, true AS seen FROM k WHERE id % 3 = 0), u AS (SELECT account_id, content_key, min(id) AS id, count(*) AS copies, first(metric ORDER BY id) AS metric FROM b GROUP BY ALL), e AS (SELECT u.*, seen IS NULL AS fresh FROM u LEFT JOIN o USING (account_id, content_key))"
SQL["dedupe_content_key"] = cut(f"{KEYED} SELECT id, account_id, metric, content_key FROM e WHERE fresh")
SQL["import_report"] = cut(f"{KEYED} SELECT account_id, 'measurements' AS family, metric AS name, count(*) FILTER (fresh) AS added, CAST(sum(copies - CASE WHEN fresh THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM e GROUP BY ALL")
SQL["manual_list"] = cut(f"{M} SELECT id, account_id, round(value, 6) AS value FROM m WHERE source = 'Manual' AND metric = 'view' ORDER BY start_at DESC, id DESC LIMIT 200")
SQL["distinct_sources"] = cut(f"{M} SELECT account_id, metric, source, count(*) AS rows FROM m WHERE start_at >= TIMESTAMP '{W[0]}' AND start_at < TIMESTAMP '{W[1]}' GROUP BY ALL")
SQL["distinct_metrics"] = cut(f"{M} SELECT DISTINCT account_id, metric FROM m")
TRACK = "t AS (SELECT user_id AS route_id, event_id AS seq, 48 + (event_id % 997) / 1000.0::DOUBLE AS lat, 2 + (event_id % 613) / 1000.0::DOUBLE AS lon, (event_id % 37)::DOUBLE AS ele, ts AS tm FROM events WHERE value IS NOT NULL)"
_A = "pow(sin(radians({b1} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({b1})) * pow(sin(radians({b2} - {a2}) / 2), 2)"
HAV = f"2 * 6371.0088 * asin(CASE WHEN {_A} > 1 THEN 1 ELSE sqrt({_A}) END)"
STEP = f"q AS (SELECT *, coalesce({HAV.format(a1='lag(lat) OVER o', a2='lag(lon) OVER o', b1='lat', b2='lon')}, 0) AS step FROM t WINDOW o AS (PARTITION BY route_id ORDER BY seq))"
SQL["haversine_length"] = cut(f"{TRACK}, {STEP} SELECT route_id, count(*) AS points, round(sum(step), 4) AS km FROM q GROUP BY ALL")
SQL["ascent_hysteresis"] = f"""WITH RECURSIVE {TRACK}, k AS (SELECT route_id, ele, row_number() OVER (PARTITION BY route_id ORDER BY seq) AS i FROM t),
  f AS (SELECT route_id, i, ele AS z, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM k WHERE i = 1 UNION ALL SELECT k.route_id, k.i, CASE WHEN abs(ele - z) > 3 THEN ele ELSE z END, up + CASE WHEN ele - z > 3 THEN ele - z ELSE 0 END, down + CASE WHEN z - ele > 3 THEN z - ele ELSE 0 END FROM f JOIN k ON k.route_id = f.route_id AND k.i = f.i + 1)
  SELECT route_id, round(arg_max(up, i), 6) AS ascent, round(arg_max(down, i), 6) AS descent FROM f GROUP BY route_id"""
SQL["route_samples"] = cut(f"""{TRACK}, {STEP}, c AS (SELECT *, sum(step) OVER (PARTITION BY route_id ORDER BY seq) AS km, row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY route_id) AS n FROM q),
  e AS (SELECT *, epoch_us(last(tm) OVER w) / 1e6 - epoch_us(first(tm) OVER w) / 1e6 AS dt, last(km) OVER w - first(km) OVER w AS dk FROM c WINDOW w AS (PARTITION BY route_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
  SELECT route_id, seq, round(km, 4) AS km, round(CASE WHEN dt > 0 THEN dk / (dt / 3600) END, 3) AS speed FROM e WHERE i % greatest(1, CAST(ceil(n / 20.0) AS BIGINT)) = 0 OR i = n - 1""")
_away = """CASE WHEN den = 0 THEN sqrt(px * px + py * py) ELSE sqrt(pow(px - greatest(0, least(1, (px * ex + py * ey) / den)) * ex, 2) + pow(py - greatest(0, least(1, (px * ex + py * ey) / den)) * ey, 2)) END"""
SQL["route_simplify"] = f"""WITH RECURSIVE {TRACK}, n0 AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS i0, count(*) OVER (PARTITION BY route_id) AS n FROM t), n1 AS (SELECT * FROM n0 WHERE i0 % greatest(1, CAST(ceil(n / 240.0) AS BIGINT)) = 0 OR i0 = n - 1),
  k AS (SELECT route_id, seq, lat, lon, ele, tm, row_number() OVER (PARTITION BY route_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY route_id) AS m FROM n1),
  g AS (SELECT route_id, 1 AS a, max(m) AS b, 0 AS mid, 1e300::DOUBLE AS rank FROM k GROUP BY route_id
    UNION ALL SELECT route_id, unnest([a, f]) AS a, unnest([f, b]) AS b, f AS mid, least(rank, d) AS rank FROM (SELECT route_id, a, b, rank, max(d) AS d, first(i ORDER BY d DESC, i) AS f FROM (SELECT g.route_id, g.a, g.b, g.rank, p.i, {_away} AS d
      FROM (SELECT g.*, x.lat AS alat, x.lon AS alon, (y.lon - x.lon) * cos(radians(x.lat)) * 111.32 AS ex, (y.lat - x.lat) * 111.32 AS ey, pow((y.lon - x.lon) * cos(radians(x.lat)) * 111.32, 2) + pow((y.lat - x.lat) * 111.32, 2) AS den FROM g JOIN k x ON x.route_id = g.route_id AND x.i = g.a JOIN k y ON y.route_id = g.route_id AND y.i = g.b WHERE g.b > g.a + 1) g
      JOIN (SELECT *, radians(lat) AS rl FROM k) p ON p.route_id = g.route_id AND p.i > g.a AND p.i < g.b, LATERAL (SELECT (p.lon - alon) * cos(radians(alat)) * 111.32 AS px, (p.lat - alat) * 111.32 AS py) l) GROUP BY route_id, a, b, rank) WHERE d > 0),
  r AS (SELECT k.route_id, k.i, CASE WHEN k.i = 1 OR k.i = k.m THEN 1e300 ELSE coalesce(max(g.rank), 0) END AS rank FROM k LEFT JOIN g ON g.route_id = k.route_id AND g.mid = k.i GROUP BY k.route_id, k.i, k.m),
  h AS (SELECT route_id, list(rank) AS ranks FROM r GROUP BY route_id), c AS (SELECT route_id, ranks, 1.0::DOUBLE AS hi FROM h UNION ALL SELECT route_id, ranks, hi * 4 FROM c WHERE hi < 1000 AND len(list_filter(ranks, lambda x: x > hi)) > 30),
  q AS (SELECT route_id, ranks, 0.0::DOUBLE AS lo, max(hi) AS hi, 0 AS step FROM c GROUP BY route_id, ranks UNION ALL SELECT route_id, ranks, CASE WHEN len(list_filter(ranks, lambda x: x > (lo + hi) / 2)) > 30 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN len(list_filter(ranks, lambda x: x > (lo + hi) / 2)) > 30 THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM q WHERE step < 12)
  SELECT k.route_id, k.seq, k.lat, k.lon, k.ele, CAST(tm AS VARCHAR) AS at FROM k JOIN r USING (route_id, i) JOIN q ON q.route_id = k.route_id AND q.step = 12 WHERE k.m <= 30 OR rank > q.hi"""
SQL["point_distance"] = cut(f"{TRACK} SELECT seq, round({HAV.format(a1='48.5', a2='2.25', b1='lat', b2='lon')}, 6) AS km FROM t")
SQL["metric_listing"] = """WITH c(slug, unit, nature) AS (VALUES ('view', 'count', 'imported'), ('click', 'count', 'imported'), ('purchase', 'count', 'imported'), ('error', 'count', 'imported'), ('signup', 'count', 'imported'), ('engagement', 'count', 'derived'), ('net', 'count', 'derived'), ('purchase_share', '%', 'derived'), ('purchase_per_error', '1', 'derived'))
  SELECT slug, unit, nature, (SELECT count(*) FROM events WHERE event_type = slug) AS rows FROM c"""
SQL["stream_daily"] = "SELECT user_id % 3 AS account_id, event_type AS metric, CAST(ts AS DATE) AS bucket, round(sum(value), 6) AS sum, count(*) AS count FROM events GROUP BY ALL"
SUMMED = f"{R}, {S}, {formulas('s', '')}, {NIGHTS[len(M) + 2 :]}, a AS (SELECT account_id, metric, value, mean, NULL AS nights FROM s UNION ALL SELECT account_id, metric, value, NULL, NULL FROM f WHERE value IS NOT NULL UNION ALL SELECT account_id, 'sleep', sum(value), NULL, count(*) FROM v2n GROUP BY account_id)"
SUMMED = SUMMED.replace("v AS (SELECT account_id, night, source, CASE", "v2n AS (SELECT account_id, night, source, CASE")
_mode = "CASE WHEN metric IN ('view', 'click', 'purchase', 'engagement', 'net') THEN 'per_day' WHEN metric = 'sleep' THEN 'per_night' WHEN metric = 'signup' THEN 'mean' ELSE 'total' END"
SQL["summary_figures"] = cut(f"{SUMMED}, o AS (SELECT *, {_mode} AS mode FROM a) SELECT account_id, metric, mode, round(CASE mode WHEN 'per_day' THEN value / 21 WHEN 'per_night' THEN value / nights WHEN 'mean' THEN mean ELSE value END, 6) AS figure FROM o")
SQL["summary_totals"] = cut(f"{SUMMED} SELECT account_id, metric, 'total' AS mode, round(value, 6) AS figure FROM a")
SQL["series_routed"] = cut(f"""{R}, {points('week')}, {formulas('p', ', bucket')}, {NIGHTS[len(M) + 2 :].replace('v AS (SELECT account_id, night, source, CASE', 'v2n AS (SELECT account_id, night, source, CASE')} SELECT account_id, metric, bucket, round(value, 6) AS value, count FROM p UNION ALL SELECT account_id, metric, bucket, round(value, 6), NULL FROM f WHERE value IS NOT NULL
  UNION ALL SELECT account_id, 'sleep', CAST(date_trunc('week', night) AS DATE), round(sum(value), 6), count(*) FROM v2n GROUP BY ALL""")
_sb = S.replace("FROM r GROUP", "FROM br GROUP").replace("s AS (", "sb AS (", 1)
_f2 = formulas("sb", "").replace("v AS (", "v2 AS (", 1).replace("FROM v ", "FROM v2 ").replace(" FROM v)", " FROM v2)").replace(", f AS (", ", f2 AS (")
SQL["compare_delta"] = cut(f"{R}, {resolved(*B, p='b')}, {S}, {_sb}, {formulas('s', '')}, {_f2}, o AS (SELECT f.account_id, f.metric, f.value, f2.value AS baseline, CASE WHEN f.metric = 'net' OR f2.value = 0 THEN f.value - f2.value ELSE 100 * (f.value - f2.value) / abs(f2.value) END AS delta, CASE WHEN f.metric = 'net' OR f2.value = 0 THEN round(abs(f.value - f2.value), 1) ELSE round(abs((f.value - f2.value) / f2.value * 100)) END AS shown FROM f LEFT JOIN f2 USING (account_id, metric) WHERE f.value IS NOT NULL) SELECT account_id, metric, round(value, 6) AS value, round(baseline, 6) AS baseline, round(delta, 6) AS delta, CAST(CASE WHEN shown = 0 THEN 0 ELSE sign(value - baseline) END AS INT) AS direction FROM o")
SQL["adherence"] = cut(f"{TARGETS} SELECT d.account_id, CASE d.account_id WHEN 2 THEN 1 ELSE 13 END AS days, true AS thin, round(d.rate, 6) AS target_rate, round(CASE WHEN d.account_id <> 2 AND mass_days >= 2 THEN slope * 7 / d.mass * 100 END, 6) AS rate, round(d.kcal, 6) AS target_kcal, round(CASE WHEN d.account_id <> 2 THEN intake END, 6) AS intake, round(d.protein, 6) AS target_protein, round(CASE WHEN d.account_id <> 2 THEN recorded END, 6) AS protein FROM d JOIN j USING (account_id)")
SQL["planned_rate"] = cut(f"{INPUTS}, z AS (SELECT account_id, CASE WHEN mass_days >= 10 THEN slope * 7 / mass * 100 END AS a FROM j) SELECT account_id, round(a, 6) AS actual_rate, round(coalesce(CASE WHEN account_id = 0 THEN -0.4 END, a, 0)::DOUBLE, 6) AS rate FROM z")
SQL["count_unmapped"] = cut(f"{REC} SELECT CASE metric WHEN 'view' THEN 'HKQuantityTypeIdentifierBodyMass' WHEN 'click' THEN 'HKQuantityTypeIdentifierBodyTemperature' WHEN 'error' THEN 'HKQuantityTypeIdentifierUnknown' ELSE 'HKQuantityTypeIdentifierStepCount' END AS source_type, count(*) AS n FROM c WHERE metric IN ('error', 'signup') OR (metric IN ('view', 'click') AND v IS NULL) GROUP BY 1")
HISTORY = """r AS (SELECT o_custkey AS account_id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS v FROM orders), s0 AS (SELECT account_id, day FROM r UNION ALL SELECT user_id, CAST(ts AS DATE) FROM events),
  e AS (SELECT account_id, min(day) AS lo, max(day) AS hi, CASE WHEN max(day) - min(day) <= 31 THEN 'day' WHEN max(day) - min(day) <= 366 THEN 'week' ELSE 'month' END AS grain FROM s0 GROUP BY account_id), p AS (SELECT account_id, CAST(date_trunc(grain, day) AS DATE) AS bucket, sum(v) AS value FROM r JOIN e USING (account_id) GROUP BY ALL),
  x AS (SELECT account_id, grain, CAST(unnest(generate_series(date_trunc(grain, lo), date_trunc(grain, hi), CASE grain WHEN 'day' THEN INTERVAL 1 DAY WHEN 'week' THEN INTERVAL 7 DAY ELSE INTERVAL 1 MONTH END)) AS DATE) AS bucket FROM e WHERE account_id IN (SELECT account_id FROM r)),
  b AS (SELECT x.account_id, x.bucket, x.grain, p.value FROM x LEFT JOIN p USING (account_id, bucket))"""
SQL["history_band"] = cut(f"{HISTORY} SELECT account_id, bucket, grain, round(value, 6) AS value, value IS NULL AS gap FROM b")
SQL["history_gaps"] = cut(f"{HISTORY}, i AS (SELECT *, count(value) OVER (PARTITION BY account_id ORDER BY bucket) AS run FROM b) SELECT account_id, 'purchase' AS metric, min(bucket) AS first, max(bucket) AS last, count(*) AS buckets FROM i WHERE value IS NULL GROUP BY account_id, run")
SQL["history_phases"] = cut(f"""{HISTORY}, n AS (SELECT o_orderkey AS id, o_custkey AS account_id, (o_orderkey % 5 - 2) / 2.0::DOUBLE AS rate, CAST(o_orderdate AS DATE) - 15 AS started_on, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS ended_on FROM orders),
  k AS (SELECT n.*, grain, CAST(date_trunc(grain, started_on) AS DATE) AS a, CAST(date_trunc(grain, coalesce(ended_on, hi)) AS DATE) AS z, CAST(date_trunc(grain, lo) AS DATE) AS f, CAST(date_trunc(grain, hi) AS DATE) AS l FROM n JOIN e USING (account_id) WHERE coalesce(ended_on, hi) >= started_on)
  SELECT account_id, id, CASE WHEN rate > 0 THEN 'bulk' WHEN rate < 0 THEN 'cut' ELSE 'maintenance' END AS kind, round(rate, 6) AS rate_pct_per_week, started_on, ended_on, greatest(a, f) AS from_bucket, least(z, l) AS to_bucket FROM k WHERE z >= f AND a <= l""")
SQL["covary_next_week"] = covary(7).replace(points("day"), points("week")).replace("shared >= 13 AS ranked", "shared >= 3 AND shared >= 4 AS ranked")
SQL["covary_strongest"] = cut(covary(0)[5:].replace("SELECT account_id, a, b, shared, round(rho, 6) AS rho, shared >= 13 AS ranked FROM c", "SELECT account_id, a, b, round(rho, 6) AS rho FROM c WHERE shared >= 13 AND a < b QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY abs(rho) DESC, a, b) = 1"))
ROUTED = f"""{R}, {points('day')}, {formulas('p', ', bucket')}, {NIGHTS[len(M) + 2 :].replace('v AS (SELECT account_id, night, source, CASE', 'v2n AS (SELECT account_id, night, source, CASE')},
  rp AS (SELECT account_id, metric, bucket, value FROM p UNION ALL SELECT account_id, metric, bucket, value FROM f WHERE value IS NOT NULL UNION ALL SELECT account_id, 'sleep', night, sum(value) FROM v2n GROUP BY ALL)"""
PINS = """pin(position, metric) AS (VALUES (1, 'view'), (2, 'nothing'), (3, 'click'), (4, 'purchase'), (5, 'sleepless'), (6, 'error'), (7, 'signup'), (8, 'engagement'), (9, 'net'), (10, 'sleep'), (11, 'purchase_share')),
  named AS (SELECT *, row_number() OVER (ORDER BY position) AS place FROM pin WHERE metric NOT IN ('nothing', 'sleepless'))"""
SQL["covary_inputs"] = cut(f"""{ROUTED}, h AS (SELECT DISTINCT account_id, metric FROM rp), {PINS} SELECT a.account_id, pin.metric, place, CASE WHEN place IS NULL THEN 'not in the catalog' WHEN place > 8 THEN 'beyond the 8 compared' WHEN h.metric IS NULL THEN 'no data in this window' END AS skipped
  FROM (SELECT DISTINCT account_id FROM m) a CROSS JOIN pin LEFT JOIN named USING (metric) LEFT JOIN h ON h.account_id = a.account_id AND h.metric = pin.metric""")
_rank = lambda v: f"rank() OVER (PARTITION BY account_id, a, b ORDER BY {v}) + (count(*) OVER (PARTITION BY account_id, a, b, {v}) - 1) / 2.0"
_rho = f"""k AS (SELECT account_id, a, b, {_rank('x')} AS x, {_rank('y')} AS y FROM ab), c AS (SELECT account_id, a, b, count(*) AS shared, CASE WHEN count(*) < 3 OR var_pop(x) * var_pop(y) = 0 THEN 0 ELSE covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END AS rho FROM k GROUP BY ALL)"""
_ab = "ab AS (SELECT a.account_id, a.metric AS a, b.metric AS b, a.bucket, a.value AS x, b.value AS y FROM {t} a JOIN {t} b ON b.account_id = a.account_id AND b.bucket = a.bucket AND a.metric <> b.metric)"
SQL["covary_routed"] = cut(f"{ROUTED}, {_ab.format(t='rp')}, {_rho} SELECT account_id, a, b, shared, round(rho, 6) AS rho, shared >= 13 AS ranked FROM c")
SQL["covary_pinned"] = cut(f"""{ROUTED}, {PINS}, rq AS (SELECT rp.* FROM rp JOIN named USING (metric) WHERE place <= 8), {_ab.format(t='rq')}, {_rho} SELECT account_id, a, b, round(rho, 6) AS rho FROM c JOIN named ga ON ga.metric = a JOIN named gb ON gb.metric = b WHERE shared >= 13 QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY round(abs(rho), 12) DESC, ga.place, gb.place) = 1""")

SQL["daily_followed"] = cut(f"{M} SELECT account_id, metric, source, CAST(start_at AS DATE) AS day, count(*) AS n, round(sum(value), 6) AS total, round(min(value), 6) AS low, round(max(value), 6) AS high, round(CASE WHEN metric = 'signup' THEN first(value ORDER BY start_at DESC, id DESC) END, 6) AS latest FROM m GROUP BY account_id, metric, source, CAST(start_at AS DATE)")
SQL["store_delete"] = cut(f"{M} SELECT account_id, metric, source, count(*) AS n, round(sum(value), 6) AS total FROM m WHERE NOT (account_id = 1 AND source = 'Manual') GROUP BY ALL")
SQL["export_scan"] = SQL["unmapped_route"]

SQL["session_readings"] = cut(f"""{SESS}, k AS (SELECT id, CASE activity_type WHEN 'running' THEN 'pace' WHEN 'cycling' THEN 'speed' WHEN 'swimming' THEN 'pace' ELSE 'none' END AS reading, CAST(round(duration) AS BIGINT) AS t, (id % 50 + 1) / (duration / 3600) AS v FROM s), p AS (SELECT *, CAST(round(3600 / v) AS BIGINT) AS q FROM k)
  SELECT id, reading, CASE WHEN t >= 3600 THEN (t // 3600) || 'h ' || lpad(CAST(t % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN t >= 60 THEN (t // 60) || 'm' ELSE t || 's' END AS duration,
    CASE reading WHEN 'pace' THEN (q // 60) || ':' || lpad(CAST(q % 60 AS VARCHAR), 2, '0') || '/km' WHEN 'speed' THEN replace(regexp_replace(printf('%.1f', round(v, 1)), '\\.0$', ''), '.', ',') || ' km/h' END AS shown FROM p""")
SQL["sleep_labels"] = cut(f"{NIGHTS}, l AS (SELECT account_id, night, CAST(round(value) AS BIGINT) AS t FROM v) SELECT account_id, night, CASE WHEN t < 60 THEN t || 'm' ELSE (t // 60) || 'h ' || (t % 60) || 'm' END AS slept FROM l")

MEMBERS = """mb0 AS (SELECT o_custkey % 3 AS account_id, o_custkey AS panel_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'view' WHEN '2-HIGH' THEN 'error' WHEN '3-MEDIUM' THEN 'purchase_share' WHEN '4-NOT SPECIFIED' THEN 'nothing' WHEN '5-LOW' THEN 'net' END AS metric, min(o_orderkey) AS position FROM orders GROUP BY ALL),
  cat(metric, unit, default_chart) AS (VALUES ('view', 'count', 'bar'), ('error', 'count', 'band'), ('purchase_share', '%', 'line'), ('net', 'count', 'diverging_bar')),
  mb AS (SELECT b.*, unit, default_chart, coalesce(CASE position % 5 WHEN 0 THEN 'band' WHEN 1 THEN 'area' END, default_chart) AS chart FROM mb0 b LEFT JOIN cat USING (metric) WHERE metric IS NOT NULL)"""
SQL["panel_assembly"] = cut(f"{MEMBERS} SELECT account_id, panel_id, string_agg(metric || ':' || coalesce(unit, '?') || ':' || coalesce(chart, '?'), ',' ORDER BY position) AS metrics FROM mb GROUP BY account_id, panel_id")
SQL["panel_problems"] = cut(f"{MEMBERS} SELECT account_id, panel_id, concat_ws(',', CASE WHEN count(*) > 4 THEN 'too many metrics' END, CASE WHEN count(DISTINCT unit) > 2 THEN 'too many units' END, CASE WHEN bool_or(unit IS NULL) THEN 'unknown metric' END, CASE WHEN bool_or(unit IS NOT NULL AND chart = 'band' AND metric <> 'error') THEN 'chart doesn''t fit' END) AS problems FROM mb GROUP BY account_id, panel_id")
SQL["panel_points"] = cut(f"{R}, {points('week')}, {formulas('p', ', bucket')}, {MEMBERS} SELECT mb.account_id, panel_id, mb.metric, chart, p.bucket, round(p.value, 6) AS value FROM mb LEFT JOIN p ON p.account_id = mb.account_id AND p.metric = mb.metric")
SQL["pins_added"] = cut(f"""{MEMBERS}, held AS (SELECT panel_id AS account_id, metric, CASE metric WHEN 'view' THEN 0 ELSE 3 END AS position FROM mb WHERE metric IN ('view', 'net')), fresh AS (SELECT panel_id AS account_id, metric, row_number() OVER (PARTITION BY panel_id ORDER BY position) - 1 AS k FROM mb WHERE metric NOT IN ('view', 'net'))
  SELECT account_id, metric, position FROM held UNION ALL SELECT account_id, metric, CAST(coalesce((SELECT max(position) + 1 FROM held h WHERE h.account_id = f.account_id), 0) + k AS INT) FROM fresh f""")

#: Columns that are days. Both sides show days as text, so that no client's date type matters.
DAYS = {
    "bucket": [k for k in SQL if k.startswith(("series_sum_", "series_average_", "series_latest_"))] + "annotation_marks panel_points history_band series_routed derived_points_day derived_ratio_week compare_previous compare_last_year dense_gaps lag_delta pivot_panel sleep_week stream_daily".split(),
    "baseline_bucket": ["compare_previous", "compare_last_year"], "day": ["manual_overlay", "session_page", "history_events", "daily_followed"], "night": ["sleep_nights", "sleep_stages", "sleep_labels"],
    "first": ["gap_runs", "history_gaps"], "last": ["gap_runs", "history_gaps"], "started_on": ["history_phases"], "ended_on": ["history_phases"], "latest_day": ["ledger"], "high_bucket": ["series_extremes"], "low_bucket": ["series_extremes"],
    "starts_on": ["annotation_overlap", "phases_folded"], "ends_on": ["annotation_overlap", "phases_folded", "history_events"], "first_bucket": ["annotation_overlap", "phases_folded"], "last_bucket": ["annotation_overlap", "phases_folded"],
    "from_bucket": ["annotation_axis", "history_phases"], "to_bucket": ["annotation_axis", "history_phases"], "first_day": ["overall_span"], "last_day": ["overall_span"],
}
for _name in {q for qs in DAYS.values() for q in qs}:
    _replaced = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c, qs in DAYS.items() if _name in qs)
    SQL[_name] = f"SELECT * REPLACE ({_replaced}) FROM ({SQL[_name]})"
