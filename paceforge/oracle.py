"""The lenses and facts in SQL, as common table expressions for the comparison queries."""

from __future__ import annotations

from paceforge.constants import ALPHA_FATIGUE, ALPHA_FITNESS, DRIFT_DEFAULT_THRESHOLD, DRIFT_THRESHOLDS

ACTS = """acts AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS activity_day,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Run' WHEN '2-HIGH' THEN 'TrailRun' WHEN '3-MEDIUM' THEN 'Hike'
      WHEN '4-NOT SPECIFIED' THEN 'Walk' ELSE 'Ride' END AS sport_type,
    o_totalprice AS distance_m, 600 + o_orderkey % 7200 AS moving_time_s,
    600 + o_orderkey % 7200 + o_custkey % 300 AS elapsed_time_s, CAST(o_custkey % 900 AS DOUBLE) AS elevation_gain_m,
    o_custkey % 9 AS kudos_count,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 1200 AS DOUBLE) END AS calories_kcal,
    o_orderkey % 10 <> 0 AS has_detail
  FROM orders)"""

SAMPLES = """samp AS (
  SELECT l_orderkey AS activity_id,
    CASE WHEN l_discount >= 0.005 THEN CAST(90 + floor(2 * l_quantity) AS BIGINT) END AS heartrate,
    l_tax * 50 AS velocity, l_extendedprice / 100 AS altitude
  FROM lineitem)"""

SCALARS = """scalars AS (
  SELECT activity_id, count(*) AS stream_count, count(heartrate) AS hr_count, min(heartrate) AS min_hr,
    max(heartrate) AS max_hr,
    round_even(avg(heartrate) FILTER (heartrate IS NOT NULL AND velocity > 0.3)
      / nullif(avg(velocity) FILTER (heartrate IS NOT NULL AND velocity > 0.3), 0), 2) AS cardiac_cost,
    median(heartrate) AS median_hr
  FROM samp GROUP BY activity_id)"""

ASOF = """day_max AS (
  SELECT activity_day, max(m) AS m FROM acts LEFT JOIN (SELECT activity_id, max(heartrate) AS m FROM samp GROUP BY 1)
    ON id = activity_id GROUP BY activity_day),
asof_max AS (
  SELECT activity_day, max(m) OVER (ORDER BY activity_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS max_hr_to_day
  FROM day_max)"""


def _limits(top: str) -> str:
    return ", ".join(
        f"CAST(round_even(53 + {p} * CAST({top} - 53 AS DOUBLE), 0) AS BIGINT) AS b{k}"
        for k, p in enumerate((0.5, 0.6, 0.7, 0.8, 0.9))
    )


_RAW = """(CAST(count(*) FILTER (heartrate < b0) AS DOUBLE) * 0.5 + count(*) FILTER (heartrate >= b0 AND heartrate < b1) * 1.0::DOUBLE
    + count(*) FILTER (heartrate >= b1 AND heartrate < b2) * 2.0::DOUBLE + count(*) FILTER (heartrate >= b2 AND heartrate < b3) * 3.0::DOUBLE
    + count(*) FILTER (heartrate >= b3 AND heartrate < b4) * 4.0::DOUBLE + count(*) FILTER (heartrate >= b4) * 5.0::DOUBLE)"""

ZONES = f"""limits AS (SELECT id, max_hr_to_day, {_limits("CASE WHEN max_hr_to_day > 53 THEN max_hr_to_day END")} FROM acts JOIN asof_max USING (activity_day)),
zones AS (
  SELECT id, CASE WHEN count(heartrate) > 0 THEN any_value(max_hr_to_day) END AS hr_max_used,
    count(*) FILTER (heartrate < b0) AS zone1_seconds,
    count(*) FILTER (heartrate >= b0 AND heartrate < b1) AS zone2_seconds,
    count(*) FILTER (heartrate >= b1 AND heartrate < b2) AS zone3_seconds,
    count(*) FILTER (heartrate >= b2 AND heartrate < b3) AS zone4_seconds,
    count(*) FILTER (heartrate >= b4) AS zone5_seconds, round_even({_RAW} / 60.0::DOUBLE, 1) AS trimp
  FROM limits LEFT JOIN samp ON id = activity_id AND heartrate IS NOT NULL GROUP BY id)"""

FACTS = """facts AS (
  SELECT a.id AS activity_id, activity_day, sport_type, CAST(1 AS BIGINT) AS metric_version,
    CASE WHEN coalesce(stream_count, 0) = 0 THEN 'unknown' WHEN coalesce(hr_count, 0) = 0 OR NOT has_detail THEN 'partial'
      ELSE 'complete' END AS completeness_status,
    list_filter([CASE WHEN NOT has_detail THEN 'missing_details' END, CASE WHEN coalesce(stream_count, 0) = 0 THEN 'missing_streams' END,
      CASE WHEN coalesce(hr_count, 0) = 0 THEN 'missing_hr' END], lambda x: x IS NOT NULL) AS missing_reasons,
    coalesce(trimp, 0.0) AS trimp, coalesce(zone1_seconds, 0) AS zone1_seconds, coalesce(zone2_seconds, 0) AS zone2_seconds,
    coalesce(zone3_seconds, 0) AS zone3_seconds, coalesce(zone4_seconds, 0) AS zone4_seconds, coalesce(zone5_seconds, 0) AS zone5_seconds,
    cardiac_cost, round_even(cardiac_cost - 0.45 * (elevation_gain_m / nullif(distance_m / 1000.0, 0)), 3) AS adjusted_cardiac_cost,
    CASE WHEN max_hr > 53 THEN round_even((median_hr - 53) / (max_hr - 53) * 100.0, 1) END AS hrr_pct,
    distance_m, calories_kcal, moving_time_s, elapsed_time_s, elevation_gain_m, kudos_count,
    coalesce(hr_count, 0) AS heartrate_sample_count, coalesce(stream_count, 0) AS stream_sample_count,
    min_hr AS observed_min_hr, max_hr AS observed_max_hr, hr_max_used, 0 AS anomaly_count
  FROM acts a LEFT JOIN scalars s ON a.id = s.activity_id LEFT JOIN zones z ON a.id = z.id)"""

SESSION = f"""session_limits AS (SELECT {_limits("top")} FROM (SELECT CASE WHEN max(heartrate) > 53 THEN max(heartrate) ELSE 54 END AS top FROM samp)),
loads AS (SELECT activity_id, count(*) AS points, count(heartrate) AS hr_points, {_RAW} AS raw FROM samp, session_limits GROUP BY activity_id)"""

DAILY = """by_sport AS (
  SELECT activity_day, sport_type, count(*) AS n, coalesce(sum(points), 0) AS points, coalesce(sum(hr_points), 0) AS hr_points,
    coalesce(sum(raw), 0.0) AS raw FROM acts LEFT JOIN loads ON id = activity_id GROUP BY ALL),
per_day AS (
  SELECT activity_day AS day, sum(n) AS activity_count, sum(points) AS stream_points, sum(hr_points) AS heartrate_points,
    round_even(sum(raw) / 60.0::DOUBLE, 1) AS observed,
    round_even(sum(round_even(round_even(raw / 60.0::DOUBLE, 1) * 10, 0) * CASE WHEN sport_type = 'Walk' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) / 10.0::DOUBLE, 1) AS effective
  FROM by_sport GROUP BY activity_day),
spine AS (SELECT CAST(unnest(generate_series(min(activity_day), max(activity_day), INTERVAL 1 DAY)) AS DATE) AS day FROM acts),
load_ AS (
  SELECT day, CAST(coalesce(activity_count, 0) AS BIGINT) AS activity_count, CAST(coalesce(stream_points, 0) AS BIGINT) AS stream_points,
    CAST(coalesce(heartrate_points, 0) AS BIGINT) AS heartrate_points, observed, effective,
    CASE WHEN coalesce(activity_count, 0) = 0 THEN 'REST' WHEN coalesce(stream_points, 0) = 0 THEN 'UNKNOWN'
      WHEN coalesce(heartrate_points, 0) = 0 THEN 'PARTIAL' ELSE 'OBSERVED' END AS status
  FROM spine LEFT JOIN per_day USING (day)),
daily_load AS (
  SELECT day, status, activity_count, stream_points, heartrate_points, CASE WHEN status = 'OBSERVED' THEN observed END AS observed_trimp,
    CASE WHEN status = 'OBSERVED' THEN effective ELSE 0.0 END AS effective_trimp FROM load_)"""

DAILY_FACTS = """sums AS (
  SELECT activity_day AS day, sum(distance_m) AS distance_m, sum(moving_time_s) AS moving_time_s, sum(elevation_gain_m) AS elevation_gain_m,
    sum(zone4_seconds) AS z4, sum(zone5_seconds) AS z5 FROM facts GROUP BY activity_day),
daily AS (
  SELECT day, 'all' AS scope, 'all' AS sport_type, CAST(1 AS BIGINT) AS metric_version, lower(status) AS completeness_status,
    CASE status WHEN 'UNKNOWN' THEN ['missing_streams'] WHEN 'PARTIAL' THEN ['missing_hr'] ELSE [] END AS missing_reasons,
    activity_count, stream_points AS stream_point_count, heartrate_points AS heartrate_point_count, observed_trimp, effective_trimp,
    coalesce(distance_m, 0.0) AS distance_m, CAST(coalesce(moving_time_s, 0) AS BIGINT) AS moving_time_s,
    coalesce(elevation_gain_m, 0.0) AS elevation_gain_m, CAST(coalesce(z4, 0) AS BIGINT) AS zone4_seconds,
    CAST(coalesce(z5, 0) AS BIGINT) AS zone5_seconds, CAST(coalesce(z4, 0) + coalesce(z5, 0) AS BIGINT) AS high_zone_seconds,
    0 AS anomaly_count
  FROM daily_load LEFT JOIN sums USING (day))"""

MODEL = f"""days_ AS (SELECT min(day) - 90 AS first_day, max(day) AS last_day FROM daily_load),
series(day, load, fitness, fatigue) AS (
  SELECT CAST(first_day - 1 AS DATE), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM days_
  UNION ALL
  SELECT CAST(s.day + 1 AS DATE), coalesce(d.effective_trimp, 0.0),
    round_even((fitness + {ALPHA_FITNESS!r}::DOUBLE * (coalesce(d.effective_trimp, 0.0) - fitness)) * 10, 0) / 10,
    round_even((fatigue + {ALPHA_FATIGUE!r}::DOUBLE * (coalesce(d.effective_trimp, 0.0) - fatigue)) * 10, 0) / 10
  FROM series s JOIN days_ ON s.day < last_day LEFT JOIN daily_load d ON d.day = s.day + 1),
model AS (
  SELECT day, load AS effective_trimp, fitness, fatigue, fitness - fatigue AS form,
    CASE WHEN fitness - fatigue < -5 THEN 'tired' WHEN fitness - fatigue < 10 THEN 'normal' ELSE 'fresh' END AS form_zone,
    CASE WHEN fitness > 0 THEN round_even(fatigue / fitness, 3) END AS acwr
  FROM series JOIN (SELECT min(day) AS first_load FROM daily_load) ON day >= first_load),
model_facts AS (
  SELECT *, CASE WHEN acwr IS NULL THEN 'unknown' WHEN acwr >= 0.8 AND acwr <= 1.3 THEN 'sweet_spot' WHEN acwr > 1.3 AND acwr <= 1.35
      THEN 'caution' WHEN acwr > 1.35 THEN 'danger' ELSE 'undertrained' END AS acwr_zone FROM model)"""

#: (needed for facts), (needed for daily load), (needed for both)
FOR_FACTS = f"{ACTS}, {SAMPLES}, {SCALARS}, {ASOF}, {ZONES}, {FACTS}"
FOR_DAILY = f"{ACTS}, {SAMPLES}, {SESSION}, {DAILY}"
FOR_BOTH = f"{FOR_FACTS}, {SESSION}, {DAILY}, {DAILY_FACTS}"

PAYLOADS = """log AS (
  SELECT o_orderkey AS activity_id, kind AS payload_kind, CAST(CAST(o_orderdate AS DATE) + v AS VARCHAR) AS fetched_at,
    CASE kind WHEN 'summary' THEN '{"id":' || o_orderkey || CASE WHEN v = 2 THEN ',"kudos_count":' || (o_custkey % 9) ELSE '' END
        || ',"average_heartrate":' || CASE WHEN o_orderkey % 7 = 0 THEN '"n/a"' ELSE CAST(100 + o_orderkey % 80 AS VARCHAR) END
        || ',"start_date_local":"' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || 'T' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':15:00Z"}'
      ELSE '{"calories":' || (o_orderkey % 1200) || ',"gear":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '{"id":"g' || (o_orderkey % 5)
        || '","name":"Shoe ' || (o_orderkey % 5) || '","distance":' || (o_orderkey * 10) || '}' END || '}' END AS payload_json
  FROM orders, (VALUES ('summary', 1), ('summary', 2), ('detail', 1)) t(kind, v)),
latest AS (
  SELECT activity_id, payload_kind, fetched_at, payload_json FROM log
  QUALIFY row_number() OVER (PARTITION BY activity_id, payload_kind ORDER BY fetched_at DESC, md5(payload_json) DESC) = 1)"""

SAMPLES_E = """samp_e AS (
  SELECT CAST(event_id // 500 AS BIGINT) AS activity_id, CAST(event_id % 500 AS BIGINT) AS time_offset,
    CAST(95 + CAST(floor(value) AS BIGINT) % 90 AS BIGINT) AS heartrate,
    CASE WHEN event_id % 500 % 100 BETWEEN 50 AND 89 THEN 0.0 ELSE 2.0 + event_id % 500 // 125 % 2 + (event_id % 20) / 100.0 END AS velocity,
    CAST(500 + event_id % 50 AS DOUBLE) AS altitude
  FROM events)"""

ACTS_E = """acts AS (
  SELECT id, activity_day, ['Run', 'TrailRun', 'Hike', 'Walk', 'Ride'][id % 5 + 1] AS sport_type, CAST(1000.0 + 100 * (id % 50) AS DOUBLE) AS distance_m,
    480 + id % 20 AS moving_time_s, 500 + id % 20 AS elapsed_time_s, CAST(id % 7 * 10 AS DOUBLE) AS elevation_gain_m, id % 9 AS kudos_count,
    CAST(200 + id % 100 AS DOUBLE) AS calories_kcal, id % 10 <> 0 AS has_detail,
    CASE WHEN id % 7 <> 0 THEN CAST(100 + id % 80 AS DOUBLE) END AS summary_avg, CASE WHEN id % 7 <> 0 THEN CAST(140 + id % 80 AS DOUBLE) END AS summary_max
  FROM (SELECT CAST(event_id // 500 AS BIGINT) AS id, CAST(min(ts) AS DATE) AS activity_day FROM events GROUP BY 1))"""

CLIMB = """climb AS (
  SELECT activity_id, CASE WHEN n >= 60 AND h >= 0.05 THEN CAST(round_even(up / h, 0) AS BIGINT) END AS vmh,
    CASE WHEN n >= 60 AND h >= 0.05 THEN round_even(up, 0) END AS total_ascent_m, CASE WHEN n >= 60 AND h >= 0.05 THEN round_even(h, 2) END AS duration_hours
  FROM (SELECT activity_id, count(*) AS n, coalesce(sum(rise) FILTER (rise > 0), 0) AS up, (max(time_offset) - min(time_offset)) / 3600.0::DOUBLE AS h
    FROM (SELECT *, altitude - lag(altitude) OVER (PARTITION BY activity_id ORDER BY time_offset) AS rise FROM samp_e) GROUP BY 1))"""

PAUSES = """e AS (SELECT *, count(*) OVER (PARTITION BY activity_id) AS n, velocity < 0.15 AS slow FROM samp_e),
m AS (SELECT *, CASE WHEN coalesce(NOT lag(slow) OVER w OR time_offset - lag(time_offset) OVER w > 3, TRUE) THEN 1 ELSE 0 END AS starts
  FROM e WHERE n >= 120 WINDOW w AS (PARTITION BY activity_id ORDER BY time_offset)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY activity_id ORDER BY time_offset) AS run FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY activity_id, run ORDER BY time_offset) AS a,
  row_number() OVER (PARTITION BY activity_id, run ORDER BY time_offset DESC) AS b FROM g WHERE slow),
p AS (SELECT activity_id, min(time_offset) AS start_offset, max(time_offset) - min(time_offset) AS duration_s, count(*) AS sampled_s,
  round_even(avg(heartrate) FILTER (a <= 5) - avg(heartrate) FILTER (b <= 5), 1) AS drop_bpm FROM k GROUP BY activity_id, run),
pauses AS (SELECT *, round_even(drop_bpm / (sampled_s / 60.0::DOUBLE), 1) AS rate FROM p WHERE duration_s >= 30)"""

RECOVERY = """recovery AS (
  SELECT activity_id, count(*) AS pause_count, CAST(sum(duration_s) AS BIGINT) AS total_rest_sec, round_even(median(rate), 1) AS median_rate,
    max(rate) AS best_rate, min(rate) AS worst_rate, round_even(avg(rate), 1) AS avg_rate FROM pauses GROUP BY activity_id)"""

#: Whole facts of the dense lens, but for drift: ``whole``.
FOR_DENSE = f"""{ACTS_E}, {SAMPLES_E}, samp AS (SELECT * FROM samp_e), {SCALARS}, {ASOF}, {ZONES}, {FACTS}, {CLIMB}, {PAUSES}, {RECOVERY},
whole AS (
  SELECT f.*, summary_avg AS avg_hr, summary_max AS max_hr, coalesce(pause_count, 0) AS hr_recovery_pause_count, coalesce(total_rest_sec, 0) AS hr_recovery_total_rest_sec,
    median_rate AS hr_recovery_median_rate, best_rate AS hr_recovery_best_rate, worst_rate AS hr_recovery_worst_rate, avg_rate AS hr_recovery_avg_rate,
    vmh AS vertical_speed_vmh, total_ascent_m AS vertical_speed_total_ascent_m, duration_hours AS vertical_speed_duration_hours
  FROM facts f JOIN acts a ON a.id = f.activity_id LEFT JOIN climb c ON c.activity_id = f.activity_id LEFT JOIN recovery r ON r.activity_id = f.activity_id)"""


def _classes(k: int) -> str:
    """Least squared error of the first j sorted values in ``k`` classes, and where the last class begins (the first such place)."""
    return f"""
d{k} AS MATERIALIZED (
  SELECT activity_id, j, m[1] AS cost, m[2] AS cut FROM (
    SELECT r.activity_id, r.y AS j, min((d.cost + r.e, r.x)) AS m FROM errors r JOIN d{k - 1} d ON d.activity_id = r.activity_id AND d.j = r.x
    WHERE r.x >= {k - 1} GROUP BY 1, 2)),"""


def _borders(k: int) -> str:
    """Borders of the best ``k`` classes of all values, walked back from the last one."""
    steps = " ".join(f"JOIN d{t} t{t} ON t{t}.activity_id = z.activity_id AND t{t}.j = {'z.m' if t == k else f't{t + 1}.cut'}" for t in range(k, 1, -1))
    cuts = ", ".join(f"t{t}.cut" for t in range(2, k + 1))
    return f"SELECT z.activity_id, {k} AS k, [0, {cuts}, z.m] AS borders, CASE WHEN whole > 0 THEN (whole - t{k}.cost) / whole ELSE 1.0 END AS fit FROM sizes z {steps}"


#: Cardiac drift of the dense lens: natural breaks by a dynamic programme over the sorted velocities, whose prefix sums are added up one by one.
#: Needs WITH RECURSIVE, SAMPLES_E and acts; gives ``drift``.  ``limit``: the threshold of an activity's sport.
DRIFT = (
    """moved AS (
  SELECT activity_id, heartrate, velocity, count(*) OVER (PARTITION BY activity_id) AS n,
    row_number() OVER (PARTITION BY activity_id ORDER BY time_offset, velocity, heartrate) - 1 AS k
  FROM samp_e WHERE velocity > 0.3 AND heartrate IS NOT NULL),
thinned AS (
  SELECT activity_id, CAST(heartrate AS DOUBLE) AS hr, CAST(velocity AS DOUBLE) AS v, step, row_number() OVER (PARTITION BY activity_id ORDER BY k) - 1 AS t
  FROM (SELECT *, greatest(n // 600, 1) AS step FROM moved WHERE n >= 120) WHERE k % step = 0 AND k < step * 600),
sorted AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY v, t) AS i FROM thinned),
prefix(activity_id, i, s1, s2) AS (
  SELECT DISTINCT activity_id, CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE FROM sorted
  UNION ALL
  SELECT p.activity_id, s.i, p.s1 + s.v, p.s2 + s.v * s.v FROM prefix p JOIN sorted s ON s.activity_id = p.activity_id AND s.i = p.i + 1),
errors AS MATERIALIZED (
  SELECT a.activity_id, a.i AS x, b.i AS y, (b.s2 - a.s2) - (b.s1 - a.s1) * (b.s1 - a.s1) / CAST(b.i - a.i AS DOUBLE) AS e
  FROM prefix a JOIN prefix b ON a.activity_id = b.activity_id AND a.i < b.i),
d1 AS MATERIALIZED (SELECT activity_id, y AS j, e AS cost, CAST(0 AS BIGINT) AS cut FROM errors WHERE x = 0),"""
    + "".join(_classes(k) for k in range(2, 7))
    + """
sizes AS (
  SELECT s.activity_id, s.m, s.step, greatest(10, 30 // s.step) AS least, d.cost AS whole
  FROM (SELECT activity_id, count(*) AS m, any_value(step) AS step FROM sorted GROUP BY 1) s JOIN d1 d ON d.activity_id = s.activity_id AND d.j = s.m),
tried AS MATERIALIZED (
  SELECT t.*, z.step, list_min(list_transform(range(1, k + 1), lambda p: borders[p + 1] - borders[p])) >= least AS sound
  FROM ("""
    + " UNION ALL ".join(_borders(k) for k in range(2, 7))
    + """) t JOIN sizes z USING (activity_id) WHERE k <= least_of(6, m // least)),
judged AS (
  SELECT *, fit >= 0.85 OR (k >= 3 AND fit - coalesce(lag(fit) OVER (PARTITION BY activity_id ORDER BY k), 0.0) < 0.03) AS stops FROM tried WHERE sound),
stop_at AS (SELECT activity_id, min(k) FILTER (stops) AS stop, max(k) AS last_sound FROM judged GROUP BY 1),
chosen AS (
  SELECT t.activity_id, t.borders, t.k, (SELECT l.fit FROM tried l WHERE l.activity_id = t.activity_id AND l.k = coalesce(s.stop, (SELECT max(k) FROM tried q WHERE q.activity_id = t.activity_id))) AS fit
  FROM tried t LEFT JOIN stop_at s USING (activity_id) WHERE t.k = coalesce(s.stop, s.last_sound, 2)),
labelled AS (SELECT s.*, c.k AS classes, c.fit, len(list_filter(c.borders[2:], lambda b: b < s.i)) AS c FROM sorted s JOIN chosen c USING (activity_id)),
quartiles AS (SELECT activity_id, c, count(*) AS w, quantile_cont(hr, 0.25) AS low, quantile_cont(hr, 0.5) AS mid, quantile_cont(hr, 0.75) AS high FROM labelled GROUP BY 1, 2),
cleaned AS (
  SELECT l.*, w, CASE WHEN w >= 4 AND (hr < low - 2.5 * (high - low) OR hr > high + 2.5 * (high - low)) THEN mid ELSE hr END AS clean
  FROM labelled l JOIN quartiles USING (activity_id, c)),
stretches AS (
  SELECT activity_id, c, min(t) AS a, max(t) + 1 AS b, any_value(step) AS step
  FROM (SELECT *, t - row_number() OVER (PARTITION BY activity_id, c ORDER BY t) AS g FROM labelled) GROUP BY activity_id, c, g
  HAVING count(*) >= greatest(2, 60 // any_value(step))),
numbered AS (SELECT *, row_number() OVER (PARTITION BY activity_id, c ORDER BY a) AS q, count(*) OVER (PARTITION BY activity_id, c) AS r FROM stretches),
halves AS (
  SELECT l.activity_id, l.c, clean, w, l.step, CASE WHEN r = 1 THEN t >= a + (b - a) // 2 ELSE q > greatest(1, r // 2) END AS late
  FROM cleaned l JOIN numbered n ON n.activity_id = l.activity_id AND n.c = l.c AND t >= a AND t < b),
compared AS (
  SELECT activity_id, any_value(w) AS w, median(clean) FILTER (NOT late) AS early, median(clean) FILTER (late) AS late_, count(*) FILTER (late) AS n_late,
    count(*) FILTER (NOT late) AS n_early, any_value(step) AS step FROM halves GROUP BY activity_id, c),
drifts AS (SELECT activity_id, w, (late_ - early) / early * 100.0::DOUBLE AS d FROM compared WHERE n_late >= 5 AND n_early >= 5 AND (n_late + n_early) * step >= 120 AND early > 0),
pooled AS (SELECT activity_id, sum(d * w) / sum(w) AS pct, avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS consistency FROM drifts GROUP BY 1),
covered AS (SELECT activity_id, sum((b - a) * step) AS seconds FROM stretches GROUP BY 1),
drift AS (
  SELECT z.activity_id, round_even(pct, 2) AS cardiac_drift_pct,
    CASE WHEN pct IS NULL THEN NULL WHEN pct < 3 THEN 'stable' WHEN pct < 5 THEN 'borderline' WHEN pct < 8 THEN 'moderate' WHEN pct < 12 THEN 'significant' ELSE 'severe' END AS cardiac_drift_severity,
    coalesce(pct > 0 AND pct >= {limit} AND consistency >= 0.6, false) AS cardiac_drift_significant,
    CASE WHEN pct IS NULL THEN 'low' WHEN seconds >= 600 THEN 'good' WHEN seconds >= 300 THEN 'fair' ELSE 'low' END AS cardiac_drift_quality,
    CAST(c.k AS INTEGER) AS n_classes, round_even(c.fit, 4) AS fit
  FROM sizes z JOIN chosen c USING (activity_id) JOIN acts ON acts.id = z.activity_id LEFT JOIN pooled USING (activity_id) LEFT JOIN covered USING (activity_id))"""
).replace("least_of(6, m // least)", "least(6, m // least)")

#: The threshold of the activity's sport, and that of a run for all.
SPORT_LIMIT = "CASE sport_type " + " ".join(f"WHEN '{s}' THEN {v}" for s, v in DRIFT_THRESHOLDS.items()) + f" ELSE {DRIFT_DEFAULT_THRESHOLD} END"
RUN_LIMIT = str(DRIFT_THRESHOLDS["Run"])
