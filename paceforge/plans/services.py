"""Query services composed of facts and the metric layer."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceforge.constants import EASY_DAY_LOAD, MAX_HORIZON_DAYS
from paceforge.operators.relational import kudos_names
from paceforge.operators.sequence import project
from paceforge.plans.aggregate import AggregateRequest, aggregate, distribution

SCENARIOS = ("rest", "easy", "maintain", "custom")
_EPSILON = 1e-9


def list_workouts(facts: DataFrame, limit: int, start: date | None = None, end: date | None = None, sport: str | None = None) -> DataFrame:
    """Newest first; ``end`` is inclusive; 1 to 200 rows."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 200:
        raise ValueError("limit must be a whole number from 1 to 200")
    rows = facts
    if start:
        rows = rows.filter(F.col("activity_day") >= F.lit(start))
    if end:
        rows = rows.filter(F.col("activity_day") < F.lit(end + timedelta(days=1)))
    if sport:
        rows = rows.filter(F.col("sport_type") == sport)
    return rows.orderBy(F.desc("activity_day"), F.desc("activity_id")).limit(limit)


def page_after(facts: DataFrame, day: date, activity_id: int, limit: int) -> DataFrame:
    """The page below a (day, id) cursor."""
    below = (F.col("activity_day") < F.lit(day)) | ((F.col("activity_day") == F.lit(day)) & (F.col("activity_id") < activity_id))
    return facts.filter(below).orderBy(F.desc("activity_day"), F.desc("activity_id")).limit(limit)


def workout_detail(
    facts: DataFrame, activity_id: int | None = None, hydrated: DataFrame | None = None, kudos: DataFrame | None = None
) -> DataFrame:
    """One activity, or the latest; its newest version.

    ``hydrated``: activities with gear_name and gear_distance_m, which are added; ``kudos``: rows of
    kudos, whose names are added as kudos_names, empty if there are none.
    """
    rows = facts if activity_id is None else facts.filter(F.col("activity_id") == activity_id)
    one = rows.orderBy(F.desc("activity_day"), F.desc("activity_id"), F.desc("metric_version")).limit(1)
    if hydrated is not None:
        gear = hydrated.select(F.col("id").alias("activity_id"), "gear_name", "gear_distance_m")
        one = gear.join(F.broadcast(one), "activity_id", "right").select(*one.columns, "gear_name", "gear_distance_m")
    if kudos is not None:
        own = kudos.join(F.broadcast(one.select("activity_id")), "activity_id", "left_semi")
        one = one.join(kudos_names(own).withColumnRenamed("names", "kudos_names"), "activity_id", "left")
        one = one.withColumn("kudos_names", F.coalesce("kudos_names", F.array().cast("array<string>")))
    return one


#: What a workout shows, with the fact column and scale of each.
WORKOUT_METRICS = (
    ("trimp", "trimp", 1.0),
    ("distance_km", "distance_m", 1 / 1000),
    ("moving_time_min", "moving_time_s", 1 / 60),
    ("elapsed_time_min", "elapsed_time_s", 1 / 60),
    ("elevation_m", "elevation_gain_m", 1.0),
    ("avg_hr", "avg_hr", 1.0),
    ("max_hr", "max_hr", 1.0),
    ("hr_recovery_pauses", "hr_recovery_pause_count", 1.0),
    ("hr_recovery_total_rest_sec", "hr_recovery_total_rest_sec", 1.0),
    ("hr_recovery_median_bpm_per_min", "hr_recovery_median_rate", 1.0),
    ("hr_recovery_best_bpm_per_min", "hr_recovery_best_rate", 1.0),
    ("hr_recovery_worst_bpm_per_min", "hr_recovery_worst_rate", 1.0),
    ("hr_recovery_avg_bpm_per_min", "hr_recovery_avg_rate", 1.0),
    ("vertical_speed_m_per_h", "vertical_speed_vmh", 1.0),
    ("vertical_ascent_m", "vertical_speed_total_ascent_m", 1.0),
    ("vertical_duration_h", "vertical_speed_duration_hours", 1.0),
    ("cardiac_cost", "cardiac_cost", 1.0),
    ("cardiac_cost_adjusted", "adjusted_cardiac_cost", 1.0),
    ("cardiac_drift_pct", "cardiac_drift_pct", 1.0),
    ("cardiac_drift_significant", "cardiac_drift_significant", 1.0),
    ("hrr_pct", "hrr_pct", 1.0),
    ("hr_anomaly_count", "anomaly_count", 1.0),
)


def workout_metrics(facts: DataFrame) -> DataFrame:
    """(activity_id, activity_day, sport_type, one column for each of WORKOUT_METRICS, zone minutes, severity), three decimals.

    A fact column that is not there gives nulls.
    """
    scaled = [
        (F.bround(F.col(c).cast("double") * F.lit(scale), 3) if c in facts.columns else F.lit(None).cast("double")).alias(name)
        for name, c, scale in WORKOUT_METRICS
    ]
    zones = F.array(*[F.bround(F.coalesce(F.col(f"zone{k}_seconds"), F.lit(0)) / 60.0, 3) for k in range(1, 6)])
    severity = F.col("cardiac_drift_severity") if "cardiac_drift_severity" in facts.columns else F.lit(None).cast("string")
    return facts.select(
        "activity_id", "activity_day", "sport_type", *scaled, zones.alias("time_in_hr_zones_min"), severity.alias("cardiac_drift_severity")
    )


def fitness_state(model: DataFrame, rolling: DataFrame, as_of: date | None = None) -> DataFrame:
    """The latest model day up to ``as_of`` with the rolling windows that end on it.

    Medians are there if ``rolling`` has them, as whole_rolling_facts() does.
    """
    rows = model if as_of is None else model.filter(F.col("day") <= F.lit(as_of))
    state = rows.orderBy(F.desc("day")).limit(1).select("day", "fitness", "fatigue", "form", "form_zone", "acwr", "acwr_zone")
    averages = [
        F.bround(F.max(F.when(F.col("window_days") == w, F.col("effective_trimp") / w)), 3).alias(f"daily_avg_trimp_{w}d")
        for w in (7, 28, 90)
    ]
    volumes = [
        F.max(F.when(F.col("window_days") == w, F.col(c) / F.lit(scale))).alias(f"{name}_{w}d")
        for w in (7, 28)
        for c, name, scale in (("activity_count", "volume", 1), ("distance_m", "distance_km", 1000.0))
    ]
    sums = [
        F.bround(F.max(F.when(F.col("window_days") == w, F.col(c) / F.lit(scale))), 3).alias(name)
        for name, w, c, scale in (
            ("weekly_trimp", 7, "effective_trimp", 1),
            ("total_trimp_14d", 14, "effective_trimp", 1),
            ("avg_trimp_per_day", 14, "effective_trimp", 14),
            ("active_days", 14, "active_days", 1),
            ("rest_days", 14, "rest_days", 1),
            ("rolling_median_cc", 90, "median_cardiac_cost", 1),
            ("rolling_median_cc_adj", 90, "median_adjusted_cardiac_cost", 1),
            ("rolling_median_hr_recovery", 90, "median_hr_recovery", 1),
            ("rolling_median_cardiac_drift_pct", 90, "median_cardiac_drift_pct", 1),
        )
        if c in rolling.columns
    ]
    own = rolling.filter(F.col("scope") == "all")
    rolled = own.groupBy(F.col("as_of_day").alias("day")).agg(*averages, *volumes, *sums)
    return state.join(rolled, "day", "left")


def compare_periods(
    sources: dict[str, DataFrame], request: AggregateRequest, other: tuple[date, date], pct_decimals: int | None = 2
) -> DataFrame:
    """Each metric in the request's range (a) against ``other`` (b), both half-open.

    delta = a - b to three decimals, from which pct, against b, and trend (up, down or flat) follow; coverage 0, 0.5
    or 1 a side; sample sizes and counts of both, what is missing on either, and whether they mix versions.
    ``pct_decimals``: None leaves pct as it is, for who rounds it otherwise; a rounded one must not be rounded again.
    """
    side = lambda r, x: aggregate(sources, r).select(
        "metric_id",
        "scope",
        "sport_type",
        F.col("value").alias(f"value_{x}"),
        F.col("sample_size").alias(f"sample_size_{x}"),
        F.col("activity_count").alias(f"activity_count_{x}"),
        F.col("missing_reasons").alias(f"missing_{x}"),
        F.col("metric_version_status").alias(f"versions_{x}"),
        F.when(F.col("completeness_status") == "unavailable", 0.0)
        .when(F.col("completeness_status") == "partial", 0.5)
        .otherwise(1.0)
        .alias(f"coverage_{x}"),
    )
    b_request = AggregateRequest(**{**request.__dict__, "start": other[0], "end": other[1]})
    a, b = side(request, "a").alias("a"), side(b_request, "b").alias("b")
    on = (F.col("a.metric_id") == F.col("b.metric_id")) & (F.col("a.scope") == F.col("b.scope")) & F.col("a.sport_type").eqNullSafe(F.col("b.sport_type"))
    joined = a.join(b, on, "full_outer")
    delta = F.bround(F.col("value_a") - F.col("value_b"), 3)
    pct = delta / F.nullif(F.col("value_b"), F.lit(0.0)) * 100.0
    none = F.array().cast("array<string>")
    versions = F.array_compact(F.array("versions_a", "versions_b"))
    version_status = (
        F.when(F.array_contains(versions, "mixed_degraded"), "mixed_degraded")
        .when(F.array_contains(versions, "mixed_allowed"), "mixed_allowed")
        .when(F.size(F.array_distinct(versions)) == 1, versions[0])
        .otherwise("mixed_degraded")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        F.coalesce("a.metric_id", "b.metric_id").alias("metric_id"),
        F.coalesce("a.scope", "b.scope").alias("scope"),
        F.coalesce("a.sport_type", "b.sport_type").alias("sport_type"),
        "value_a",
        "value_b",
        delta.alias("delta"),
        (pct if pct_decimals is None else F.bround(pct, pct_decimals)).alias("delta_pct"),
        F.when(F.abs(delta) < _EPSILON, "flat").when(delta > 0, "up").when(delta < 0, "down").otherwise("unavailable").alias("trend"),
        F.coalesce("coverage_a", F.lit(0.0)).alias("coverage_a"),
        F.coalesce("coverage_b", F.lit(0.0)).alias("coverage_b"),
        *[zero(f"{c}_{x}") for c in ("sample_size", "activity_count") for x in "ab"],
        F.array_sort(F.array_union(F.coalesce("missing_a", none), F.coalesce("missing_b", none))).alias("missing_reasons"),
        version_status.alias("metric_version_status"),
    )


def compare_distributions(sources: dict[str, DataFrame], request: AggregateRequest, other: tuple[date, date]) -> DataFrame:
    """Change of each category's amount between two ranges, and how much of the two distributions overlaps.

    delta_pct is against b, null where b has none; overlap_pct is the common amount
    over the larger total, null if a range is empty.
    """
    b_request = AggregateRequest(**{**request.__dict__, "start": other[0], "end": other[1]})
    side = lambda r, x: distribution(sources, r).groupBy("metric_id", "category").agg(F.sum("amount").alias(f"amount_{x}"))
    joined = side(request, "a").join(side(b_request, "b"), ["metric_id", "category"], "full_outer").fillna(0.0)
    delta = F.bround(F.col("amount_a") - F.col("amount_b"), 3)
    every = Window.partitionBy("metric_id")  # one row a category
    total_a, total_b = F.sum("amount_a").over(every), F.sum("amount_b").over(every)
    common = F.sum(F.least("amount_a", "amount_b")).over(every)
    return joined.select(
        "*",
        delta.alias("delta"),
        F.bround(delta / F.when(F.col("amount_b") != 0, F.col("amount_b")) * 100.0, 2).alias("delta_pct"),
        F.when((total_a > 0) & (total_b > 0), F.bround(common / F.greatest(total_a, total_b) * 100.0, 2)).alias("overlap_pct"),
    )


def validated_custom(rows: list[dict], today: date, target: date) -> dict[date, float]:
    """Days of a custom plan: rising, within the horizon, loads of 0 or more."""
    out: dict[date, float] = {}
    before: date | None = None
    for row in rows:
        day, load = date.fromisoformat(str(row["date"])), row["trimp"]
        if isinstance(load, bool) or not isinstance(load, (int, float)) or load < 0:
            raise ValueError("a load must be a number of 0 or more")
        if not today <= day <= target:
            raise ValueError("a custom day lies outside the horizon")
        if before is not None and day <= before:
            raise ValueError("custom days must rise")
        out[day] = float(load)
        before = day
    return out


def projection(
    daily: DataFrame,
    model: DataFrame,
    today: date,
    target: date,
    scenarios: tuple[str, ...] = ("rest", "easy", "maintain"),
    custom: list[dict] | None = None,
) -> DataFrame:
    """Each scenario's state from today to the target, both included, from the latest stored state.

    ``maintain`` trains, on weekdays that had load in the last 28 days, at the mean of those days' loads.
    """
    if unknown := [s for s in scenarios if s not in SCENARIOS]:
        raise ValueError(f"unknown scenarios: {', '.join(unknown)}")
    horizon = (target - today).days
    if not 0 <= horizon <= MAX_HORIZON_DAYS:
        raise ValueError(f"the target must lie 0 to {MAX_HORIZON_DAYS} days ahead")
    spark = daily.sparkSession
    plan_days = validated_custom(custom or [], today, target) if "custom" in scenarios else {}
    days = spark.range(horizon + 1).select(F.date_add(F.lit(today), F.col("id").cast("int")).alias("day"))
    recent = daily.filter((F.col("day") > F.lit(today - timedelta(days=28))) & (F.col("day") <= F.lit(today)) & (F.col("effective_trimp") > 0))
    habit = recent.agg(
        F.coalesce(F.bround(F.sum(F.rint(F.col("effective_trimp") * 10)) / (F.count(F.lit(1)) * 10.0), 2), F.lit(0.0)).alias("mean"), F.collect_set(F.dayofweek("day")).alias("weekdays")
    )
    start = model.filter(F.col("day") <= F.lit(today)).orderBy(F.desc("day")).limit(1)
    start = start.select(F.col("fitness").alias("start_fitness"), F.col("fatigue").alias("start_fatigue"))
    planned = F.create_map(*[x for d, v in plan_days.items() for x in (F.lit(d), F.lit(v))]) if plan_days else None
    loads = {
        "rest": F.lit(0.0),
        "easy": F.lit(EASY_DAY_LOAD),
        "maintain": F.when(F.array_contains("weekdays", F.dayofweek("day")), F.col("mean")).otherwise(0.0),
        "custom": F.coalesce(planned[F.col("day")], F.lit(0.0)) if planned is not None else F.lit(0.0),
    }
    table = F.array(*[F.struct(F.lit(s).alias("scenario"), loads[s].alias("load")) for s in scenarios])
    rows = days.join(F.broadcast(habit)).join(F.broadcast(start), how="left")  # one row each
    rows = rows.select("day", F.coalesce("start_fitness", F.lit(0.0)).alias("start_fitness"),
                       F.coalesce("start_fatigue", F.lit(0.0)).alias("start_fatigue"), F.inline(table))
    return project(rows)


def next_monday_form(projected: DataFrame, target: date) -> DataFrame:
    """(scenario, day, form): the form on the Monday after a target from Friday to Sunday, if the days between are rest.

    ``projected`` comes from projection() to the same target; no rows for another weekday.
    """
    last = projected.filter(F.col("day") == F.lit(target)) if target.weekday() >= 4 else projected.limit(0)
    between = F.sequence(F.lit(target + timedelta(days=1)), F.lit(target + timedelta(days=7 - target.weekday())))
    plans = last.select(
        "scenario",
        F.explode(between).alias("day"),
        F.lit(0.0).alias("load"),
        F.col("fitness").alias("start_fitness"),
        F.col("fatigue").alias("start_fatigue"),
    )
    monday = F.col("day") == F.lit(target + timedelta(days=7 - target.weekday()))
    return project(plans).filter(monday).select("scenario", "day", "form")


def historical_context(daily: DataFrame, facts: DataFrame, metric_version: int = 1) -> DataFrame:
    """Streaks and days since the last hike for each day of one version."""
    from paceforge.operators.sequence import days_since, streaks

    days = daily.filter((F.col("metric_version") == metric_version) & (F.col("scope") == "all"))
    hikes = facts.filter((F.col("sport_type") == "Hike") & (F.col("metric_version") == metric_version))
    out = days.select("day", "metric_version", "completeness_status", "missing_reasons", "activity_count")
    return out.join(streaks(days), "day").join(days_since(days, hikes, "last_hike_days_ago"), "day")


def bundle(sources: dict[str, DataFrame], name: str, **request) -> DataFrame:
    """A bundle's single-valued metrics in one table; distributions are asked for with distribution()."""
    return aggregate(sources, AggregateRequest(bundle=name, **request))


def freshness(states: DataFrame, now: str) -> DataFrame:
    """The state of each mirror: in_progress, delayed, failed within the hour, fresh, aging, stale.

    ``states``: running, delayed_until, last_failure_at, last_success_at as timestamps or null.
    """
    at = F.lit(now).cast("timestamp")
    age = F.unix_timestamp(at) - F.unix_timestamp("last_success_at")
    failed = F.unix_timestamp(at) - F.unix_timestamp("last_failure_at")
    newer = F.col("last_failure_at") > F.coalesce("last_success_at", F.lit("1970-01-01").cast("timestamp"))
    state = (
        F.when(F.col("running"), "in_progress")
        .when(F.col("delayed_until") > at, "delayed")
        .when(newer & (failed <= 3600), "failed")
        .when(age < 12 * 3600, "fresh")
        .when(age < 24 * 3600, "aging")
        .otherwise("stale")
    )
    return states.select("*", state.alias("freshness"))
