"""The fact tiers: activity, day, model state, rolling windows."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceforge.constants import MIN_ALTITUDE_POINTS, MIN_STREAM_POINTS, RESTING_HR, ROLLING_WINDOWS, WALK_DISCOUNT
from paceforge.functions.scalars import acwr, acwr_zone, form_zone
from paceforge.functions.zones import DEFAULT_MODEL, banded_load, banded_rates, karvonen, load_of, zone_bounds
from paceforge.operators.sequence import day_spine, day_window, load_model
from paceforge.operators.drift import cardiac_drift
from paceforge.operators.streams import (
    adjusted_cardiac_cost,
    as_tier,
    heart_rate_tier,
    hrr_pct,
    pauses,
    recovery,
    running_max_hr,
    vertical_speed,
    zoned,
)


def activity_facts(
    activities: DataFrame,
    samples: DataFrame,
    hr_rest: int = RESTING_HR,
    metric_version: int = 1,
    only: DataFrame | None = None,
    ordered: bool = True,
    tier: DataFrame | None = None,
    zone_model: str = DEFAULT_MODEL,
) -> DataFrame:
    """One row for each activity and version.

    ``zone_model``: the name of the limits by which zones and load are told.
    ``tier``: heart_rate_tier() of the samples, if it is stored; else it is part of the plan.
    ``only``: activity_id of those to compute; the highest heart rate of a day still counts all.
    ``ordered``: with recovery, vertical speed and drift, which need each activity's samples in order;
    without them the samples are only aggregated.  Summary columns that the activities lack
    (avg_hr, max_hr, start_time_local, source_hash, source_revision) are null.
    """
    stored_tier = tier
    tier = heart_rate_tier(samples) if tier is None else tier
    days = running_max_hr(activities, tier)
    if only is not None:
        wanted = only.select(F.col("activity_id").alias("id"))
        activities = activities.join(wanted, "id", "left_semi")
        samples = samples.join(only.select("activity_id"), "activity_id", "left_semi")
    summary = {c: activities[c] if c in activities.columns else F.lit(None).cast(t) for c, t in _SUMMARY.items()}
    base = activities.withColumns({f"summary_{c}": v for c, v in summary.items()}).drop(*_SUMMARY)
    scalars = tier.withColumnRenamed("activity_id", "id")
    rated = base.join(F.broadcast(days), "activity_day", "left").join(scalars, "id", "left")
    f = zoned(rated, hr_rest, (*base.columns, *[c for c in scalars.columns if c not in ("id", "rates")]), zone_model)
    if ordered:
        f = f.join(ordered_measures(activities, samples, stored_tier).withColumnRenamed("activity_id", "id"), "id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    no_streams, no_hr = count("stream_count") == 0, count("hr_count") == 0
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("has_detail"), "missing_details"),
            F.when(no_streams, "missing_streams"),
            F.when(no_hr, "missing_hr"),
        )
    )
    status = F.when(no_streams, "unknown").when(no_hr | ~F.col("has_detail"), "partial").otherwise("complete")
    return f.select(
        F.col("id").alias("activity_id"),
        "activity_day",
        "sport_type",
        F.lit(metric_version).cast("long").alias("metric_version"),
        status.alias("completeness_status"),
        reasons.alias("missing_reasons"),
        F.coalesce("trimp", F.lit(0.0)).alias("trimp"),
        *[count(f"zone{k}_seconds").alias(f"zone{k}_seconds") for k in range(1, 6)],
        "cardiac_cost",
        adjusted_cardiac_cost(F.col("cardiac_cost"), F.col("distance_m"), F.col("elevation_gain_m")).alias("adjusted_cardiac_cost"),
        hrr_pct(F.col("median_hr"), hr_rest, F.col("max_hr")).alias("hrr_pct"),
        F.lit(0).cast("long").alias("anomaly_count"),
        "distance_m",
        "calories_kcal",
        "moving_time_s",
        "elapsed_time_s",
        "elevation_gain_m",
        "kudos_count",
        count("hr_count").alias("heartrate_sample_count"),
        count("stream_count").alias("stream_sample_count"),
        F.col("min_hr").alias("observed_min_hr"),
        F.col("max_hr").alias("observed_max_hr"),
        F.lit(zone_model).alias("hr_zone_model"),
        "hr_max_used",
        F.lit(hr_rest).alias("hr_rest_used"),
        *[F.col(f"summary_{c}").alias(c) for c in _SUMMARY],
        *([F.coalesce(c, F.lit(v)).alias(c) if v is not None else F.col(c) for c, v in _ORDERED.items()] if ordered else []),
    )


_SUMMARY = {"avg_hr": "double", "max_hr": "double", "start_time_local": "string", "source_hash": "string", "source_revision": "long"}

#: Columns of ordered_measures(), with what stands for none found.
_ORDERED = {
    "hr_recovery_pause_count": 0,
    "hr_recovery_total_rest_sec": 0,
    "hr_recovery_median_rate": None,
    "hr_recovery_best_rate": None,
    "hr_recovery_worst_rate": None,
    "hr_recovery_avg_rate": None,
    "vertical_speed_vmh": None,
    "vertical_speed_total_ascent_m": None,
    "vertical_speed_duration_hours": None,
    "cardiac_drift_pct": None,
    "cardiac_drift_severity": None,
    "cardiac_drift_significant": False,
    "cardiac_drift_quality": None,
}


#: So many ids are broadcast; more are joined by a shuffle.
_BROADCAST_IDS = 1_000_000


def _long_enough(samples: DataFrame, tier: DataFrame) -> DataFrame:
    """The samples of activities that have enough of them for a measure of their order, by the counts of the stored tier.

    The others are neither shuffled nor sorted; no measure tells anything of them.
    """
    ids = tier.filter(F.col("stream_count") >= min(MIN_ALTITUDE_POINTS, MIN_STREAM_POINTS)).select("activity_id")
    few = ids.limit(_BROADCAST_IDS + 1).count() <= _BROADCAST_IDS
    return samples.join(F.broadcast(ids) if few else ids, "activity_id", "left_semi")


def ordered_measures(activities: DataFrame, samples: DataFrame, tier: DataFrame | None = None) -> DataFrame:
    """Recovery, vertical speed and drift of the activities that have enough samples for one of them.

    ``tier``: heart_rate_tier() of the samples, if it is stored: then only samples of such activities are ordered.
    """
    samples = samples if tier is None else _long_enough(samples, tier)
    rested = recovery(pauses(samples))
    rested = rested.select(
        "activity_id", *[F.col(c).alias(f"hr_recovery_{c}") for c in rested.columns if c != "activity_id"]
    )
    climbs = vertical_speed(samples).filter("vmh IS NOT NULL").select(
        "activity_id",
        F.col("vmh").alias("vertical_speed_vmh"),
        F.col("total_ascent_m").alias("vertical_speed_total_ascent_m"),
        F.col("duration_hours").alias("vertical_speed_duration_hours"),
    )
    drifts = cardiac_drift(samples, activities.select(F.col("id").alias("activity_id"), "sport_type")).drop("n_classes", "fit")
    return rested.join(climbs, "activity_id", "full_outer").join(drifts, "activity_id", "full_outer")


def session_bounds(samples: DataFrame, hr_rest: int = RESTING_HR) -> list[int]:
    """Zone limits by the highest heart rate of all samples, or of their tier."""
    top = samples.agg(F.max("max_hr" if "rates" in samples.columns else "heartrate")).first()[0]
    return karvonen(int(top) if top is not None and top > hr_rest else hr_rest + 1, hr_rest)


def activity_loads(activities: DataFrame, samples: DataFrame, hr_rest: int = RESTING_HR, top: int | None = None, zone_model: str = DEFAULT_MODEL) -> DataFrame:
    """(id, activity_day, sport_type, points, hr_points, load) by one set of limits: those of the highest rate of all.

    ``samples``: those or their tier; ``top``: the highest rate, if these are not all.  An activity without samples has nulls.
    """
    tier = as_tier(samples)
    rated = activities.select("id", "activity_day", "sport_type").join(tier, F.col("id") == F.col("activity_id"), "left")
    top_row = tier.agg(F.max("max_hr").alias("top")) if top is None else tier.sparkSession.range(1).select(F.lit(top).alias("top"))
    top_row = top_row.select(F.greatest(F.coalesce("top", F.lit(0)), F.lit(hr_rest + 1)).alias("top"))
    limits = top_row.select(*[b.alias(f"b{k}") for k, b in enumerate(zone_bounds(F.col("top"), hr_rest, zone_model))])  # one row
    load = banded_load(banded_rates(F.col("rates"), [F.col(f"b{k}") for k in range(5)]))
    return rated.join(F.broadcast(limits)).select(
        "id", "activity_day", "sport_type", F.col("stream_count").alias("points"), F.col("hr_count").alias("hr_points"), load.alias("load")
    )


def daily_trimp(activities: DataFrame, samples: DataFrame, hr_rest: int = RESTING_HR, by_sport: bool = False) -> DataFrame:
    """Load of each day (and sport) that has samples, by one set of limits, one decimal; ``samples``: those or their tier."""
    keys = ["activity_day", "sport_type"] if by_sport else ["activity_day"]
    rows = activity_loads(activities, samples, hr_rest).filter("points IS NOT NULL")
    return rows.groupBy(*keys).agg(load_of(F.sum("load")).alias("trimp"))


def daily_load(
    activities: DataFrame,
    samples: DataFrame,
    hr_rest: int = RESTING_HR,
    until: date | None = None,
    since: date | None = None,
    top: int | None = None,
    zone_model: str = DEFAULT_MODEL,
) -> DataFrame:
    """Every day from the first to the last: status, counts, observed and effective load.

    Days without activities are REST, without samples UNKNOWN, without heart rate
    PARTIAL, else OBSERVED.  ``samples``: those or their tier.  ``until``: the day that is
    today; days run to it, or to the last activity if that is later.  ``since``: the first
    day wanted; ``top``: the highest heart rate of all, where earlier samples are not among these.
    """
    if since is not None:
        activities = activities.filter(F.col("activity_day") >= F.lit(since))
    joined = activity_loads(activities, samples, hr_rest, top, zone_model)
    by_sport = joined.groupBy("activity_day", "sport_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("points"), F.lit(0)).alias("points"),
        F.coalesce(F.sum("hr_points"), F.lit(0)).alias("hr_points"),
        F.coalesce(F.sum("load"), F.lit(0.0)).alias("load"),
    )
    # tenths of load as whole numbers: their weighted sum is exact, and rounded once
    tenths = F.rint(load_of(F.col("load")) * 10)
    factor = F.when(F.col("sport_type") == "Walk", WALK_DISCOUNT).otherwise(1.0)
    days = by_sport.groupBy(F.col("activity_day").alias("day")).agg(
        F.sum("n").alias("activity_count"),
        F.sum("points").alias("stream_points"),
        F.sum("hr_points").alias("heartrate_points"),
        load_of(F.sum("load")).alias("observed"),
        F.bround(F.sum(tenths * factor) / 10.0, 1).alias("effective"),
    )
    out = day_spine(activities.withColumnRenamed("activity_day", "day"), until=until, since=since).join(days, "day", "left").fillna(
        0, ["activity_count", "stream_points", "heartrate_points"]
    )
    status = (
        F.when(F.col("activity_count") == 0, "REST")
        .when(F.col("stream_points") == 0, "UNKNOWN")
        .when(F.col("heartrate_points") == 0, "PARTIAL")
        .otherwise("OBSERVED")
    )
    return out.select(
        "day",
        status.alias("status"),
        "activity_count",
        "stream_points",
        "heartrate_points",
        F.when(status == "OBSERVED", F.col("observed")).alias("observed_trimp"),
        F.when(status == "OBSERVED", F.col("effective")).otherwise(0.0).alias("effective_trimp"),
    )


def daily_facts(load: DataFrame, facts: DataFrame, metric_version: int = 1) -> DataFrame:
    """Daily load with the day's sums of activity facts."""
    sums = (
        facts.filter(F.col("metric_version") == metric_version)
        .groupBy(F.col("activity_day").alias("day"))
        .agg(
            F.sum("distance_m").alias("distance_m"),
            F.sum("moving_time_s").alias("moving_time_s"),
            F.sum("elevation_gain_m").alias("elevation_gain_m"),
            F.sum("zone4_seconds").alias("zone4_seconds"),
            F.sum("zone5_seconds").alias("zone5_seconds"),
            F.sum("anomaly_count").alias("anomaly_count"),
        )
    )
    out = load.join(sums, "day", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    reasons = F.when(F.col("status") == "UNKNOWN", F.array(F.lit("missing_streams"))).when(
        F.col("status") == "PARTIAL", F.array(F.lit("missing_hr"))
    )
    return out.select(
        "day",
        F.lit("all").alias("scope"),
        F.lit("all").alias("sport_type"),
        F.lit(metric_version).cast("long").alias("metric_version"),
        F.lower("status").alias("completeness_status"),
        F.coalesce(reasons, F.array().cast("array<string>")).alias("missing_reasons"),
        "activity_count",
        F.col("stream_points").alias("stream_point_count"),
        F.col("heartrate_points").alias("heartrate_point_count"),
        "observed_trimp",
        "effective_trimp",
        F.coalesce("distance_m", F.lit(0.0)).alias("distance_m"),
        zero("moving_time_s").alias("moving_time_s"),
        F.coalesce("elevation_gain_m", F.lit(0.0)).alias("elevation_gain_m"),
        zero("zone4_seconds").alias("zone4_seconds"),
        zero("zone5_seconds").alias("zone5_seconds"),
        (zero("zone4_seconds") + zero("zone5_seconds")).alias("high_zone_seconds"),
        zero("anomaly_count").alias("anomaly_count"),
    )


def model_facts(daily: DataFrame, metric_version: int = 1, seed: tuple[date, float, float] | None = None) -> DataFrame:
    """Fitness, fatigue, form and their zones for each day of ``daily``.

    ``seed``: the stored (day, fitness, fatigue) before the first of them; without it the fold begins at zero.
    """
    states = load_model(daily.select("day", F.col("effective_trimp").alias("load")), seed=seed)
    states = states.join(daily.select("day"), "day", "left_semi")
    form = F.col("fitness") - F.col("fatigue")
    ratio = acwr(F.col("fatigue"), F.col("fitness"))
    return states.select(
        "day",
        F.lit("all").alias("scope"),
        F.lit("all").alias("sport_type"),
        F.lit(metric_version).cast("long").alias("metric_version"),
        F.lit("complete").alias("completeness_status"),
        F.array().cast("array<string>").alias("missing_reasons"),
        F.col("load").alias("effective_trimp"),
        F.col("load").alias("observed_trimp"),
        "fitness",
        "fatigue",
        form.alias("form"),
        form_zone(form).alias("form_zone"),
        ratio.alias("acwr"),
        acwr_zone(ratio).alias("acwr_zone"),
        F.col("fatigue").alias("load_7d"),
        F.lit(None).cast("double").alias("load_28d"),
        F.col("fitness").alias("load_42d"),
    )


_ROLLED = ("observed_trimp", "effective_trimp", "distance_m", "moving_time_s", "elevation_gain_m", "high_zone_seconds", "anomaly_count")


#: Medians of the windows, and the activity fact that each is of.
_MEDIANS = {
    "median_cardiac_cost": "cardiac_cost",
    "median_adjusted_cardiac_cost": "adjusted_cardiac_cost",
    "median_hr_recovery": "hr_recovery_median_rate",
    "median_cardiac_drift_pct": "cardiac_drift_pct",
}


def first_days(facts: DataFrame) -> DataFrame:
    """(sport_type, first): the first activity day of each sport."""
    return facts.groupBy("sport_type").agg(F.min("activity_day").alias("first"))


def sport_days(daily: DataFrame, facts: DataFrame, metric_version: int = 1, firsts: DataFrame | None = None) -> DataFrame:
    """Each sport's sums for every day from its first activity to the last day of ``daily``, zeros included.

    ``firsts``: first_days() of all facts, where these begin later: then the days of ``daily`` are the sport's.
    """
    own = facts.filter(F.col("metric_version") == metric_version)
    ends = daily.agg(F.max("day").alias("last"), F.min("day").alias("least"))  # one row
    begins = (first_days(own) if firsts is None else firsts).join(F.broadcast(ends)).withColumn("first", F.greatest("first", "least"))
    days = begins.filter("first <= last").select("sport_type", F.explode(F.sequence("first", "last")).alias("day"))
    tenths = F.sum(F.rint(F.col("trimp") * 10))
    factor = F.when(F.col("sport_type") == "Walk", WALK_DISCOUNT).otherwise(1.0)
    sums = own.groupBy("sport_type", F.col("activity_day").alias("day")).agg(
        F.count(F.lit(1)).alias("activity_count"),
        (tenths / 10.0).alias("observed_trimp"),
        F.sum("distance_m").alias("distance_m"),
        F.sum("moving_time_s").alias("moving_time_s"),
        F.sum("elevation_gain_m").alias("elevation_gain_m"),
        F.sum(F.col("zone4_seconds") + F.col("zone5_seconds")).alias("high_zone_seconds"),
        F.sum("anomaly_count").alias("anomaly_count"),
    )
    names = [c for c in sums.columns if c not in ("sport_type", "day")]
    return days.join(sums, ["sport_type", "day"], "left").fillna(0, names).select(
        "day",
        F.lit("sport").alias("scope"),
        "sport_type",
        F.lit(metric_version).cast("long").alias("metric_version"),
        (F.col("observed_trimp") * factor).alias("effective_trimp"),
        *names,
    )


def window_medians(
    facts: DataFrame, windows: tuple[int, ...] = ROLLING_WINDOWS, between: tuple[date, date] | None = None
) -> DataFrame:
    """Exact medians, three decimals, of the windows that end on each day: of all activities and of each sport.

    ``between``: first and last of the days wanted; None computes all.  A day is counted first, to a map of
    its distinct values.  Days are dealt into spans as long as the longest window, and a day's map goes to its own
    span and the next, whatever the windows; there each window's map slides along the days, taking up the day that comes
    and giving back the one that goes.  A group holds the distinct values of two spans, however many activities they have.
    """
    span = max(windows)
    if between:
        facts = facts.filter(F.col("activity_day").between(F.lit(between[0] - timedelta(days=span - 1)), F.lit(between[1])))
    kinds = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).cast("double").alias("value")) for m, c in _MEDIANS.items()])
    scopes = F.array(F.struct(F.lit("all").alias("scope"), F.lit("all").alias("sport")), F.struct(F.lit("sport").alias("scope"), F.col("sport_type").alias("sport")))
    values = facts.select("activity_day", "sport_type", "metric_version", F.inline(kinds)).filter("value IS NOT NULL")
    values = values.select("activity_day", "metric_version", "measure", "value", F.inline(scopes))
    keys = ["scope", "sport", "metric_version", "measure"]
    counted = values.groupBy(*keys, "activity_day", "value").agg(F.count(F.lit(1)).alias("n"))
    day = F.datediff("activity_day", F.lit("1970-01-01").cast("date"))
    own = F.floor(day / F.lit(span))
    dealt = counted.select(*keys, day.alias("day"), "value", "n", F.explode(F.array(own, own + 1)).alias("span"))
    def of_span(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _window_medians_of_span(key, rows, tuple(windows))

    found = dealt.groupBy(*keys, "span").applyInPandas(
        of_span,
        "scope string, sport string, metric_version long, measure string, as_of long, window_days int, median double",
    )
    as_of = F.date_add(F.lit("1970-01-01").cast("date"), F.col("as_of").cast("int"))
    flat = found.withColumns({"as_of_day": as_of, "median": F.bround("median", 3)})
    if between:
        flat = flat.filter(F.col("as_of_day").between(F.lit(between[0]), F.lit(between[1])))
    return flat.groupBy("as_of_day", "scope", F.col("sport").alias("sport_type"), "metric_version", "window_days").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("median"))).alias(m) for m in _MEDIANS]
    )


def _window_medians_of_span(key: tuple, rows: pd.DataFrame, windows: tuple[int, ...]) -> pd.DataFrame:
    """Medians of the windows that end in one span, from the counts of its days and of those of the span before."""
    length = max(windows)
    first = int(key[-1]) * length  # the span's first day
    rows = rows.sort_values("day")
    values, place = np.unique(rows["value"].to_numpy(float), return_inverse=True)
    n, days = rows["n"].to_numpy(np.int64), rows["day"].to_numpy(np.int64)
    counts = {w: np.zeros(len(values), np.int64) for w in windows}
    found = []

    def of_day(day: int) -> slice:
        return slice(*np.searchsorted(days, (day, day + 1)))

    for day in range(first - length + 1, first + length):
        comes = of_day(day)
        for w, own in counts.items():
            goes = of_day(day - w)
            own[place[comes]] += n[comes]  # a day has each value once
            own[place[goes]] -= n[goes] if day - w > first - length else 0
            if day >= first and (total := int(own.sum())):
                upto = own.cumsum()
                low, high = values[np.searchsorted(upto, ((total - 1) // 2, total // 2), side="right")]
                found.append((day, w, 0.5 * low + 0.5 * high))
    out = pd.DataFrame(found, columns=["as_of", "window_days", "median"])
    for name, value in reversed(list(zip(("scope", "sport", "metric_version", "measure"), key))):
        out.insert(0, name, value)
    return out


def whole_rolling_facts(
    daily: DataFrame,
    facts: DataFrame,
    model: DataFrame,
    windows: tuple[int, ...] = ROLLING_WINDOWS,
    metric_version: int = 1,
    between: tuple[date, date] | None = None,
    firsts: DataFrame | None = None,
) -> DataFrame:
    """rolling_facts() of all activities and of each sport, with medians, and the load model's state on rows of all.

    ``between``: first and last of the days wanted; None gives all.  ``firsts``: first_days() of all facts, where
    these and ``daily`` hold no more than the longest window needs.
    """
    own = facts.filter(F.col("metric_version") == metric_version)
    by_sport = sport_days(daily, own, metric_version, firsts)
    rows = rolling_facts(daily, windows).unionByName(rolling_facts(by_sport, windows))
    if between:
        rows = rows.filter(F.col("as_of_day").between(F.lit(between[0]), F.lit(between[1])))
    keys = ["as_of_day", "scope", "sport_type", "metric_version"]
    state = model.select(F.col("day").alias("as_of_day"), *keys[1:], "fitness", "fatigue", "form", "form_zone", "acwr", "acwr_zone")
    return rows.join(state, keys, "left").join(window_medians(own, windows, between), [*keys, "window_days"], "left")


def rolling_facts(daily: DataFrame, windows: tuple[int, ...] = ROLLING_WINDOWS) -> DataFrame:
    """Totals of the closed windows that end on each day, one row for each day and window."""
    day, _ = day_window(F.col("day"), 1)
    rows = daily.withColumn("epoch", day)
    order = Window.partitionBy("scope", "sport_type", "metric_version").orderBy("epoch")
    wide = []
    for w in windows:
        frame = order.rangeBetween(-(w - 1), 0)
        wide.append(
            F.struct(
                F.lit(w).alias("window_days"),
                F.sum("activity_count").over(frame).alias("activity_count"),
                F.sum(F.when(F.col("activity_count") > 0, 1).otherwise(0)).over(frame).alias("active_days"),
                F.sum(F.when(F.col("activity_count") == 0, 1).otherwise(0)).over(frame).alias("rest_days"),
                *[F.coalesce(F.sum(c).over(frame), F.lit(0)).cast(dict(daily.dtypes)[c]).alias(c) for c in _ROLLED],
            )
        )
    out = rows.select(F.col("day").alias("as_of_day"), "scope", "sport_type", "metric_version", F.array(*wide).alias("w"))
    return out.select(
        "as_of_day",
        "scope",
        "sport_type",
        "metric_version",
        F.lit("complete").alias("completeness_status"),
        F.array().cast("array<string>").alias("missing_reasons"),
        F.inline("w"),
    )


def rolling_medians(facts: DataFrame, as_of, windows: tuple[int, ...] = ROLLING_WINDOWS, by_sport: bool = False) -> DataFrame:
    """Exact medians of the efficiency measures in the windows that end on ``as_of``, three decimals.

    One pass: each window is a condition inside the aggregate.
    """
    keys = ["sport_type"] if by_sport else []
    age = F.datediff(F.lit(as_of).cast("date"), "activity_day")
    rows = facts.withColumn("age", age).filter((F.col("age") >= 0) & (F.col("age") < max(windows)))
    columns = ("cardiac_cost", "adjusted_cardiac_cost", "hrr_pct")
    per_window = [
        F.struct(
            F.lit(w).alias("window_days"),
            *[F.bround(F.median(F.when(F.col("age") < w, F.col(c))), 3).alias(f"median_{c}") for c in columns],
        )
        for w in windows
    ]
    return rows.groupBy(*keys).agg(F.array(*per_window).alias("w")).select(*keys, F.inline("w"))
