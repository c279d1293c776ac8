"""Per-activity measures from sensor samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceforge.constants import (
    ELEVATION_COEFFICIENT,
    MAX_PAUSE_GAP_S,
    MIN_ALTITUDE_POINTS,
    MIN_CLIMB_HOURS,
    MIN_PAUSE_S,
    MIN_STREAM_POINTS,
    MOVING_VELOCITY,
    STOP_VELOCITY,
)
from paceforge.functions.zones import DEFAULT_MODEL, banded_load, banded_rates, load_of, zone_bounds


def heart_rate_tier(samples: DataFrame, min_velocity: float = MOVING_VELOCITY) -> DataFrame:
    """One row for each activity with all that its heart rates are asked for: the only scan of samples that needs no order.

    stream_count, hr_count, min_hr, max_hr, cardiac_cost, median_hr, and ``rates``, the seconds at each rate.
    Samples are counted by (activity, rate) before anything else, so what is shuffled does not
    grow with an activity's length, and bounds, zones, loads and day maxima come from this table.
    The median is told from an activity's sorted (rate, seconds), which are collected anyway: the only list of the aggregate.
    """
    moving = F.col("heartrate").isNotNull() & (F.col("velocity") > min_velocity)
    counted = samples.groupBy("activity_id", "heartrate").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(moving).alias("moving"), F.sum(F.when(moving, F.col("velocity"))).alias("distance")
    )
    rate, moved = F.col("heartrate"), F.sum("moving")
    mean_hr, mean_v = F.sum(rate * F.col("moving")) / F.nullif(moved, F.lit(0)), F.sum("distance") / F.nullif(moved, F.lit(0))
    entry = F.when(rate.isNotNull(), F.struct("heartrate", "n"))
    tier = counted.groupBy("activity_id").agg(
        F.sum("n").alias("stream_count"),
        F.coalesce(F.sum(F.when(rate.isNotNull(), F.col("n"))), F.lit(0)).alias("hr_count"),
        F.min(rate).alias("min_hr"),
        F.max(rate).alias("max_hr"),
        F.bround(F.when(mean_v > 0, mean_hr / F.nullif(mean_v, F.lit(0.0))), 2).alias("cardiac_cost"),
        F.sort_array(F.collect_list(entry)).alias("entries"),
    )
    scalars = [c for c in tier.columns if c != "entries"]
    return tier.select(*scalars, _median_of("entries", F.col("hr_count")).alias("median_hr"), F.map_from_entries("entries").alias("rates"))


def _median_of(entries: str, total: Column) -> Column:
    """Median of the ``total`` values that sorted (value, count) pairs stand for; null for none."""
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("upto"), none.alias("low"), none.alias("high"))

    def step(so_far: Column, entry: Column) -> Column:
        upto = so_far["upto"] + entry["n"]
        reached = lambda place, name: F.coalesce(so_far[name], F.when(upto > place, entry["heartrate"])).alias(name)
        return F.struct(upto.alias("upto"), reached(F.floor((total - 1) / 2), "low"), reached(F.floor(total / 2), "high"))

    return F.aggregate(entries, start, step, lambda found: (found["low"] + found["high"]) / 2.0)


def as_tier(rows: DataFrame) -> DataFrame:
    """The tier of samples; a tier as it is."""
    return rows if "rates" in rows.columns else heart_rate_tier(rows)


def stream_scalars(samples: DataFrame) -> DataFrame:
    """Counts, heart-rate range, cardiac cost and median of each activity, from samples or their tier."""
    return as_tier(samples).drop("rates")


def running_max_hr(activities: DataFrame, samples: DataFrame) -> DataFrame:
    """(activity_day, max_hr_to_day): the highest heart rate up to and with each activity day, over all sports.

    ``samples``: those or their tier.  Daily maxima are few; only they are ordered.
    """
    daily = (
        activities.select("id", "activity_day")
        .join(as_tier(samples).select("activity_id", "max_hr"), F.col("id") == F.col("activity_id"), "left")
        .groupBy("activity_day")
        .agg(F.max("max_hr").alias("m"))
    )
    so_far = Window.orderBy("activity_day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("activity_day", F.max("m").over(so_far).alias("max_hr_to_day"))


def activity_zones(
    activities: DataFrame, samples: DataFrame, hr_rest: int, days: DataFrame | None = None, zone_model: str = DEFAULT_MODEL
) -> DataFrame:
    """Zone seconds and load of each activity by the limits of its day; zeros without heart rate.

    ``samples``: those or their tier; ``days``: running_max_hr(), if it is over more activities than these.
    """
    tier = as_tier(samples)
    days = running_max_hr(activities, tier) if days is None else days
    keyed = activities.select("id", "activity_day").join(F.broadcast(days), "activity_day")
    rated = keyed.join(tier.select("activity_id", "hr_count", "rates"), F.col("id") == F.col("activity_id"), "left")
    return zoned(rated, hr_rest, zone_model=zone_model)


def zoned(rated: DataFrame, hr_rest: int, keep: tuple[str, ...] = ("id",), zone_model: str = DEFAULT_MODEL) -> DataFrame:
    """Columns ``keep`` of ``rated`` with hr_max_used, zone seconds and load, from its max_hr_to_day, hr_count and rates."""
    limits = rated.withColumns({f"b{k}": b for k, b in enumerate(zone_bounds(F.col("max_hr_to_day"), hr_rest, zone_model))})
    bands = banded_rates(F.col("rates"), [F.col(f"b{k}") for k in range(5)])
    wide = limits.withColumns({f"band{k}": F.coalesce(b, F.lit(0).cast("long")) for k, b in enumerate(bands)})
    return wide.select(
        *keep,
        F.when(F.col("hr_count") > 0, F.col("max_hr_to_day")).alias("hr_max_used"),
        *[F.col(f"band{b}").alias(f"zone{k}_seconds") for k, b in enumerate((0, 1, 2, 3, 5), 1)],
        load_of(banded_load([F.col(f"band{k}") for k in range(6)])).alias("trimp"),
    )


def hrr_pct(median_hr, hr_rest: int, hr_max):
    """Share of the heart-rate reserve, one decimal; null without a reserve."""
    share = (median_hr - hr_rest) / F.when(hr_max > hr_rest, hr_max - hr_rest) * 100.0
    return F.bround(share, 1)


def adjusted_cardiac_cost(cost, distance_m, elevation_m):
    """Cost less the climb per kilometre, three decimals."""
    km = F.when(distance_m > 0, distance_m / 1000.0)
    return F.bround(cost - ELEVATION_COEFFICIENT * (F.coalesce(elevation_m, F.lit(0.0)) / km), 3)


def vertical_speed(samples: DataFrame) -> DataFrame:
    """Ascent, span and metres of ascent per hour; null for too few points or too short a span."""
    order = Window.partitionBy("activity_id").orderBy("time_offset")
    rise = F.col("altitude") - F.lag("altitude").over(order)
    rows = samples.filter("altitude IS NOT NULL").withColumn("rise", rise)
    out = rows.groupBy("activity_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.coalesce(F.sum(F.when(F.col("rise") > 0, F.col("rise"))), F.lit(0.0)).alias("ascent"),
        ((F.max("time_offset") - F.min("time_offset")) / 3600.0).alias("hours"),
    )
    ok = (F.col("points") >= MIN_ALTITUDE_POINTS) & (F.col("hours") >= MIN_CLIMB_HOURS)
    return out.select(
        "activity_id",
        F.when(ok, F.bround(F.col("ascent") / F.col("hours"), 0).cast("long")).alias("vmh"),
        F.when(ok, F.bround("ascent", 0)).alias("total_ascent_m"),
        F.when(ok, F.bround("hours", 2)).alias("duration_hours"),
    )


def pauses(samples: DataFrame) -> DataFrame:
    """Standing pauses of activities with enough heart-rate samples, one row each.

    Of rows with one offset the last counts, by the column ``pos``, the place in the
    payload; without it a table has no last row, and that of the largest velocity and
    heart rate counts.  A pause is a run of slow samples without a gap of more than
    three seconds, at least thirty seconds long.
    """
    rows = samples.filter("heartrate IS NOT NULL")
    order = ["pos"] if "pos" in samples.columns else []
    last = F.max(F.struct(*order, "velocity", "heartrate"))
    rows = rows.groupBy("activity_id", "time_offset").agg(last.alias("s")).select("activity_id", "time_offset", "s.heartrate", "s.velocity")
    every = Window.partitionBy("activity_id")
    order = every.orderBy("time_offset")
    slow = F.coalesce("velocity", F.lit(0.0)) < STOP_VELOCITY
    rows = rows.withColumn("n", F.count(F.lit(1)).over(every)).filter(F.col("n") >= MIN_STREAM_POINTS)
    rows = rows.withColumn("slow", slow)
    begins = F.coalesce(
        ~F.lag("slow").over(order) | (F.col("time_offset") - F.lag("time_offset").over(order) > MAX_PAUSE_GAP_S),
        F.lit(True),
    )
    runs = rows.withColumn("run", F.sum(F.when(begins, 1).otherwise(0)).over(order)).filter("slow")
    head = Window.partitionBy("activity_id", "run").orderBy("time_offset")
    tail = Window.partitionBy("activity_id", "run").orderBy(F.desc("time_offset"))
    runs = runs.withColumn("k", F.row_number().over(head)).withColumn("back", F.row_number().over(tail))
    found = runs.groupBy("activity_id", "run").agg(
        F.min("time_offset").alias("start_offset"),
        (F.max("time_offset") - F.min("time_offset")).alias("duration_s"),
        F.count(F.lit(1)).alias("sampled_s"),
        F.avg(F.when(F.col("k") <= 5, F.col("heartrate"))).alias("first"),
        F.avg(F.when(F.col("back") <= 5, F.col("heartrate"))).alias("last"),
    )
    drop = F.bround(F.col("first") - F.col("last"), 1)
    return found.filter(F.col("duration_s") >= MIN_PAUSE_S).select(
        "activity_id",
        "start_offset",
        "duration_s",
        "sampled_s",
        drop.alias("drop_bpm"),
        F.bround(drop / (F.col("sampled_s") / 60.0), 1).alias("rate"),
    )


def recovery(pause_rows: DataFrame) -> DataFrame:
    """Pause count, total rest, and median, best, worst and mean recovery rate of each activity."""
    return pause_rows.groupBy("activity_id").agg(
        F.count(F.lit(1)).alias("pause_count"),
        F.sum("duration_s").alias("total_rest_sec"),
        F.bround(F.median("rate"), 1).alias("median_rate"),
        F.max("rate").alias("best_rate"),
        F.min("rate").alias("worst_rate"),
        F.bround(F.avg("rate"), 1).alias("avg_rate"),
    )


def heart_rate_jumps(samples: DataFrame, jump_bpm: int = 30) -> DataFrame:
    """(activity_id, jumps): steps of more than ``jump_bpm`` between neighbouring samples."""
    order = Window.partitionBy("activity_id").orderBy("time_offset")
    step = F.abs(F.col("heartrate") - F.lag("heartrate").over(order))
    rows = samples.filter("heartrate IS NOT NULL").select("activity_id", step.alias("step"))
    return rows.groupBy("activity_id").agg(F.count_if(F.col("step") > jump_bpm).alias("jumps"))


def located(samples: DataFrame) -> DataFrame:
    """Samples that have a position."""
    return samples.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
