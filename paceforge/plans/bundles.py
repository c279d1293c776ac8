"""Product bundles: sections of metric rows with what is there and what is missing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceforge.plans import services
from paceforge.plans.aggregate import AggregateRequest, aggregate
from paceforge.plans.registry import BUNDLES, REGISTRY

#: Sections of a bundle by the source of its metrics.
_TITLES = {"activity": "workouts", "social": "social", "daily": "load", "model": "fitness", "rolling": "trends", "historical": "history"}


def sections(rows: DataFrame, bundle: str) -> DataFrame:
    """(section, requested, included, unavailable, status) for the metrics of a bundle.

    A metric is included if some row has a value.  Complete, partial, or unavailable if none is.
    """
    spark = rows.sparkSession
    asked = spark.createDataFrame([(_TITLES[REGISTRY[m].source], m) for m in BUNDLES[bundle] if REGISTRY[m].mode != "distribution"], "section string, metric_id string")
    have = rows.filter("value IS NOT NULL").groupBy("metric_id").agg(F.bool_and(F.col("completeness_status") == "complete").alias("whole"))
    joined = F.broadcast(asked).join(have, "metric_id", "left")
    out = joined.groupBy("section").agg(
        F.array_sort(F.collect_list("metric_id")).alias("requested"),
        F.array_sort(F.collect_list(F.when(F.col("whole").isNotNull(), F.col("metric_id")))).alias("included"),
        F.bool_and(F.coalesce("whole", F.lit(False))).alias("all_whole"),
    )
    missing = F.array_except("requested", "included")
    status = F.when(F.size("included") == 0, "unavailable").when(F.col("all_whole"), "complete").otherwise("partial")
    return out.select("section", "requested", "included", missing.alias("unavailable"), status.alias("status"))


def overall(parts: DataFrame) -> DataFrame:
    """One row: unavailable if every section is, complete if all are, else partial."""
    status = (
        F.when(F.bool_and(F.col("status") == "unavailable"), "unavailable")
        .when(F.bool_and(F.col("status") == "complete"), "complete")
        .otherwise("partial")
    )
    return parts.agg(status.alias("status"), F.array_sort(F.flatten(F.collect_list("unavailable"))).alias("unavailable"))


def first_values(rows: DataFrame) -> DataFrame:
    """The earliest value that is not null of each metric."""
    place = F.struct("bucket_start", F.coalesce("sport_type", F.lit("")))
    return rows.filter("value IS NOT NULL").groupBy("metric_id").agg(F.min_by("value", place).alias("value"))


def warnings(rows: DataFrame) -> DataFrame:
    """(code, severity, message, field, evidence), each once, from the rows' completeness.

    ``field`` is the metric, ``evidence`` the bucket, scope and sport of the row.
    """
    evidence = F.concat_ws("/", F.col("bucket_start").cast("string"), "scope", "sport_type")
    kinds = (
        (F.col("completeness_status") == "partial", "partial_data", "info", "is partial"),
        (F.col("completeness_status") == "unavailable", "no_data", "warning", "has no data"),
        (F.col("metric_version_status") == "mixed_degraded", "mixed_versions", "warning", "mixes versions"),
    )
    found = F.array_compact(
        F.array(
            *[
                F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.concat_ws(" ", "metric_id", F.lit(says)).alias("message")))
                for test, code, severity, says in kinds
            ]
        )
    )
    flat = rows.select(F.inline(found), F.col("metric_id").alias("field"), evidence.alias("evidence"))
    return flat.dropDuplicates(["code", "severity", "message", "field", "evidence"])


#: What a brief shows of its days, in all and by sport.
LOAD_METRICS = ("trimp", "distance_km", "moving_time_min", "elevation_m", "kudos_count")


def daily_brief(sources: dict[str, DataFrame], day: date, metric_version: int = 1) -> DataFrame:
    """The bundle's metrics over the 14 days that end with ``day``."""
    request = AggregateRequest(bundle="daily_brief", scope="both", bucket="all_time", start=day - timedelta(days=13), end=day + timedelta(days=1), metric_version=metric_version)
    return aggregate(sources, request)


def brief_load(sources: dict[str, DataFrame], day: date, bucket: str = "day", metric_version: int = 1) -> DataFrame:
    """Load of a brief's 14 days, in all and by sport: each day's, or with bucket all_time their sum."""
    request = AggregateRequest(LOAD_METRICS, scope="both", bucket=bucket, start=day - timedelta(days=13), end=day + timedelta(days=1), metric_version=metric_version)
    return aggregate(sources, request)


#: The sections of a brief and what each is asked for.
BRIEF_SECTIONS: dict[str, tuple[str, ...]] = {
    "current_state": ("fitness", "fatigue", "form", "form_zone", "acwr", "acwr_zone"),
    "recent_workouts": ("sport_type", "distance_km", "moving_time_min", "elevation_m", "trimp", "kudos_count"),
    "daily_load_14d": LOAD_METRICS,
    "by_sport": LOAD_METRICS,
    "model_context": (
        "fitness", "fatigue", "form", "form_zone", "acwr", "acwr_zone", "weekly_trimp", "total_trimp_14d", "avg_trimp_per_day",
    ),
    "status_facts": ("status",),
    "supported_gear": ("gear_name", "gear_distance_m"),
    "freshness": ("freshness",),
}


def _long(df: DataFrame, section: str, item: Column, metrics: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """(section, item, metric, value, label): a row for each metric of each row; texts are labels."""
    none = {"value": F.lit(None).cast("double"), "label": F.lit(None).cast("string")}
    cell = lambda c: none | ({"label": F.col(c).cast("string")} if c in labels else {"value": F.col(c).cast("double")})
    cells = [F.struct(F.lit(c).alias("metric"), *[v.alias(k) for k, v in cell(c).items()]) for c in metrics]
    return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), F.inline(F.array(*cells)))


def brief(
    sources: dict[str, DataFrame],
    day: date,
    hydrated: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    status: DataFrame | None = None,
    freshness: DataFrame | None = None,
    metric_version: int = 1,
) -> DataFrame:
    """A daily brief whole, as rows (section, item, metric, value, label); see BRIEF_SECTIONS.

    The state and windows of the day; ten workouts of its fourteen days; their load by day and by sport; the status
    rules (status.all_rules()); the gear of the newest fifty workouts of four weeks (``hydrated``: id, gear_name,
    gear_distance_m, or what gives them for a table of activity_id); and the mirror's freshness (services.freshness()).  Sections whose input is not given have no rows.
    """
    facts = sources["activity"].filter(F.col("metric_version") == metric_version)
    state = services.fitness_state(sources["model"], sources["rolling"], day)
    zones = ("form_zone", "acwr_zone")
    recent = services.list_workouts(facts, 10, day - timedelta(days=13), day)
    shown = services.workout_metrics(recent).join(recent.select("activity_id", "kudos_count"), "activity_id")
    group = lambda c: F.coalesce("sport_type", F.lit("all")) if c is None else F.concat_ws(" ", F.col(c).cast("string"), F.coalesce("sport_type", F.lit("all")))
    parts = [
        _long(state, "current_state", F.col("day"), BRIEF_SECTIONS["current_state"], zones),
        _long(state, "model_context", F.col("day"), BRIEF_SECTIONS["model_context"], zones),
        _long(shown, "recent_workouts", F.col("activity_id"), BRIEF_SECTIONS["recent_workouts"], ("sport_type",)),
    ]
    for section, bucket, place in (("daily_load_14d", "day", "bucket_start"), ("by_sport", "all_time", None)):
        load = brief_load(sources, day, bucket, metric_version)
        parts.append(load.select(F.lit(section).alias("section"), group(place).alias("item"), F.col("metric_id").alias("metric"), "value", F.lit(None).cast("string").alias("label")))
    if status is not None:
        parts.append(status.select(F.lit("status_facts").alias("section"), F.col("code").alias("item"), F.lit("status").alias("metric"), F.col("amount").alias("value"), F.col("status").alias("label")))
    if hydrated is not None:
        worn = services.list_workouts(facts, 50, day - timedelta(days=27), day).select("activity_id")
        rows = hydrated(worn) if callable(hydrated) else hydrated
        gear = rows.withColumnRenamed("id", "activity_id").join(F.broadcast(worn), "activity_id", "left_semi")
        gear = gear.filter("gear_name IS NOT NULL OR gear_distance_m IS NOT NULL")
        parts.append(_long(gear, "supported_gear", F.col("activity_id"), BRIEF_SECTIONS["supported_gear"], ("gear_name",)))
    if freshness is not None:
        parts.append(_long(freshness, "freshness", F.lit("mirror"), BRIEF_SECTIONS["freshness"], ("freshness",)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def brief_completeness(rows: DataFrame) -> DataFrame:
    """(section, requested, included, status) of a brief's rows: complete, partial, or unavailable without any value."""
    asked = rows.sparkSession.createDataFrame([(s, list(m)) for s, m in BRIEF_SECTIONS.items()], "section string, requested array<string>")
    have = rows.filter("value IS NOT NULL OR label IS NOT NULL").groupBy("section").agg(F.array_sort(F.collect_set("metric")).alias("included"))
    out = F.broadcast(asked).join(have, "section", "left").withColumn("included", F.coalesce("included", F.array().cast("array<string>")))
    missing = F.size(F.array_except("requested", "included"))
    status = F.when(F.size("included") == 0, "unavailable").when(missing == 0, "complete").otherwise("partial")
    return out.select("section", "requested", "included", status.alias("status"))


def weekly_digest(sources: dict[str, DataFrame], day: date, metric_version: int = 1) -> DataFrame:
    """From Monday to ``day`` beside the whole week before: metric_id, sport_type, value, previous, delta."""
    monday = day - timedelta(days=day.weekday())
    over = lambda start, end: aggregate(
        sources, AggregateRequest(bundle="weekly_digest", scope="both", bucket="all_time", start=start, end=end, metric_version=metric_version)
    ).select("metric_id", F.coalesce("sport_type", F.lit("all")).alias("sport_type"), "value")
    before = over(monday - timedelta(days=7), monday).withColumnRenamed("value", "previous")
    joined = over(monday, day + timedelta(days=1)).join(before, ["metric_id", "sport_type"], "full_outer")
    return joined.withColumn("delta", F.bround(F.col("value") - F.col("previous"), 3))


def historical(sources: dict[str, DataFrame], bucket: str = "year", metric_version: int = 1) -> DataFrame:
    return aggregate(sources, AggregateRequest(bundle="historical_facts", scope="both", bucket=bucket, metric_version=metric_version))
