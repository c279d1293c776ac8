"""Latest versions, anti and semi joins, batches of whole days, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceforge.constants import REQUESTED_CHANNELS, SPORTS


def latest(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key by ``order``; give a total order, as ties are broken by it alone."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(place)).filter("__place = 1").drop("__place")


def latest_payloads(log: DataFrame) -> DataFrame:
    return latest(log, ["activity_id", "payload_kind"], F.desc("fetched_at"), F.desc("raw_hash"))


def _newest(log: DataFrame) -> DataFrame:
    """(id, summary_json, detail_json): latest_payloads() of both kinds, in one aggregation instead of two ordered windows and a join."""
    def of(kind: str) -> Column:
        own = F.col("payload_kind") == kind
        return F.max_by(F.when(own, F.col("payload_json")), F.when(own, F.struct("fetched_at", "raw_hash"))).alias(f"{kind}_json")

    return log.groupBy(F.col("activity_id").alias("id")).agg(of("summary"), of("detail"))


def _number(c: str, path: str) -> Column:
    return F.get_json_object(c, path).try_cast("double")


def summaries(log: DataFrame) -> DataFrame:
    """(id, avg_hr, start_date_local) of each activity's latest summary."""
    now = _newest(log.filter("payload_kind = 'summary'"))
    return now.select("id", _number("summary_json", "$.average_heartrate").alias("avg_hr"), F.get_json_object("summary_json", "$.start_date_local").alias("start_date_local"))


def hydrated(activities: DataFrame, log: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Payload field, else column, else a default, for each activity.

    ``only``: activity_id of those wanted, few enough to be broadcast: then no other payloads are shuffled.
    """
    if only is not None:
        ids = only.select("activity_id").distinct()
        log = log.join(F.broadcast(ids), "activity_id", "left_semi")
        activities = activities.join(F.broadcast(ids.withColumnRenamed("activity_id", "id")), "id", "left_semi")
    joined = activities.join(_newest(log), "id", "left")
    return joined.select(
        "id",
        "activity_day",
        "sport_type",
        F.coalesce(_number("summary_json", "$.kudos_count"), F.col("kudos_count").cast("double"), F.lit(0.0)).alias("kudos_count"),
        _number("summary_json", "$.average_heartrate").alias("avg_hr"),
        F.coalesce(_number("detail_json", "$.calories"), "calories_kcal").alias("calories_kcal"),
        F.coalesce(F.get_json_object("detail_json", "$.gear.name"), F.get_json_object("detail_json", "$.gear.id")).alias("gear_name"),
        _number("detail_json", "$.gear.distance").alias("gear_distance_m"),
        F.get_json_object("summary_json", "$.start_date_local").alias("start_date_local"),
    )


def missing(activities: DataFrame, samples: DataFrame) -> DataFrame:
    """Activities without a sample."""
    return activities.join(samples.select(F.col("activity_id").alias("id")), "id", "left_anti")


def present(activities: DataFrame, samples: DataFrame) -> DataFrame:
    """Activities with a sample."""
    return activities.join(samples.select(F.col("activity_id").alias("id")), "id", "left_semi")


def bootstrap(payload_ids: DataFrame, state_ids: DataFrame, fact_ids: DataFrame) -> DataFrame:
    """Ids with a payload that have neither state nor facts."""
    return payload_ids.distinct().join(state_ids, "id", "left_anti").join(fact_ids, "id", "left_anti")


def whole_days(df: DataFrame, limit: int, day: str = "activity_day", id_col: str = "id") -> DataFrame:
    """The first ``limit`` rows by day and id, and the rest of the day they end in.

    Only counts by day are ordered.
    """
    per_day = df.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(day)) - F.col("n")
    days = per_day.withColumn("before", before).filter(F.col("before") < limit).select(day)
    return df.join(F.broadcast(days), day, "left_semi")


def sport_dimension(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame(
        [tuple(s[:6]) for s in SPORTS],
        "sport_type string, display string, category string, is_training boolean, is_running boolean, hr_based boolean",
    )


def with_sport(df: DataFrame) -> DataFrame:
    """Display name, category and predicates; an unknown sport keeps its name and counts for nothing."""
    out = df.join(F.broadcast(sport_dimension(df)), "sport_type", "left")
    return out.select(
        *[c for c in df.columns],
        F.coalesce("display", "sport_type").alias("display"),
        F.coalesce("category", F.lit("other")).alias("category"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("is_training", "is_running", "hr_based")],
    )


def unknown_sports(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(sport_dimension(df)), "sport_type", "left_anti").groupBy("sport_type").count()


def missing_channels(activities: DataFrame, channels: DataFrame, requested: Sequence[str] = REQUESTED_CHANNELS) -> DataFrame:
    """(id, missing): requested channels that are neither available nor known to be unavailable, in request order.

    ``channels``: activity_id, channel_key, status.  The requested keys are an
    array on each row, so nothing is crossed.
    """
    known = channels.filter(F.col("status").isin("available", "unavailable")).groupBy("activity_id").agg(
        F.collect_set("channel_key").alias("known")
    )
    asked = F.array(*[F.lit(c) for c in requested])
    rows = activities.select("id").join(known.withColumnRenamed("activity_id", "id"), "id", "left")
    rows = rows.select("id", F.array_except(asked, F.coalesce("known", F.array().cast("array<string>"))).alias("missing"))
    return rows.filter(F.size("missing") > 0)


def channel_tally(candidates: DataFrame) -> DataFrame:
    """(channel, n): how many activities miss each channel."""
    return candidates.select(F.explode("missing").alias("channel")).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


def coverage_report(
    activities: DataFrame, channels: DataFrame, sample: int = 20, requested: Sequence[str] = REQUESTED_CHANNELS
) -> DataFrame:
    """(id, activity_day, missing): the newest activities that miss channels, ``sample`` of them at most."""
    if not 1 <= sample <= 20:
        raise ValueError("sample must lie between 1 and 20")
    found = missing_channels(activities, channels, requested).join(activities.select("id", "activity_day"), "id")
    return found.orderBy(F.desc("activity_day"), F.desc("id")).limit(sample)


def missing_kudos(activities: DataFrame, kudos: DataFrame, since=None) -> DataFrame:
    """Activities that have kudos by count and none by name, from a day on if given."""
    rows = activities.filter("kudos_count > 0")
    if since is not None:
        rows = rows.filter(F.col("activity_day") >= F.lit(since))
    return rows.join(kudos.select(F.col("activity_id").alias("id")), "id", "left_anti")


def kudos_names(kudos: DataFrame) -> DataFrame:
    """(activity_id, names): first and last names, sorted, each once."""
    name = F.trim(F.concat_ws(" ", F.trim("firstname"), F.trim("lastname")))
    rows = kudos.select("activity_id", F.nullif(name, F.lit("")).alias("name"))
    return rows.groupBy("activity_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
