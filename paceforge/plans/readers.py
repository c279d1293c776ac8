"""Small reads over facts, states and logs.  Each pins a version or takes the newest one."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.constants import SPORTS
from paceforge.operators.relational import latest


def daily_range(daily: DataFrame, start: date, end: date, scope: str = "all", metric_version: int = 1) -> DataFrame:
    """Daily facts of a half-open range and scope, in order of the day."""
    rows = daily.filter((F.col("metric_version") == metric_version) & (F.col("scope") == scope))
    return rows.filter((F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(end))).orderBy("day")


def rolling_fact(rolling: DataFrame, as_of: date, window_days: int, scope: str = "all", sport: str = "all") -> DataFrame:
    """The newest version of one rolling row."""
    rows = rolling.filter((F.col("as_of_day") == F.lit(as_of)) & (F.col("window_days") == window_days))
    rows = rows.filter((F.col("scope") == scope) & (F.col("sport_type") == sport))
    return rows.orderBy(F.desc("metric_version")).limit(1)


def rolling_newest(rolling: DataFrame, as_of: date, scope: str = "all") -> DataFrame:
    """For each window (and sport) the row of the latest day up to ``as_of``, newest version first."""
    rows = rolling.filter((F.col("as_of_day") <= F.lit(as_of)) & (F.col("scope") == scope))
    return latest(rows, ["window_days", "sport_type"], F.desc("as_of_day"), F.desc("metric_version"))


def model_day(model: DataFrame, day: date, metric_version: int = 1) -> DataFrame:
    """The model's row of exactly one day."""
    return model.filter((F.col("day") == F.lit(day)) & (F.col("metric_version") == metric_version))


def source_state(state: DataFrame, activity_ids: Sequence[int]) -> DataFrame:
    """The change-tracking rows of some activities."""
    return state.filter(F.col("activity_id").isin(list(activity_ids)))


def dirty_rows(queue: DataFrame, metric_version: int | None = None, activity_ids: Sequence[int] | None = None) -> DataFrame:
    """Queue rows by version, by id, or all; oldest first."""
    rows = queue
    if metric_version is not None:
        rows = rows.filter(F.col("metric_version") == metric_version)
    if activity_ids is not None:
        rows = rows.filter(F.col("activity_id").isin(list(activity_ids)))
    return rows.orderBy("enqueued_at", "activity_id")


def sync_log_newest(log: DataFrame, limit: int = 10) -> DataFrame:
    """Ledger rows, newest first."""
    return log.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def kudos_list(kudos: DataFrame, activity_id: int | None = None, limit: int = 100) -> DataFrame:
    """Kudos rows by name, of one activity or all."""
    rows = kudos if activity_id is None else kudos.filter(F.col("activity_id") == activity_id)
    return rows.orderBy("activity_id", "firstname", "lastname").limit(limit)


def activity_by_id(hydrated: DataFrame, activity_id: int) -> DataFrame:
    return hydrated.filter(F.col("id") == activity_id)


def of_sports(rows: DataFrame, sports: Sequence[str]) -> DataFrame:
    """Rows of some sports; raises ValueError for an unknown one."""
    if unknown := sorted(set(sports) - {s[0] for s in SPORTS}):
        raise ValueError(f"unknown sports: {', '.join(unknown)}")
    return rows.filter(F.col("sport_type").isin(*sports))


def efficiency_windows(df: DataFrame) -> DataFrame:
    """(sport_type, window_days): the windows in which a sport's efficiency is followed."""
    rows = [(s[0], w) for s in SPORTS for w in s[6]]
    return df.sparkSession.createDataFrame(rows, "sport_type string, window_days int")


def newest_version(*facts: DataFrame) -> DataFrame:
    """(metric_version): the highest over all fact tables; null without rows."""
    out = facts[0].select("metric_version")
    for f in facts[1:]:
        out = out.unionByName(f.select("metric_version"))
    return out.agg(F.max("metric_version").alias("metric_version"))


def anything(*tables: DataFrame) -> bool:
    """Whether any of the tables has a row; reads one row at most."""
    out = tables[0].select(F.lit(1).alias("x"))
    for t in tables[1:]:
        out = out.unionByName(t.select(F.lit(1).alias("x")))
    return not out.limit(1).isEmpty()


def known_ids(*tables: DataFrame) -> DataFrame:
    """Activity ids that any of the tables holds, each once."""
    out = tables[0].select("activity_id")
    for t in tables[1:]:
        out = out.unionByName(t.select("activity_id"))
    return out.distinct()


def without_channel_rows(samples: DataFrame, channels: DataFrame) -> DataFrame:
    """(activity_id): activities that have samples and no row of channel metadata."""
    return samples.select("activity_id").distinct().join(channels.select("activity_id"), "activity_id", "left_anti")


def missing_details(activities: DataFrame, log: DataFrame) -> DataFrame:
    """Activities without a detail payload."""
    details = log.filter("payload_kind = 'detail'").select(F.col("activity_id").alias("id"))
    return activities.join(details, "id", "left_anti")


def mirror_counts(activities: DataFrame, samples: DataFrame, log: DataFrame, kudos: DataFrame) -> DataFrame:
    """One row: activities, those with samples, heart rate, position and details, samples, and kudos rows."""
    per_activity = samples.groupBy("activity_id").agg(
        F.count(F.lit(1)).alias("p"), F.count("heartrate").alias("h"),
        F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("g"),
    )
    counts = per_activity.agg(
        F.count(F.lit(1)).alias("with_streams"), F.coalesce(F.sum("p"), F.lit(0)).alias("points"),
        F.coalesce(F.sum("h"), F.lit(0)).alias("hr_points"), F.count_if(F.col("h") > 0).alias("with_hr"),
        F.count_if(F.col("g") > 0).alias("with_gps"),
    )
    details = log.filter("payload_kind = 'detail'").agg(F.count_distinct("activity_id").alias("with_details"))
    named = kudos.agg(F.count(F.lit(1)).alias("kudos_rows"))
    one = activities.agg(F.count(F.lit(1)).alias("activities"))
    for part in (counts, details, named):  # one row each
        one = one.join(F.broadcast(part))
    return one


def channel_counts(channels: DataFrame) -> DataFrame:
    """(channel_key, rows, activities, available, unavailable, failed) of channel metadata."""
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    return channels.groupBy("channel_key").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("activity_id").alias("activities"),
        status("available"), status("unavailable"), status("failed"),
    )


def legacy_payloads(activities: DataFrame, log: DataFrame, at: str) -> DataFrame:
    """Log rows for summaries and details that only the old columns hold; a second run adds none.

    ``activities``: id, summary_json, detail_json.
    """
    kinds = F.array(
        F.struct(F.lit("summary").alias("payload_kind"), F.col("summary_json").alias("payload_json")),
        F.struct(F.lit("detail").alias("payload_kind"), F.col("detail_json").alias("payload_json")),
    )
    rows = activities.select(F.col("id").alias("activity_id"), F.inline(kinds)).filter("payload_json IS NOT NULL")
    rows = rows.join(log.select("activity_id", "payload_kind"), ["activity_id", "payload_kind"], "left_anti")
    hashed = F.md5(F.col("payload_json").cast("binary"))
    return rows.select(
        "activity_id", "payload_kind", F.lit(at).alias("fetched_at"), "payload_json", hashed.alias("raw_hash"),
        F.lit(True).alias("migrated_from_legacy"),
    )
