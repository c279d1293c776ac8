"""Columnar stream payloads to sample rows, and channel metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.constants import REQUESTED_CHANNELS

#: Payload key and sample column of the numeric channels.
CHANNELS = (
    ("heartrate", "heartrate", "long"),
    ("velocity_smooth", "velocity", "double"),
    ("altitude", "altitude", "double"),
    ("cadence", "cadence", "long"),
    ("grade_smooth", "grade", "double"),
    ("grade_adjusted_speed", "gap_speed", "double"),
    ("grade_adjusted_distance", "gap_distance", "double"),
)
_CHANNEL = "struct<data:array<string>,original_size:bigint,resolution:string,series_type:string>"


def parsed(payloads: DataFrame) -> DataFrame:
    """(activity_id, channels): each payload, a JSON object of channels with ``data`` arrays, as a map."""
    return payloads.select("activity_id", F.from_json("payload_json", f"map<string,{_CHANNEL}>").alias("channels"))


def samples(payloads: DataFrame, every: bool = False) -> DataFrame:
    """One row for each offset; of equal offsets the first stays.  Other channels go to ``values_json``.

    ``every`` keeps all rows, with their place in the payload as ``pos``, for measures in which the last counts.
    """
    rows = parsed(payloads).filter("channels['time'] IS NOT NULL")
    zipped = rows.select("activity_id", "channels", F.posexplode(F.col("channels")["time"]["data"]).alias("pos", "t"))
    at = lambda key: F.get(F.col("channels")[key]["data"], F.col("pos"))
    known = ["time", "latlng", "moving", *[k for k, _, _ in CHANNELS]]
    extra = F.map_filter("channels", lambda k, v: ~k.isin(*known) & F.get(v["data"], F.col("pos")).isNotNull())
    extra = F.transform_values(extra, lambda k, v: F.get(v["data"], F.col("pos")))
    wide = zipped.select(
        "activity_id",
        "pos",
        F.col("t").try_cast("long").alias("time_offset"),
        *[at(key).try_cast(kind).alias(name) for key, name, kind in CHANNELS],
        F.get_json_object(at("latlng"), "$[0]").try_cast("double").alias("lat"),
        F.get_json_object(at("latlng"), "$[1]").try_cast("double").alias("lng"),
        at("moving").try_cast("boolean").alias("is_moving"),
        F.when(F.size(extra) > 0, F.to_json(extra)).alias("values_json"),
    ).filter("time_offset IS NOT NULL")
    if every:
        return wide
    columns = [c for c in wide.columns if c not in ("activity_id", "time_offset", "pos")]
    first = wide.groupBy("activity_id", "time_offset").agg(F.min_by(F.struct(*columns), "pos").alias("s"))
    return first.select("activity_id", "time_offset", "s.*")


def channel_metadata(payloads: DataFrame, requested: Sequence[str] = REQUESTED_CHANNELS) -> DataFrame:
    """Requested channels, available or not, then any others of each payload."""
    asked = F.array(*[F.lit(c) for c in requested])
    rows = parsed(payloads).select("activity_id", "channels", F.explode(F.array_union(asked, F.map_keys("channels"))).alias("channel_key"))
    c = F.col("channels")[F.col("channel_key")]
    return rows.select(
        "activity_id",
        "channel_key",
        c["original_size"].alias("original_size"),
        c["resolution"].alias("resolution"),
        c["series_type"].alias("series_type"),
        F.when(c.isNotNull(), "available").otherwise("unavailable").alias("status"),
    )


def merged_values(existing: DataFrame, update: DataFrame) -> DataFrame:
    """Existing samples with the update's extra values merged in, the update's winning; no rows are added.

    Both: activity_id, time_offset, values_json.
    """
    new = update.select("activity_id", "time_offset", F.from_json("values_json", "map<string,string>").alias("new"))
    rows = existing.join(new, ["activity_id", "time_offset"], "left")
    old = F.coalesce(F.from_json("values_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key("new", k))
    both = F.to_json(F.map_concat(kept, "new"))
    return rows.withColumn("values_json", F.when(F.col("new").isNull(), F.col("values_json")).otherwise(both)).drop("new")
