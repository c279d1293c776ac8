"""Activities and samples as deterministic projections of the driver's tables.

The driver's tables hold no heart-rate streams.  Lens O reads ``orders`` as
activities and ``lineitem`` as their samples; lens E reads ``events`` as dense
streams, 500 samples an activity.  ``paceforge.oracle`` has the same projections in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activities_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    priority = F.col("o_orderpriority")
    sport = (
        F.when(priority == "1-URGENT", "Run")
        .when(priority == "2-HIGH", "TrailRun")
        .when(priority == "3-MEDIUM", "Hike")
        .when(priority == "4-NOT SPECIFIED", "Walk")
        .otherwise("Ride")
    )
    moving = F.lit(600) + F.col("o_orderkey") % 7200
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("date").alias("activity_day"),
        sport.alias("sport_type"),
        F.col("o_totalprice").alias("distance_m"),
        moving.alias("moving_time_s"),
        (moving + F.col("o_custkey") % 300).alias("elapsed_time_s"),
        (F.col("o_custkey") % 900).cast("double").alias("elevation_gain_m"),
        (F.col("o_custkey") % 9).alias("kudos_count"),
        F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 1200).cast("double")).alias("calories_kcal"),
        (F.col("o_orderkey") % 10 != 0).alias("has_detail"),
    )


def samples_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    heart = F.when(F.col("l_discount") >= 0.005, (90 + F.floor(2 * F.col("l_quantity"))).cast("long"))
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("activity_id"),
        (F.row_number().over(order) - 1).cast("long").alias("time_offset"),
        heart.alias("heartrate"),
        (F.col("l_tax") * 50).alias("velocity"),
        (F.col("l_extendedprice") / 100).alias("altitude"),
    )


#: Samples of one dense activity: a fixed number, so that no activity grows with the table.
DENSE_SAMPLES = 500


def _dense_id() -> Column:
    return F.floor(F.col("event_id") / DENSE_SAMPLES).cast("long")


def activities_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activities of ``samples_e``, with summary heart rates."""
    days = read_table(spark, sf_dir, "events").groupBy(_dense_id().alias("id")).agg(F.min("ts").cast("date").alias("activity_day"))
    i = F.col("id")
    sports = F.array(*[F.lit(s) for s in ("Run", "TrailRun", "Hike", "Walk", "Ride")])
    mean = F.when(i % 7 != 0, (100 + i % 80).cast("double"))
    return days.select(
        "id",
        "activity_day",
        sports[(i % 5).cast("int")].alias("sport_type"),
        (1000.0 + 100 * (i % 50)).alias("distance_m"),
        (480 + i % 20).alias("moving_time_s"),
        (500 + i % 20).alias("elapsed_time_s"),
        ((i % 7) * 10).cast("double").alias("elevation_gain_m"),
        (i % 9).alias("kudos_count"),
        (200 + i % 100).cast("double").alias("calories_kcal"),
        (i % 10 != 0).alias("has_detail"),
        mean.alias("avg_hr"),
        (mean + 40).alias("max_hr"),
    )


def samples_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    offset = F.col("event_id") % DENSE_SAMPLES
    paused = offset % 100
    pace = 2.0 + F.floor(offset / 125) % 2 + (F.col("event_id") % 20) / 100.0
    return read_table(spark, sf_dir, "events").select(
        _dense_id().alias("activity_id"),
        offset.cast("long").alias("time_offset"),
        (95 + F.floor("value") % 90).cast("long").alias("heartrate"),
        F.when((paused >= 50) & (paused <= 89), 0.0).otherwise(pace).alias("velocity"),
        (500 + F.col("event_id") % 50).cast("double").alias("altitude"),
    )


def payload_log_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log with two versions of each activity's summary and one detail."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    versions = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("v")) for k, v in (("summary", 1), ("summary", 2), ("detail", 1))]))
    rows = o.select("*", versions.alias("x")).select(
        F.col("o_orderkey").alias("activity_id"), "o_custkey", F.col("x.kind").alias("payload_kind"), F.col("x.v").alias("v"), "d"
    )
    rate = F.when(F.col("activity_id") % 7 == 0, '"n/a"').otherwise((100 + F.col("activity_id") % 80).cast("string"))
    kudos = F.when(F.col("v") == 2, F.concat(F.lit(',"kudos_count":'), (F.col("o_custkey") % 9).cast("string"))).otherwise("")
    summary = F.concat(
        F.lit('{"id":'), F.col("activity_id").cast("string"), kudos, F.lit(',"average_heartrate":'), rate,
        F.lit(',"start_date_local":"'), F.col("d").cast("string"), F.lit("T"),
        F.lpad((F.col("activity_id") % 24).cast("string"), 2, "0"), F.lit(":15:00Z"), F.lit('"}'),
    )
    detail = F.concat(
        F.lit('{"calories":'), (F.col("activity_id") % 1200).cast("string"), F.lit(',"gear":'),
        F.when(F.col("activity_id") % 3 == 0, "null").otherwise(
            F.concat(F.lit('{"id":"g'), (F.col("activity_id") % 5).cast("string"), F.lit('","name":"Shoe '),
                     (F.col("activity_id") % 5).cast("string"), F.lit('","distance":'), (F.col("activity_id") * 10).cast("string"), F.lit("}"))
        ), F.lit("}"),
    )
    return rows.select(
        "activity_id",
        "payload_kind",
        F.date_add("d", F.col("v")).cast("string").alias("fetched_at"),
        F.when(F.col("payload_kind") == "summary", summary).otherwise(detail).alias("payload_json"),
    ).withColumn("raw_hash", F.md5(F.col("payload_json").cast("binary")))
