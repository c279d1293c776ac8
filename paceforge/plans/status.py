"""Status rules over recent facts: active, inactive or unavailable, with the evidence."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceforge.constants import RUNNING_SPORTS
from paceforge.operators.sequence import consecutive_pairs

#: Fixed values of the rules.
LOOKBACK = {
    "missing_hr": 14, "missing_streams": 14, "excessive_z5_exposure": 7, "hr_anomaly_burst": 7,
    "cardiac_drift_significant_quality": 7, "consecutive_high_load_hikes": 7,
}
ZONE5_SECONDS, ANOMALIES, HIKE_LOAD, VOLUME_PCT, MAX_AGE_DAYS = 300, 3, 800.0, 10.0, 1


def _recent(facts: DataFrame, code: str, as_of: date, metric_version: int) -> DataFrame:
    first = as_of - timedelta(days=LOOKBACK[code] - 1)
    return facts.filter(
        (F.col("metric_version") == metric_version) & F.col("activity_day").between(F.lit(first), F.lit(as_of))
    )


def _row(df: DataFrame, code: str, status: Column, evidence: Column, amount: Column) -> DataFrame:
    return df.select(
        F.lit(code).alias("code"), status.alias("status"), evidence.cast("string").alias("evidence"), amount.cast("double").alias("amount")
    )


def missing_samples(facts: DataFrame, as_of: date, code: str, metric_version: int = 1) -> DataFrame:
    """Active if a recent activity has no sample of the kind; evidence: how many."""
    column = "heartrate_sample_count" if code == "missing_hr" else "stream_sample_count"
    found = _recent(facts, code, as_of, metric_version).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(column) <= 0).alias("bad"),
        F.min(F.when(F.col(column) <= 0, F.col("activity_id"))).alias("first_id"),
    )
    status = F.when(F.col("n") == 0, "unavailable").when(F.col("bad") > 0, "active").otherwise("inactive")
    return _row(found, code, status, F.col("first_id"), F.col("bad"))


def top_evidence(facts: DataFrame, as_of: date, code: str, column: str, test: Column, metric_version: int = 1) -> DataFrame:
    """Active if a recent activity passes ``test``; evidence: that with the largest ``column``, then the latest."""
    rank = F.struct(F.col(column), F.col("activity_day"), F.col("activity_id"))
    found = _recent(facts, code, as_of, metric_version).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(test, rank)).alias("top")
    )
    status = F.when(F.col("n") == 0, "unavailable").when(F.col("top").isNotNull(), "active").otherwise("inactive")
    return _row(found, code, status, F.col("top.activity_id"), F.col(f"top.{column}"))


def excessive_zone5(facts: DataFrame, as_of: date, metric_version: int = 1, seconds: int = ZONE5_SECONDS) -> DataFrame:
    return top_evidence(facts, as_of, "excessive_z5_exposure", "zone5_seconds", F.col("zone5_seconds") > seconds, metric_version)


def anomaly_burst(facts: DataFrame, as_of: date, metric_version: int = 1) -> DataFrame:
    return top_evidence(facts, as_of, "hr_anomaly_burst", "anomaly_count", F.col("anomaly_count") >= ANOMALIES, metric_version)


def significant_drift(facts: DataFrame, as_of: date, metric_version: int = 1) -> DataFrame:
    test = F.col("cardiac_drift_significant") & F.col("cardiac_drift_quality").isin("good", "fair")
    rows = facts.withColumn("drift_day", F.datediff("activity_day", F.lit("1970-01-01").cast("date")))
    return top_evidence(rows, as_of, "cardiac_drift_significant_quality", "drift_day", test, metric_version)


def consecutive_hikes(facts: DataFrame, as_of: date, metric_version: int = 1) -> DataFrame:
    """Active if the best pair of adjacent hike days exceeds the load; under two hike days: unavailable."""
    code = "consecutive_high_load_hikes"
    hikes = _recent(facts, code, as_of, metric_version).filter("sport_type = 'Hike'")
    days = hikes.groupBy(F.col("activity_day").alias("day")).agg(F.sum(F.coalesce("trimp", F.lit(0.0))).alias("trimp"))
    best = consecutive_pairs(days, "trimp").agg(F.max(F.struct(F.col("combined"), F.col("day"))).alias("best"))
    found = days.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(best))  # one row each
    combined = F.col("best.combined")
    status = F.when(F.col("n") < 2, "unavailable").when(combined > HIKE_LOAD, "active").otherwise("inactive")
    shown = F.col("n") >= 2
    return _row(found, code, status, F.when(shown, F.col("best.day")), F.when(shown, F.bround(combined, 1)))


def volume_jump(facts: DataFrame, as_of: date, metric_version: int = 1) -> DataFrame:
    """This week's running distance against all of last week's; weeks begin on Monday."""
    monday = as_of - timedelta(days=as_of.weekday())
    day, km = F.col("activity_day"), F.col("distance_m") / 1000.0
    runs = facts.filter(F.col("sport_type").isin(*RUNNING_SPORTS) & (F.col("metric_version") == metric_version))
    runs = runs.filter((day >= F.lit(monday - timedelta(days=7))) & (day <= F.lit(as_of)))
    found = runs.agg(
        F.coalesce(F.sum(F.when(day >= F.lit(monday), km)), F.lit(0.0)).alias("now"),
        F.coalesce(F.sum(F.when(day < F.lit(monday), km)), F.lit(0.0)).alias("before"),
    )
    usable = (F.col("now") > 0) & (F.col("before") > 0)
    pct = F.when(usable, F.bround((F.col("now") / F.nullif(F.col("before"), F.lit(0.0)) - 1.0) * 100.0, 2))
    status = F.when(~usable, "unavailable").when(pct >= VOLUME_PCT, "active").otherwise("inactive")
    return _row(found, "running_volume_jump", status, F.lit(monday), pct)


def stale(code: str, times: DataFrame, as_of: date, dirty: DataFrame | None = None) -> DataFrame:
    """Active if the last success is over a day old, or dirty rows remain.  ``times``: at (a date)."""
    last = times.agg(F.max("at").alias("at"))
    waiting = dirty.agg(F.count(F.lit(1)).alias("dirty")) if dirty is not None else None
    found = last.join(F.broadcast(waiting)) if waiting is not None else last.withColumn("dirty", F.lit(0))  # one row each
    age = F.greatest(F.datediff(F.lit(as_of), F.col("at")), F.lit(0))
    status = F.when(F.col("at").isNull(), "unavailable").when((age > MAX_AGE_DAYS) | (F.col("dirty") > 0), "active").otherwise("inactive")
    return _row(found, code, status, F.col("at"), age)


def all_rules(
    facts: DataFrame,
    as_of: date,
    metric_version: int = 1,
    mirror_times: DataFrame | None = None,
    fact_times: DataFrame | None = None,
    dirty: DataFrame | None = None,
) -> DataFrame:
    """One row for each of the nine rules; drift's needs facts with drift.

    ``mirror_times``, ``fact_times``: at (a date), the successes of refresh and computation; without them
    the rule is unavailable.  ``dirty``: the rows that wait for computation.
    """
    never = facts.select(F.col("activity_day").alias("at")).limit(0)
    out = stale("stale_mirror_data", never if mirror_times is None else mirror_times, as_of)
    for part in (
        stale("stale_read_model_facts", never if fact_times is None else fact_times, as_of, dirty),
        missing_samples(facts, as_of, "missing_hr", metric_version),
        missing_samples(facts, as_of, "missing_streams", metric_version),
        excessive_zone5(facts, as_of, metric_version),
        anomaly_burst(facts, as_of, metric_version),
        significant_drift(facts, as_of, metric_version),
        consecutive_hikes(facts, as_of, metric_version),
        volume_jump(facts, as_of, metric_version),
    ):
        out = out.unionByName(part)
    return out
