"""Small scalar expressions of the product surface."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceforge.constants import ACWR_DANGER, ACWR_SWEET_HIGH, ACWR_SWEET_LOW, FORM_NORMAL_BELOW, FORM_TIRED_BELOW

BUCKETS = ("day", "week", "month", "year", "all_time")


def bucket_start(day: Column, bucket: str, range_start: Column | None = None) -> Column:
    """First day of the bucket; weeks begin on Monday; all_time begins with the range."""
    if bucket == "day":
        return day
    if bucket in ("week", "month", "year"):
        return F.trunc(day, bucket)
    if bucket == "all_time" and range_start is not None:
        return range_start
    raise ValueError(f"unknown bucket: {bucket}")


def bucket_next(start: Column, bucket: str) -> Column:
    steps = {"day": F.date_add(start, 1), "week": F.date_add(start, 7)}
    steps |= {"month": F.add_months(start, 1), "year": F.add_months(start, 12)}
    return steps[bucket]


def form_zone(form: Column) -> Column:
    return F.when(form < FORM_TIRED_BELOW, "tired").when(form < FORM_NORMAL_BELOW, "normal").otherwise("fresh")


def acwr(fatigue: Column, fitness: Column) -> Column:
    return F.when(fitness > 0, F.bround(fatigue / F.nullif(fitness, F.lit(0.0)), 3))


def acwr_zone(ratio: Column) -> Column:
    return (
        F.when(ratio.isNull(), "unknown")
        .when((ratio >= ACWR_SWEET_LOW) & (ratio <= ACWR_SWEET_HIGH), "sweet_spot")
        .when((ratio > ACWR_SWEET_HIGH) & (ratio <= ACWR_DANGER), "caution")
        .when(ratio > ACWR_DANGER, "danger")
        .otherwise("undertrained")
    )


def season(day: Column) -> Column:
    m = F.month(day)
    return (
        F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")
    )


def smart_round(x: Column) -> Column:
    """Whole numbers from ten on, one decimal more for each power of ten below, four at most."""
    a = F.abs(x)
    out = F.bround(x, 4)
    for least, decimals in ((0.01, 3), (0.1, 2), (1.0, 1), (10.0, 0)):
        out = F.when(a >= least, F.bround(x, decimals)).otherwise(out)
    return out


def local_hhmm(iso: Column) -> Column:
    """HH:MM of an ISO text as written, without any time-zone shift; null for anything else."""
    found = F.regexp_extract(iso, r"^\d{4}-\d{2}-\d{2}[T ]([01]\d|2[0-3]):([0-5]\d)", 0)
    return F.when(found != "", F.substring(found, 12, 5))


def relative_label(seconds: Column) -> Column:
    """``Hh Mm`` below a day, ``Dd Hh`` from there on; floor minutes, negatives count as 0."""
    minutes = F.floor(F.greatest(seconds, F.lit(0)) / 60).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    days = F.floor(hours / 24).cast("long")
    return F.when(days >= 1, F.format_string("%dd %dh", days, hours % 24)).otherwise(
        F.format_string("%dh %dm", hours, minutes % 60)
    )
