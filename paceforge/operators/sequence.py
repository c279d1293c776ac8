"""Operators over ordered days: streaks, last occurrences, load models."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceforge.constants import ALPHA_FATIGUE, ALPHA_FITNESS, WARM_UP_DAYS


def day_spine(df: DataFrame, day: str = "day", until: date | None = None, since: date | None = None) -> DataFrame:
    """Every day from the first, or from ``since``, to the last, or to ``until`` if that is later; none without rows or ``since``."""
    first = F.min(day) if since is None else F.lit(since)
    last = F.max(day) if until is None else F.greatest(F.max(day), F.lit(until))
    ends = df.agg(first.alias("a"), last.alias("b")).filter("a <= b")
    return ends.select(F.explode(F.sequence("a", "b")).alias(day))


def streaks(daily: DataFrame) -> DataFrame:
    """(day, activity_streak_days, rest_streak_days): rows since the last day of the other kind, itself excluded.

    ``daily``: day, activity_count; its rows are counted, so it should have no gaps.
    """
    order = Window.orderBy("day")
    active = F.col("activity_count") > 0
    n = F.row_number().over(order)
    last = lambda test: F.coalesce(F.max(F.when(test, F.col("n"))).over(order), F.lit(0))
    rows = daily.select("day", "activity_count", n.alias("n"))
    return rows.select(
        "day",
        F.when(active, F.col("n") - last(~active)).otherwise(0).cast("long").alias("activity_streak_days"),
        F.when(active, 0).otherwise(F.col("n") - last(active)).cast("long").alias("rest_streak_days"),
    )


def days_since(days: DataFrame, events: DataFrame, name: str) -> DataFrame:
    """(day, name): days since the last event on or before each day, null before the first.

    ``events``: activity_day.  A range join, expressed as a running last over both.
    """
    happened = events.select(F.col("activity_day").alias("day")).distinct().withColumn("hit", F.col("day"))
    both = days.select("day").distinct().withColumn("asked", F.lit(True)).join(happened, "day", "full_outer")
    seen = F.last("hit", ignorenulls=True).over(Window.orderBy("day"))
    return both.withColumn("seen", seen).filter("asked").select("day", F.datediff("day", "seen").cast("long").alias(name))


def consecutive_pairs(daily: DataFrame, value: str) -> DataFrame:
    """(previous_day, day, combined) for rows whose predecessor is the day before."""
    order = Window.orderBy("day")
    rows = daily.select("day", value, F.lag("day").over(order).alias("previous_day"), F.lag(value).over(order).alias("before"))
    return rows.filter(F.datediff("day", "previous_day") == 1).select(
        "previous_day", "day", (F.col("before") + F.col(value)).alias("combined")
    )


def _round1(x: float) -> float:
    return float(np.rint(x * 10) / 10)


def load_model(
    daily: DataFrame,
    series: list[str] | None = None,
    warm_up: int = WARM_UP_DAYS,
    seed: tuple[date, float, float] | None = None,
) -> DataFrame:
    """Fitness and fatigue of each series of daily loads, from zero ``warm_up`` days before its first day.

    ``seed``: a day with its fitness and fatigue, from which the fold goes on with the day after;
    as states are rounded, it gives what a fold from the first day would.  Each step is rounded to one decimal, so it is a fold and no window: a grouped
    function runs once over each series.  ``daily``: day, load and the columns of
    ``series``; missing days count as no load.
    """
    keys = series or []
    rows = daily.select(*keys, "day", "load")
    rows = rows if keys else rows.withColumn("series", F.lit(0))
    by = keys or ["series"]
    kinds = dict(rows.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        days = pd.to_datetime(pdf["day"])
        loads = pd.Series(pdf["load"].fillna(0.0).to_numpy(float), index=days).groupby(level=0).sum()
        first, fitness, fatigue = loads.index.min() - pd.Timedelta(days=warm_up), 0.0, 0.0
        if seed is not None:
            first, fitness, fatigue = pd.Timestamp(seed[0] + timedelta(days=1)), *seed[1:]
        span = pd.date_range(first, loads.index.max())
        out = []
        for load in loads.reindex(span, fill_value=0.0).to_numpy():
            fitness = _round1(fitness + ALPHA_FITNESS * (load - fitness))
            fatigue = _round1(fatigue + ALPHA_FATIGUE * (load - fatigue))
            out.append((load, fitness, fatigue))
        found = pd.DataFrame(out, columns=["load", "fitness", "fatigue"])
        found.insert(0, "day", span.date)
        for k in reversed(by):
            found.insert(0, k, pdf[k].iloc[0])
        return found

    kinds_text = ", ".join(f"{k} {kinds[k]}" for k in by)
    out = rows.groupBy(*by).applyInPandas(fold, f"{kinds_text}, day date, load double, fitness double, fatigue double")
    return out if keys else out.drop("series")


def project(plans: DataFrame) -> DataFrame:
    """Carries each scenario's start state forward over its daily loads, one decimal a step.

    ``plans``: scenario, day, load, start_fitness, start_fatigue; one fold for each scenario.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        fitness, fatigue = float(pdf["start_fitness"].iloc[0]), float(pdf["start_fatigue"].iloc[0])
        out = []
        for day, load in zip(pdf["day"], pdf["load"]):
            fitness = _round1((1 - ALPHA_FITNESS) * fitness + ALPHA_FITNESS * load)
            fatigue = _round1((1 - ALPHA_FATIGUE) * fatigue + ALPHA_FATIGUE * load)
            out.append((pdf["scenario"].iloc[0], day, load, fitness, fatigue, _round1(fitness - fatigue)))
        return pd.DataFrame(out, columns=["scenario", "day", "load", "fitness", "fatigue", "form"])

    return plans.groupBy("scenario").applyInPandas(
        fold, "scenario string, day date, load double, fitness double, fatigue double, form double"
    )


def smoothed(values: Iterator[float], half_life: float) -> float:
    """Exponential mean with unrounded state; only the result is rounded."""
    alpha, state = 1 - 0.5 ** (1 / half_life), 0.0
    for v in values:
        state += alpha * (v - state)
    return round(state, 1)


def day_window(day: Column, days: int) -> tuple[Column, int]:
    """Epoch day and frame start for a closed window of ``days`` days that ends on the row's day."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")), -(days - 1)
