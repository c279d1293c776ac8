"""Cardiac drift within an activity: heart rate at like pace, late against early.

Pace is cut into natural classes; in each class the heart rate of the late
segments is compared with that of the early ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceforge.constants import DRIFT_DEFAULT_THRESHOLD, DRIFT_THRESHOLDS, MIN_STREAM_POINTS, MOVING_VELOCITY


@dataclass(frozen=True)
class DriftSettings:
    """Fixed values of the algorithm."""

    most_points: int = 600
    most_classes: int = 6
    class_points: int = 30
    segment_s: int = 60
    fit: float = 0.85
    fit_gain: float = 0.03
    gain_from_classes: int = 3
    outlier_iqr: float = 2.5
    iqr_points: int = 4
    half_points: int = 5
    class_s: int = 120
    good_s: int = 600
    fair_s: int = 300
    severity: tuple[tuple[float, str], ...] = ((3.0, "stable"), (5.0, "borderline"), (8.0, "moderate"), (12.0, "significant"))
    consistency: float = 0.6


class NaturalBreaks:
    """Optimal classes of sorted values, for growing class counts over one table of squared errors."""

    def __init__(self, values: np.ndarray) -> None:
        n = self.n = len(values)
        first = np.concatenate([[0.0], np.cumsum(values)])
        second = np.concatenate([[0.0], np.cumsum(values * values)])
        size = np.arange(n + 1)[None, :] - np.arange(n + 1)[:, None]
        with np.errstate(all="ignore"):
            error = (second[None, :] - second[:, None]) - (first[None, :] - first[:, None]) ** 2 / size
        self.error = np.where(size > 0, error, np.inf)
        self.best = [None, self.error[0].copy()]
        self.cut: list = [None, None]

    def classes(self, k: int) -> tuple[list[int], float]:
        """Borders of k classes and the goodness of variance fit."""
        while len(self.best) <= k:
            total = self.best[-1][:, None] + self.error
            total[: len(self.best) - 1] = np.inf
            self.cut.append(total.argmin(axis=0))
            self.best.append(total.min(axis=0))
        borders = [self.n]
        for t in range(k, 1, -1):
            borders.append(int(self.cut[t][borders[-1]]))
        borders.append(0)
        whole = self.error[0, self.n]
        fit = float((whole - self.best[k][self.n]) / whole) if whole > 0 else 1.0
        return borders[::-1], fit


def choose_classes(values: np.ndarray, least: int, s: DriftSettings) -> tuple[list[int], float]:
    """Borders of the chosen classes; the fit told is that of the last count tried."""
    breaks = NaturalBreaks(values)
    chosen, tried, before = None, 1.0, 0.0
    for k in range(2, min(s.most_classes, len(values) // least, len(values)) + 1):
        borders, tried = breaks.classes(k)
        if np.diff(borders).min() < least:
            continue
        chosen = borders
        if tried >= s.fit or (tried - before < s.fit_gain and k >= s.gain_from_classes):
            break
        before = tried
    return chosen or breaks.classes(min(2, len(values)))[0], tried


def _runs(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= least]


def drift_of(heartrate: np.ndarray, velocity: np.ndarray, threshold: float, s: DriftSettings = DriftSettings()) -> dict | None:
    """Drift of one activity's moving samples in time order; None for too few of them."""
    n = len(heartrate)
    if n < MIN_STREAM_POINTS:
        return None
    step = max(n // s.most_points, 1)
    kept = slice(None, step * s.most_points, step)
    return thinned_drift(np.asarray(heartrate, float)[kept], np.asarray(velocity, float)[kept], step, threshold, s)


def thinned_drift(hr: np.ndarray, pace: np.ndarray, step: int, threshold: float, s: DriftSettings = DriftSettings()) -> dict:
    """Drift of every ``step``-th moving sample in time order."""
    segment, least = max(2, s.segment_s // step), max(10, s.class_points // step)
    order = np.argsort(pace, kind="stable")
    borders, fit = choose_classes(pace[order], least, s)
    label = np.empty(len(pace), np.int64)
    label[order] = np.repeat(np.arange(len(borders) - 1), np.diff(borders))

    clean = hr.copy()
    drifts, weights, covered = [], [], 0
    for c in range(len(borders) - 1):
        own = label == c
        if own.sum() >= s.iqr_points:
            low, mid, high = np.percentile(hr[own], [25, 50, 75])
            odd = own & ((hr < low - s.outlier_iqr * (high - low)) | (hr > high + s.outlier_iqr * (high - low)))
            clean[odd] = mid
        runs = _runs(own, segment)
        covered += sum(b - a for a, b in runs)
        if len(runs) == 1:
            a, b = runs[0]
            runs = [(a, a + (b - a) // 2), (a + (b - a) // 2, b)]
        if len(runs) < 2:
            continue
        half = max(1, len(runs) // 2)
        early, late = (np.concatenate([clean[a:b] for a, b in part]) for part in (runs[:half], runs[half:]))
        if min(len(early), len(late)) < s.half_points or sum(b - a for a, b in runs) * step < s.class_s:
            continue
        start = np.median(early)
        if start > 0:
            drifts.append((np.median(late) - start) / start * 100.0)
            weights.append(int(own.sum()))
    out = {"pct": None, "severity": None, "significant": False, "quality": "low", "classes": len(borders) - 1, "fit": round(fit, 4)}
    if not drifts:
        return out
    pct = float(np.average(drifts, weights=weights))
    consistency = float(np.mean([d > 0 for d in drifts]))
    seconds = covered * step
    severity = "stable" if pct <= 0 else next((name for limit, name in s.severity if pct < limit), "severe")
    return out | {
        "pct": round(pct, 2),
        "severity": severity,
        "significant": pct > 0 and pct >= threshold and consistency >= s.consistency,
        "quality": "good" if seconds >= s.good_s else "fair" if seconds >= s.fair_s else "low",
    }


SCHEMA = (
    "activity_id long, cardiac_drift_pct double, cardiac_drift_severity string, "
    "cardiac_drift_significant boolean, cardiac_drift_quality string, n_classes int, fit double"
)


def cardiac_drift(samples: DataFrame, sports: DataFrame | None = None) -> DataFrame:
    """One row for each activity with enough moving samples; a grouped function, as no built-in finds natural breaks.

    Windows thin each activity to at most 600 samples, so a group's size has a bound.
    ``sports``: (activity_id, sport_type), for the sport's threshold.
    """
    rows = samples.filter((F.col("velocity") > MOVING_VELOCITY) & F.col("heartrate").isNotNull())
    every, most = Window.partitionBy("activity_id"), DriftSettings().most_points
    rows = rows.select(
        "activity_id",
        "time_offset",
        "heartrate",
        "velocity",
        F.count(F.lit(1)).over(every).alias("n"),
        (F.row_number().over(every.orderBy("time_offset", "velocity", "heartrate")) - 1).alias("k"),
    ).filter(F.col("n") >= MIN_STREAM_POINTS)
    rows = rows.withColumn("step", F.greatest(F.floor(F.col("n") / most), F.lit(1)))
    rows = rows.filter((F.col("k") % F.col("step") == 0) & (F.col("k") < F.col("step") * most)).drop("n", "time_offset")
    rows = rows.join(sports, "activity_id", "left") if sports is not None else rows.withColumn("sport_type", F.lit("Run"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        limit = DRIFT_THRESHOLDS.get(pdf["sport_type"].iloc[0], DRIFT_DEFAULT_THRESHOLD)
        found = thinned_drift(pdf["heartrate"].to_numpy(float), pdf["velocity"].to_numpy(float), int(pdf["step"].iloc[0]), limit)
        return pd.DataFrame([(pdf["activity_id"].iloc[0], *found.values())], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.groupBy("activity_id").applyInPandas(one, SCHEMA)
