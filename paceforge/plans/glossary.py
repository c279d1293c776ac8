"""Concepts of the domain, in our own words, with the metrics that measure them."""

from __future__ import annotations

from paceforge.plans.registry import REGISTRY

CONCEPTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "training load": ("Minutes in each heart-rate zone, weighted by how hard the zone is.", ("trimp", "weekly_trimp", "avg_trimp_per_day")),
    "fitness and fatigue": ("Slow and fast exponential means of daily load; form is their difference.", ("fitness", "fatigue", "form", "form_zone")),
    "workload ratio": ("Fatigue over fitness: how much more than usual was done of late.", ("acwr", "acwr_zone")),
    "cardiac cost": ("Heartbeats a minute for each metre a second.", ("cardiac_cost", "cardiac_cost_adjusted")),
    "cardiac drift": ("Rise of the heart rate at like pace within one activity.", ("cardiac_drift_pct", "cardiac_drift_severity", "cardiac_drift_quality")),
    "recovery": ("How fast the heart rate falls while standing.", ("hr_recovery_median_bpm_per_min",)),
    "consistency": ("Days in a row with, or without, activity.", ("activity_streak_days", "rest_streak_days", "active_days", "rest_days")),
}


def validate() -> None:
    """Raises ValueError if a concept names an unknown metric."""
    unknown = sorted({m for _, ids in CONCEPTS.values() for m in ids if m not in REGISTRY})
    if unknown:
        raise ValueError(f"unknown metrics in the glossary: {', '.join(unknown)}")


def render() -> str:
    return "\n".join(f"## {name}\n\n{text}\n\nMetrics: {', '.join(ids)}\n" for name, (text, ids) in sorted(CONCEPTS.items()))
