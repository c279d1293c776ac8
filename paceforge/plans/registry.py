"""Metrics that can be aggregated: how, from which facts, over which columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODES = (
    "sum", "kudos_count", "calendar_average", "weighted_average", "ratio_of_sums", "quantile", "last_state", "distribution",
)
SOURCES = ("activity", "social", "daily", "model", "rolling", "historical")


@dataclass(frozen=True)
class Metric:
    """``value`` and the other fields are columns of the source; ``scale`` divides the value."""

    metric_id: str
    mode: str
    source: str
    value: str
    unit: str = ""
    scale: float = 1.0
    weight: str | None = None
    sample: str = "activity_count"
    scopes: tuple[str, ...] = ("global", "per_sport")
    window_days: int | None = None
    fixed_window: bool = False


    @property
    def calculation(self) -> str:
        """What is computed, in words."""
        value = f"{self.value} / {self.scale:g}" if self.scale != 1.0 else self.value
        over = f" by {self.weight}" if self.weight else " over the days of the range" if self.mode == "calendar_average" else ""
        window = f", windows of {self.window_days} days" if self.window_days else ""
        return f"{self.mode.replace('_', ' ')} of {value}{over} in {self.source} facts{window}"


_BOTH, _GLOBAL, _SPORT = ("global", "per_sport"), ("global",), ("per_sport",)


def _m(metric_id: str, mode: str, source: str, value: str, scopes: tuple[str, ...], unit: str = "", **more) -> Metric:
    return Metric(metric_id, mode, source, value, unit, scopes=scopes, **more)


#: The metrics, their modes, sources, columns and scopes.
_ALL = [
    _m("sport_type", "distribution", "activity", "sport_type", _BOTH),
    _m("kudos_count", "kudos_count", "social", "kudos_count", _BOTH),
    _m("distance_km", "sum", "activity", "distance_m", _BOTH, "km", scale=1000.0),
    _m("calories", "sum", "activity", "calories_kcal", _BOTH, "kcal"),
    _m("moving_time_min", "sum", "activity", "moving_time_s", _BOTH, "min", scale=60.0),
    _m("elapsed_time_min", "sum", "activity", "elapsed_time_s", _BOTH, "min", scale=60.0),
    _m("elevation_m", "sum", "activity", "elevation_gain_m", _BOTH, "m"),
    _m("trimp", "sum", "activity", "trimp", _GLOBAL),
    _m("avg_hr", "weighted_average", "activity", "avg_hr", _SPORT, "bpm", weight="heartrate_sample_count", sample="heartrate_sample_count"),
    _m("max_hr", "quantile", "activity", "max_hr", _SPORT, "bpm", sample="heartrate_sample_count"),
    _m("time_in_hr_zones_min", "distribution", "activity", "hr_zones", _BOTH, "min", sample="heartrate_sample_count"),
    _m("hr_recovery_median_bpm_per_min", "quantile", "activity", "hr_recovery_median_rate", _SPORT, "bpm/min"),
    _m("vertical_speed_m_per_h", "ratio_of_sums", "activity", "vertical_speed_total_ascent_m", _SPORT, "m/h", weight="vertical_speed_duration_hours"),
    _m("cardiac_cost", "quantile", "activity", "cardiac_cost", _SPORT),
    _m("cardiac_cost_adjusted", "quantile", "activity", "adjusted_cardiac_cost", _SPORT),
    _m("cardiac_drift_pct", "quantile", "activity", "cardiac_drift_pct", _SPORT, "%"),
    _m("cardiac_drift_severity", "distribution", "activity", "cardiac_drift_severity", _SPORT),
    _m("cardiac_drift_significant", "sum", "activity", "cardiac_drift_significant", _SPORT),
    _m("cardiac_drift_quality", "distribution", "activity", "cardiac_drift_quality", _SPORT),
    _m("hrr_pct", "quantile", "activity", "hrr_pct", _SPORT, "%"),
    _m("total_trimp_14d", "sum", "daily", "effective_trimp", _GLOBAL, sample="calendar_day_count"),
    _m("avg_trimp_per_day", "calendar_average", "daily", "effective_trimp", _GLOBAL, sample="calendar_day_count"),
    _m("active_days", "sum", "daily", "active_day_count", _GLOBAL, "d", sample="calendar_day_count"),
    _m("rest_days", "sum", "daily", "rest_day_count", _GLOBAL, "d", sample="calendar_day_count"),
    _m("weekly_trimp", "sum", "daily", "effective_trimp", _GLOBAL, sample="calendar_day_count"),
    _m("fitness", "last_state", "model", "fitness", _GLOBAL, sample="model_day_count"),
    _m("fatigue", "last_state", "model", "fatigue", _GLOBAL, sample="model_day_count"),
    _m("form", "last_state", "model", "form", _GLOBAL, sample="model_day_count"),
    _m("form_zone", "distribution", "model", "form_zone", _GLOBAL, sample="model_day_count"),
    _m("acwr", "last_state", "model", "acwr", _GLOBAL, sample="model_day_count"),
    _m("acwr_zone", "distribution", "model", "acwr_zone", _GLOBAL, sample="model_day_count"),
    _m("daily_avg_trimp_7d", "calendar_average", "rolling", "daily_avg_trimp", _GLOBAL, window_days=7, fixed_window=True, sample="rolling_sample_count"),
    _m("daily_avg_trimp_28d", "calendar_average", "rolling", "daily_avg_trimp", _GLOBAL, window_days=28, fixed_window=True, sample="rolling_sample_count"),
    _m("daily_avg_trimp_90d", "calendar_average", "rolling", "daily_avg_trimp", _GLOBAL, window_days=90, fixed_window=True, sample="rolling_sample_count"),
    _m("rolling_median_cc", "quantile", "rolling", "median_cardiac_cost", _SPORT, window_days=90, sample="rolling_sample_count"),
    _m("rolling_median_cc_adj", "quantile", "rolling", "median_adjusted_cardiac_cost", _SPORT, window_days=90, sample="rolling_sample_count"),
    _m("rolling_median_hr_recovery", "quantile", "rolling", "median_hr_recovery", _SPORT, window_days=90, sample="rolling_sample_count"),
    _m("rolling_median_cardiac_drift_pct", "quantile", "rolling", "median_cardiac_drift_pct", _SPORT, window_days=90, sample="rolling_sample_count"),
    _m("volume_7d", "last_state", "rolling", "activity_count", _GLOBAL, window_days=7, fixed_window=True, sample="rolling_sample_count"),
    _m("volume_28d", "last_state", "rolling", "activity_count", _GLOBAL, window_days=28, fixed_window=True, sample="rolling_sample_count"),
    _m("activity_streak_days", "last_state", "historical", "activity_streak_days", _GLOBAL, "d", sample="calendar_day_count"),
    _m("rest_streak_days", "last_state", "historical", "rest_streak_days", _GLOBAL, "d", sample="calendar_day_count"),
    _m("last_hike_days_ago", "last_state", "historical", "last_hike_days_ago", _GLOBAL, "d", sample="calendar_day_count"),
]
REGISTRY: dict[str, Metric] = {m.metric_id: m for m in _ALL}

#: What a row of each metric names as its denominator.
DENOMINATORS: dict[str, str] = {
    "sport_type": "activity_count",
    "kudos_count": "activity_count",
    "distance_km": "distance_m",
    "calories": "calories_kcal",
    "moving_time_min": "moving_time_s",
    "elapsed_time_min": "elapsed_time_s",
    "elevation_m": "elevation_gain_m",
    "trimp": "trimp",
    "avg_hr": "heartrate_sample_count",
    "max_hr": "heartrate_sample_count",
    "time_in_hr_zones_min": "heartrate_sample_count",
    "hr_recovery_median_bpm_per_min": "activity_sample_count",
    "vertical_speed_m_per_h": "vertical_speed_duration_hours",
    "cardiac_cost": "activity_sample_count",
    "cardiac_cost_adjusted": "activity_sample_count",
    "cardiac_drift_pct": "activity_sample_count",
    "cardiac_drift_severity": "activity_count",
    "cardiac_drift_significant": "cardiac_drift_significant",
    "cardiac_drift_quality": "activity_count",
    "hrr_pct": "activity_sample_count",
    "total_trimp_14d": "effective_trimp",
    "avg_trimp_per_day": "calendar_days",
    "active_days": "active_day_count",
    "rest_days": "rest_day_count",
    "weekly_trimp": "effective_trimp",
    "fitness": "latest_day",
    "fatigue": "latest_day",
    "form": "latest_day",
    "form_zone": "model_day_count",
    "acwr": "latest_day",
    "acwr_zone": "model_day_count",
    "daily_avg_trimp_7d": "calendar_days",
    "daily_avg_trimp_28d": "calendar_days",
    "daily_avg_trimp_90d": "calendar_days",
    "rolling_median_cc": "rolling_sample_count",
    "rolling_median_cc_adj": "rolling_sample_count",
    "rolling_median_hr_recovery": "rolling_sample_count",
    "rolling_median_cardiac_drift_pct": "rolling_sample_count",
    "volume_7d": "latest_day",
    "volume_28d": "latest_day",
    "activity_streak_days": "latest_day",
    "rest_streak_days": "latest_day",
    "last_hike_days_ago": "latest_day",
}

#: The metrics of each bundle.
BUNDLES: dict[str, tuple[str, ...]] = {
    "daily_brief": (
        "fitness", "fatigue", "form", "form_zone", "acwr", "acwr_zone", "weekly_trimp", "total_trimp_14d",
        "avg_trimp_per_day", "active_days", "rest_days", "daily_avg_trimp_7d", "rolling_median_cc",
        "rolling_median_hr_recovery", "kudos_count",
    ),
    "weekly_digest": (
        "trimp", "distance_km", "calories", "moving_time_min", "elapsed_time_min", "elevation_m", "active_days",
        "weekly_trimp", "volume_7d", "avg_hr", "max_hr", "cardiac_cost", "cardiac_cost_adjusted", "cardiac_drift_pct",
        "hrr_pct",
    ),
    "monthly_digest": (
        "trimp", "distance_km", "calories", "moving_time_min", "elevation_m", "active_days", "volume_28d",
        "daily_avg_trimp_28d", "daily_avg_trimp_90d", "fitness", "fatigue", "form",
    ),
    "period_comparison": (
        "trimp", "distance_km", "calories", "moving_time_min", "elapsed_time_min", "elevation_m", "active_days",
        "rest_days", "fitness", "fatigue", "form", "acwr", "avg_hr", "max_hr", "hr_recovery_median_bpm_per_min",
        "vertical_speed_m_per_h", "cardiac_cost", "cardiac_cost_adjusted", "cardiac_drift_pct", "hrr_pct",
        "cardiac_drift_significant", "time_in_hr_zones_min",
    ),
    "sport_efficiency": (
        "avg_hr", "hr_recovery_median_bpm_per_min", "vertical_speed_m_per_h", "cardiac_cost", "cardiac_cost_adjusted",
        "cardiac_drift_pct", "hrr_pct", "rolling_median_cc", "rolling_median_cc_adj", "rolling_median_hr_recovery",
        "rolling_median_cardiac_drift_pct",
    ),
    "historical_facts": (
        "sport_type", "form_zone", "acwr_zone", "cardiac_drift_severity", "cardiac_drift_quality", "kudos_count",
        "active_days", "activity_streak_days", "rest_streak_days", "last_hike_days_ago",
    ),
}


def metrics(ids: list[str] | tuple[str, ...] | None = None, bundle: str | None = None) -> list[Metric]:
    """Definitions by id or bundle; raises ValueError for both, neither or an unknown name."""
    if bool(ids) == bool(bundle):
        raise ValueError("give metric ids or a bundle, not both")
    if bundle is not None and bundle not in BUNDLES:
        raise ValueError(f"unknown bundle: {bundle}")
    wanted = BUNDLES[bundle] if bundle else ids
    if unknown := [i for i in wanted if i not in REGISTRY]:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    return [REGISTRY[i] for i in wanted]


def catalog(spark: SparkSession) -> DataFrame:
    """The registry as a table."""
    rows = [(m.metric_id, m.mode, m.source, m.value, m.unit, ",".join(m.scopes), m.window_days) for m in _ALL]
    return spark.createDataFrame(
        rows, "metric_id string, mode string, source string, value string, unit string, scopes string, window_days int"
    )
