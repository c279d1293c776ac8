"""The metric layer: (metrics, bucket, range, scope, sport) to rows.

All metrics of one fact source share one scan and one aggregation; scope "both"
is a pair of grouping sets.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceforge.constants import ROLLING_WINDOWS, SPORTS
from paceforge.functions.scalars import BUCKETS, bucket_next, bucket_start
from paceforge.plans.registry import DENOMINATORS, Metric, metrics

SCOPES = ("global", "per_sport", "both")


@dataclass(frozen=True)
class AggregateRequest:
    """Days are a half-open range; None takes the source's first day, or the day after its last.

    ``window_days`` and ``as_of_day``, both or none: the stored window that ends on that day.
    """

    metric_ids: tuple[str, ...] = ()
    bundle: str | None = None
    bucket: str = "all_time"
    start: date | None = None
    end: date | None = None
    scope: str = "global"
    sport: str | None = None
    metric_version: int = 1
    window_days: int | None = None
    include_empty: bool = False
    as_of_day: date | None = None

    def validated(self) -> list[Metric]:
        """The metrics asked for; raises ValueError for a request that the facts cannot answer."""
        if self.bucket not in BUCKETS:
            raise ValueError(f"unknown bucket: {self.bucket}")
        if self.scope not in SCOPES:
            raise ValueError(f"unknown scope: {self.scope}")
        if self.start and self.end and self.start >= self.end:
            raise ValueError("start must lie before end")
        if self.sport is not None and self.sport not in _SPORTS:
            raise ValueError(f"unknown sport: {self.sport}")
        if (self.window_days is None) != (self.as_of_day is None):
            raise ValueError("window_days and as_of_day go together")
        if self.window_days is not None and self.window_days not in ROLLING_WINDOWS:
            raise ValueError(f"unknown window: {self.window_days} days")
        wanted = metrics(self.metric_ids, self.bundle)
        for m in wanted:
            if self.scope != "both" and self.scope not in m.scopes:
                raise ValueError(f"metric {m.metric_id} has no scope {self.scope}")
            if self.window_days is None:
                continue
            if m.source != "rolling":
                raise ValueError(f"metric {m.metric_id} has no windows")
            if m.fixed_window and m.window_days != self.window_days:
                raise ValueError(f"metric {m.metric_id} has a window of {m.window_days} days only")
        return wanted

    def scope_of(self, m: Metric) -> str:
        return self.scope if self.scope != "both" or len(m.scopes) > 1 else m.scopes[0]


_SPORTS = {s[0] for s in SPORTS}


def prepared(facts: DataFrame, source: str) -> DataFrame:
    """A fact table with the columns that the metric layer expects: source_day, counts and indicators."""
    one = F.lit(1).cast("long")
    if source in ("activity", "social"):
        return facts.withColumn("source_day", F.col("activity_day")).withColumn("activity_count", one)
    if source == "daily":
        active = F.col("activity_count") > 0
        return (
            facts.withColumn("source_day", F.col("day"))
            .withColumn("active_day_count", F.when(active, one).otherwise(0))
            .withColumn("rest_day_count", F.when(active, 0).otherwise(one))
            .withColumn("calendar_day_count", one)
        )
    if source == "model":
        return facts.withColumns({"source_day": F.col("day"), "model_day_count": one, "activity_count": F.lit(0).cast("long")})
    if source == "rolling":
        return facts.withColumns(
            {
                "source_day": F.col("as_of_day"),
                "rolling_sample_count": F.col("activity_count"),
                "daily_avg_trimp": F.col("effective_trimp") / F.nullif(F.col("window_days"), F.lit(0)),
            }
        )
    if source == "historical":
        return facts.withColumns({"source_day": F.col("day"), "calendar_day_count": one})
    raise ValueError(f"unknown source: {source}")


def _value(m: Metric) -> Column:
    v = F.col(m.value).cast("double")
    return v / F.lit(m.scale) if m.scale != 1.0 else v


def _named(m: Metric) -> list[Column]:
    """What a row says of its metric."""
    said = {"metric_id": m.metric_id, "mode": m.mode, "unit": m.unit, "calculation": m.calculation, "denominator": DENOMINATORS[m.metric_id]}
    return [F.lit(v).alias(c) for c, v in said.items()]


def measure(m: Metric, days: Column) -> Column:
    """The aggregate of one metric; ``days``: length of the effective range."""
    v = _value(m)
    w = F.col(m.weight).cast("double") if m.weight else F.lit(None).cast("double")
    if m.mode in ("sum", "kudos_count"):
        return F.sum(v)
    if m.mode == "calendar_average":
        return F.sum(v) / F.nullif(days, F.lit(0))
    if m.mode == "weighted_average":
        counts = v.isNotNull() & (w > 0)
        return F.sum(F.when(counts, v * w)) / F.nullif(F.sum(F.when(counts, w)), F.lit(0.0))
    if m.mode == "ratio_of_sums":
        return F.sum(v) / F.nullif(F.sum(w), F.lit(0.0))
    if m.mode == "quantile":
        return F.percentile(v, F.lit(0.5))
    if m.mode == "last_state":
        return F.max_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), F.col("source_day")))
    raise ValueError(f"no single value for mode {m.mode}")


def _in_range(facts: DataFrame, m: Metric, r: AggregateRequest, scope: str) -> DataFrame:
    rows = facts.filter(F.col("metric_version") == r.metric_version)
    of_sport = m.source == "rolling" and scope == "per_sport"
    if m.source in ("daily", "model", "rolling") and "scope" in facts.columns:
        rows = rows.filter(F.col("scope") == ("sport" if of_sport else "all"))
    if m.source == "rolling":
        rows = rows.filter(F.col("window_days") == (r.window_days or m.window_days))
    if r.sport and (of_sport or m.source in ("activity", "social")):
        rows = rows.filter(F.col("sport_type") == r.sport)
    if r.as_of_day:
        return rows.filter(F.col("source_day") == F.lit(r.as_of_day))
    if r.start:
        rows = rows.filter(F.col("source_day") >= F.lit(r.start))
    if r.end:
        rows = rows.filter(F.col("source_day") < F.lit(r.end))
    return rows


def _grouped(rows: DataFrame, scope: str):
    if scope == "global":
        return rows.groupBy("bucket_start")
    if scope == "per_sport":
        return rows.groupBy("bucket_start", "sport_type")
    return rows.groupingSets([["bucket_start"], ["bucket_start", "sport_type"]], "bucket_start", "sport_type")


def _bounds(rows: DataFrame, r: AggregateRequest, activity: DataFrame | None = None) -> tuple[Column, Column]:
    """Effective range; open ends need the source's own days, which is one small aggregation.

    A source without rows takes the days of the activities.
    """
    if r.as_of_day:
        return F.lit(r.as_of_day - timedelta(days=r.window_days - 1)), F.lit(r.as_of_day + timedelta(days=1))
    if r.start and r.end:
        return F.lit(r.start), F.lit(r.end)
    ends = lambda df, day: df.agg(F.min(day), F.date_add(F.max(day), 1)).first()
    found = ends(rows, "source_day")
    if found[0] is None and activity is not None:
        found = ends(activity, "activity_day")
    return F.lit(r.start or found[0]).cast("date"), F.lit(r.end or found[1]).cast("date")


def aggregate(sources: dict[str, DataFrame], request: AggregateRequest) -> DataFrame:
    """One row for each metric, bucket and group, with the columns that tell its quality.

    Ordered by bucket, metric and sport.  Raises ValueError if the facts lack a metric's column.
    """
    wanted = [m for m in request.validated() if m.mode != "distribution"]
    if not wanted:
        raise ValueError("only distributions asked for; use distribution()")
    parts = []
    groups: dict[tuple, list[Metric]] = {}
    for m in wanted:
        groups.setdefault((m.source, m.window_days, m.scopes), []).append(m)
    for (source, _, _), own in groups.items():
        parts.append(_aggregated(_with_columns_of(prepared(sources[source], source), own), own, request, request.scope_of(own[0]), sources.get("activity")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("bucket_start", "metric_id", F.coalesce("sport_type", F.lit("")))


def _with_columns_of(facts: DataFrame, own: list[Metric]) -> DataFrame:
    """The facts, if they have every column of these metrics."""
    for m in own:
        value = ("zone1_seconds",) if m.value == "hr_zones" else (m.value,)
        if lacking := [c for c in (*value, m.weight, m.sample) if c and c not in facts.columns]:
            raise ValueError(f"the facts lack {', '.join(lacking)} of metric {m.metric_id}")
    return facts


def _aggregated(facts: DataFrame, own: list[Metric], r: AggregateRequest, scope: str, activity: DataFrame | None = None) -> DataFrame:
    rows = _in_range(facts, own[0], r, scope)
    start, end = _bounds(rows, r, activity)
    rows = rows.withColumn("bucket_start", start if r.as_of_day else bucket_start(F.col("source_day"), r.bucket, start))
    days = F.datediff(end, start)
    entries = []
    for m in own:
        v = _value(m)
        w = F.col(m.weight).cast("double") if m.weight else None
        quantiles = F.percentile(v, F.array(F.lit(0.25), F.lit(0.75))) if m.mode == "quantile" else None
        none = F.lit(None).cast("double")
        entries.append(
            F.struct(
                *_named(m),
                measure(m, days).alias("value"),
                (quantiles[0] if quantiles is not None else none).alias("p25"),
                (quantiles[1] if quantiles is not None else none).alias("p75"),
                F.count_if(v.isNull()).alias("null_count"),
                (F.count_if(F.coalesce(w <= 0, F.lit(True))) if w is not None else F.lit(0).cast("long")).alias("excluded_count"),
                F.coalesce(F.sum(F.col(m.sample).cast("double")), F.lit(0.0)).alias("sample_size"),
                (F.coalesce(F.sum(w), F.lit(0.0)) if w is not None else F.lit(0.0)).alias("denominator_sum"),
            )
        )
    reasons = F.array_sort(F.array_distinct(F.flatten(F.collect_set("missing_reasons"))))
    grouped = _grouped(rows, scope).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum("activity_count"), F.lit(0)).alias("activity_count"),
        F.count_distinct("metric_version").alias("metric_version_count"),
        F.bool_or(F.col("completeness_status") != "complete").alias("incomplete"),
        (F.max("computed_at") if "computed_at" in rows.columns else F.lit(None).cast("string")).alias("materialized_at"),
        reasons.alias("reasons"),
        F.array(*entries).alias("entries"),
    )
    sport = F.col("sport_type") if scope != "global" else F.lit(r.sport).cast("string")
    flat = grouped.withColumn("sport", sport).select(
        "bucket_start", "sport", "row_count", "activity_count", "metric_version_count", "incomplete", "materialized_at", "reasons", F.inline("entries")
    )
    whole = r.bucket == "all_time" or r.as_of_day is not None
    flat = flat.withColumn("half", _half(scope))
    if r.include_empty or whole:
        flat = _with_empty(flat, own, r, scope, start, end, whole)
    return _shaped(flat, r, end)


def _half(scope: str) -> Column:
    """Which of the two requests a row of scope "both" answers; the rows of all sports have no sport."""
    return F.lit(scope) if scope != "both" else F.when(F.col("sport").isNull(), "global").otherwise("per_sport")


def _with_empty(
    flat: DataFrame, own: list[Metric], r: AggregateRequest, scope: str, start: Column, end: Column, whole: bool
) -> DataFrame:
    """Rows without facts, for both halves of scope "both" alike.

    A whole range or window has at least one row of each metric, with the sport asked for; of other buckets each
    has one of no sport, or of the sport asked for, so by sport and without a filter every bucket has one besides
    those of its sports.  The aggregation is planned once: fillers join its rows, and go where a row is in their place.
    """
    spine = flat.sparkSession.range(1)
    if whole:
        spine = spine.select(start.cast("date").alias("bucket_start")).filter("bucket_start IS NOT NULL")
    else:
        step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "year": "interval 1 year"}[r.bucket]
        first, last = bucket_start(start, r.bucket), F.date_sub(end, 1)
        spine = spine.select(F.explode(F.sequence(first, last, F.expr(step))).alias("bucket_start"))
    names = F.array(*[F.struct(*_named(m)) for m in own])
    halves = ("global", "per_sport") if scope == "both" else (scope,)
    sport_of = lambda half: r.sport if half == "per_sport" or (whole and scope == "global") else None
    sides = F.array(*[F.struct(F.lit(h).alias("half"), F.lit(sport_of(h)).cast("string").alias("sport")) for h in halves])
    fillers = spine.select("bucket_start", F.inline(names), F.explode(sides).alias("side")).select("*", "side.*").drop("side")
    rows = flat.withColumn("real", F.lit(True)).unionByName(fillers.withColumn("real", F.lit(False)), allowMissingColumns=True)
    place = ["metric_id", "half"] if whole else ["metric_id", "half", "bucket_start", "sport"]
    seen = F.bool_or("real").over(Window.partitionBy(*place))
    return rows.withColumn("seen", seen).filter("real OR NOT seen").drop("real", "seen")


def _shaped(flat: DataFrame, r: AggregateRequest, end: Column) -> DataFrame:
    n = F.coalesce("row_count", F.lit(0))
    missing = F.coalesce("reasons", F.array().cast("array<string>"))
    missing = F.when(n == 0, F.array(F.lit("no_facts"))).when(
        F.col("excluded_count") > 0, F.array_sort(F.array_union(missing, F.array(F.lit("missing_denominator"))))
    ).otherwise(missing)
    partial = F.col("incomplete") | (F.col("null_count") > 0) | (F.col("excluded_count") > 0)
    status = F.when((n == 0) | F.col("value").isNull(), "unavailable").when(partial, "partial").otherwise("complete")
    versions = F.coalesce("metric_version_count", F.lit(0))
    last = end if r.bucket == "all_time" or r.as_of_day else bucket_next(F.col("bucket_start"), r.bucket)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return flat.select(
        "metric_id",
        F.col("mode").alias("aggregation_mode"),
        "unit",
        "calculation",
        "denominator",
        "bucket_start",
        last.alias("bucket_end"),
        F.lit(f"rolling_{r.window_days}d" if r.window_days else r.bucket).alias("bucket_width"),
        F.lit(r.scope).alias("scope") if r.scope != "both" else F.col("half").alias("scope"),
        F.col("sport").alias("sport_type"),
        "value",
        "p25",
        "p75",
        zero("row_count"),
        zero("activity_count"),
        zero("null_count"),
        zero("excluded_count"),
        F.coalesce("sample_size", F.lit(0.0)).alias("sample_size"),
        F.coalesce("denominator_sum", F.lit(0.0)).alias("denominator_sum"),
        status.alias("completeness_status"),
        missing.alias("missing_reasons"),
        F.when(versions == 0, "unavailable").when(versions == 1, "single").otherwise("mixed_degraded").alias("metric_version_status"),
        "materialized_at",
    )


def distribution(sources: dict[str, DataFrame], request: AggregateRequest) -> DataFrame:
    """Long rows (metric_id, bucket_start, sport_type, category, amount) of the distributions asked for."""
    parts = []
    for m in [m for m in request.validated() if m.mode == "distribution"]:
        scope = request.scope_of(m)
        rows = _in_range(_with_columns_of(prepared(sources[m.source], m.source), [m]), m, request, scope)
        start, _ = _bounds(rows, request)
        rows = rows.withColumn("bucket_start", bucket_start(F.col("source_day"), request.bucket, start))
        if m.value == "hr_zones":
            zones = F.array(
                *[
                    F.struct(F.lit(f"z{k}").alias("category"), (F.sum(f"zone{k}_seconds") / F.lit(60.0)).alias("amount"))
                    for k in range(1, 6)
                ]
            )
            out = _grouped(rows, scope).agg(zones.alias("z")).select("*", F.inline("z"))
        else:
            rows = rows.filter(F.col(m.value).isNotNull()).withColumn("category", F.col(m.value).cast("string"))
            keys = {"global": [[]], "per_sport": [["sport_type"]], "both": [[], ["sport_type"]]}[scope]
            sets = [["bucket_start", *k, "category"] for k in keys]
            columns = ["bucket_start", *(["sport_type"] if scope != "global" else []), "category"]
            out = rows.groupingSets(sets, *columns).agg(F.count(F.lit(1)).cast("double").alias("amount"))
        sport = F.col("sport_type") if scope != "global" else F.lit(request.sport).cast("string")
        parts.append(out.select(F.lit(m.metric_id).alias("metric_id"), "bucket_start", sport.alias("sport_type"), "category", "amount"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
