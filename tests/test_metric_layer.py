"""The metric layer and services on a few hand-made facts."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from paceforge.plans import bundles, facts, glossary, registry, services, status
from paceforge.plans.aggregate import AggregateRequest, aggregate, distribution

START, END = date(2026, 5, 1), date(2026, 5, 28)
COLUMNS = """activity_id long, activity_day date, sport_type string, distance_m double, moving_time_s long, elevation_gain_m double,
avg_hr double, max_hr double, kudos_count double, metric_version long, trimp double, completeness_status string, cardiac_cost double,
vertical_speed_total_ascent_m double, vertical_speed_duration_hours double, heartrate_sample_count long"""
ROWS = [
    (101, date(2026, 5, 5), "Run", 10000.0, 3600, 100.0, 140.0, 170.0, 2.0, 1, 100.0, "complete", 40.0, 200.0, 1.0, 100),
    (102, date(2026, 5, 12), "Run", 5000.0, 1800, 50.0, 160.0, 180.0, 0.0, 1, 80.0, "partial", 50.0, 300.0, 2.0, 300),
    (103, date(2026, 5, 13), "Run", 6000.0, 2000, 200.0, 150.0, 175.0, 1.0, 1, 70.0, "complete", 60.0, 100.0, 1.0, 200),
    (106, date(2026, 5, 13), "Run", 6000.0, 2000, 200.0, 150.0, 175.0, 1.0, 2, 12345.0, "complete", 60.0, 100.0, 1.0, 200),
    (104, date(2026, 5, 20), "Hike", 8000.0, 7200, 500.0, None, None, 3.0, 1, 60.0, "partial", None, 500.0, 2.0, 0),
]


@pytest.fixture(scope="module")
def activity(spark):
    df = spark.createDataFrame(ROWS, COLUMNS)
    reasons = F.when(F.col("completeness_status") == "partial", F.array(F.lit("missing_hr"))).otherwise(F.array().cast("array<string>"))
    zones = {f"zone{k}_seconds": F.lit(60 * k) for k in range(1, 6)}
    return df.withColumn("missing_reasons", reasons).withColumns(zones)


def _ask(sources, *ids, **more):
    return {(r.metric_id, r.bucket_start, r.sport_type): r for r in aggregate(sources, AggregateRequest(ids, **({"start": START, "end": END} | more))).collect()}


def test_goldens(activity):
    s = {"activity": activity, "social": activity}
    found = _ask(s, "distance_km", "trimp")
    assert found[("distance_km", START, None)].value == 29.0
    row = found[("trimp", START, None)]
    assert row.value == 310.0 and row.metric_version_status == "single" and row.completeness_status == "partial"
    assert row.missing_reasons == ["missing_hr"] and row.row_count == 4
    run = _ask(s, "avg_hr", "vertical_speed_m_per_h", "cardiac_cost", scope="per_sport", sport="Run")
    assert run[("avg_hr", START, "Run")].value == pytest.approx((140 * 100 + 160 * 300 + 150 * 200) / 600)
    assert run[("vertical_speed_m_per_h", START, "Run")].value == 600 / 4
    q = run[("cardiac_cost", START, "Run")]
    assert (q.p25, q.value, q.p75) == (45.0, 50.0, 55.0)
    hike = _ask(s, "avg_hr", scope="per_sport")[("avg_hr", START, "Hike")]
    assert hike.completeness_status == "unavailable" and hike.missing_reasons == ["missing_denominator", "missing_hr"]
    assert _ask({"social": activity}, "kudos_count")[("kudos_count", START, None)].value == 6.0


def test_buckets_and_empty_ones(activity):
    weeks = _ask({"activity": activity}, "trimp", bucket="week")
    assert [k[1] for k in sorted(weeks)] == [date(2026, 5, 4), date(2026, 5, 11), date(2026, 5, 18)]
    assert weeks[("trimp", date(2026, 5, 18), None)].bucket_end == date(2026, 5, 25)
    days = _ask({"activity": activity}, "trimp", bucket="day", start=date(2026, 5, 5), end=date(2026, 5, 8), include_empty=True)
    rows = [days[k] for k in sorted(days)]
    assert [r.value for r in rows] == [100.0, None, None]
    assert [r.completeness_status for r in rows] == ["complete", "unavailable", "unavailable"]
    assert rows[1].missing_reasons == ["no_facts"] and rows[1].metric_version_status == "unavailable"


def test_bucket_sums_add_up(activity):
    total = _ask({"activity": activity}, "distance_km")[("distance_km", START, None)].value
    for bucket in ("day", "week", "month", "year"):
        assert sum(r.value for r in _ask({"activity": activity}, "distance_km", bucket=bucket).values()) == pytest.approx(total)
    both = _ask({"activity": activity}, "distance_km", scope="both")
    assert both[("distance_km", START, None)].value == both[("distance_km", START, "Run")].value + both[("distance_km", START, "Hike")].value


def test_distributions(activity):
    found = distribution({"activity": activity}, AggregateRequest(("sport_type", "time_in_hr_zones_min"), start=START, end=END)).collect()
    assert {(r.category, r.amount) for r in found if r.metric_id == "sport_type"} == {("Run", 3.0), ("Hike", 1.0)}
    assert {r.category: r.amount for r in found if r.metric_id == "time_in_hr_zones_min"} == {f"z{k}": 4.0 * k for k in range(1, 6)}


def test_daily_average_and_state(spark):
    daily = spark.createDataFrame(
        [(START + timedelta(days=k), "all", "all", 1, "observed", [], 1 if k in (4, 11, 12, 19) else 0, {4: 100.0, 11: 80.0, 12: 70.0, 19: 60.0}.get(k, 0.0)) for k in range(27)],
        "day date, scope string, sport_type string, metric_version long, completeness_status string, missing_reasons array<string>, activity_count long, effective_trimp double",
    )
    found = _ask({"daily": daily}, "avg_trimp_per_day", "active_days", "rest_days")
    assert found[("avg_trimp_per_day", START, None)].value == pytest.approx(310 / 27)
    assert (found[("active_days", START, None)].value, found[("rest_days", START, None)].value) == (4, 23)
    model = facts.model_facts(daily)
    last = model.orderBy(F.desc("day")).first()
    assert _ask({"model": model}, "fitness", "form")[("fitness", START, None)].value == last.fitness
    rolled = facts.rolling_facts(daily.withColumns({c: F.lit(0.0) for c in ("observed_trimp", "distance_m", "elevation_gain_m")} | {c: F.lit(0).cast("long") for c in ("moving_time_s", "high_zone_seconds", "anomaly_count")}))
    at = rolled.filter(F.col("as_of_day") == F.lit(START + timedelta(days=26)))
    assert {r.window_days: r.effective_trimp for r in at.collect()} == {7: 0.0, 14: 60.0, 28: 310.0, 42: 310.0, 90: 310.0}
    state = services.fitness_state(model, rolled, START + timedelta(days=12)).first()
    assert state.day == START + timedelta(days=12) and state.daily_avg_trimp_7d == round(150 / 7, 3) and state.volume_7d == 2


@pytest.mark.parametrize(
    "bad", [{"bucket": "hour"}, {"scope": "x"}, {"metric_ids": ("nope",)}, {"bundle": "daily_brief"}, {"metric_ids": ()}, {"start": END, "end": START}, {"metric_ids": (), "bundle": "x"}]
)
def test_requests_are_validated(activity, bad):
    with pytest.raises(ValueError):
        aggregate({"activity": activity}, AggregateRequest(**({"metric_ids": ("trimp",)} | bad)))


@pytest.mark.parametrize(
    "bad",
    [
        {"scope": "per_sport"}, {"metric_ids": ("avg_hr",)}, {"sport": "Chess"}, {"window_days": 7}, {"as_of_day": START}, {"window_days": 8, "as_of_day": START},
        {"window_days": 7, "as_of_day": START}, {"metric_ids": ("volume_7d",), "window_days": 28, "as_of_day": START}, {"metric_ids": ("calories",)},
    ],
)
def test_what_facts_cannot_answer_is_refused(activity, bad):
    with pytest.raises(ValueError):
        aggregate({"activity": activity}, AggregateRequest(**({"metric_ids": ("trimp",)} | bad)))


def test_a_range_without_facts_has_a_row(activity):
    rows = aggregate({"activity": activity}, AggregateRequest(("trimp", "distance_km"), start=date(2020, 1, 1), end=date(2020, 2, 1))).collect()
    assert [(r.metric_id, r.value, r.row_count, r.completeness_status, r.missing_reasons, r.bucket_start, r.bucket_end) for r in rows] == [
        (m, None, 0, "unavailable", ["no_facts"], date(2020, 1, 1), date(2020, 2, 1)) for m in ("distance_km", "trimp")
    ]


def test_rows_are_ordered(activity):
    rows = aggregate({"activity": activity}, AggregateRequest(("trimp", "distance_km"), start=START, end=END, bucket="week", scope="both")).collect()
    keys = [(r.bucket_start, r.metric_id, r.sport_type or "") for r in rows]
    assert keys == sorted(keys) and len(keys) > 6


def test_compare(activity):
    request = AggregateRequest(("distance_km", "trimp"), start=date(2026, 5, 11), end=date(2026, 5, 18))
    rows = {r.metric_id: r for r in services.compare_periods({"activity": activity}, request, (date(2026, 5, 4), date(2026, 5, 11))).collect()}
    r = rows["trimp"]
    assert (r.value_a, r.value_b, r.delta, r.delta_pct, r.trend, r.coverage_a, r.coverage_b) == (150.0, 100.0, 50.0, 50.0, "up", 0.5, 1.0)
    gone = services.compare_periods({"activity": activity}, request, (date(2020, 1, 1), date(2020, 2, 1))).collect()
    assert all(r.delta is None and r.trend == "unavailable" and r.coverage_b == 0.0 for r in gone)


def test_workouts(activity):
    rows = services.list_workouts(activity.filter("metric_version = 1"), 2, end=date(2026, 5, 13)).collect()
    assert [r.activity_id for r in rows] == [103, 102]
    for bad in (0, 201, True, 1.5):
        with pytest.raises(ValueError):
            services.list_workouts(activity, bad)
    assert services.workout_detail(activity).first().activity_id == 104
    spark = activity.sparkSession
    gear = spark.createDataFrame([(104, "Shoe", 5.0), (103, "Other", 6.0)], "id long, gear_name string, gear_distance_m double")
    kudos = spark.createDataFrame([(104, "Zoe", "B"), (104, "Ann", None), (103, "Eve", "C")], "activity_id long, firstname string, lastname string")
    whole = services.workout_detail(activity, None, gear, kudos).first()
    assert (whole.gear_name, whole.gear_distance_m, whole.kudos_names) == ("Shoe", 5.0, ["Ann", "Zoe B"])
    bare = services.workout_detail(activity, 104, gear.limit(0), kudos.limit(0)).first()
    assert (bare.activity_id, bare.gear_name, bare.kudos_names) == (104, None, [])
    assert [r.activity_id for r in services.page_after(activity.filter("metric_version = 1"), date(2026, 5, 13), 103, 9).collect()] == [102, 101]


def _status_facts(spark):
    rows = [
        (201, date(2026, 5, 19), "Hike", 420.0, 0, 0, 100, 100, 9000.0), (202, date(2026, 5, 20), "Hike", 430.0, 0, 0, 100, 100, 9000.0),
        (203, date(2026, 5, 18), "Run", 50.0, 360, 4, 0, 100, 12000.0), (204, date(2026, 5, 12), "Run", 50.0, 10, 0, 100, 100, 10000.0), (205, date(2026, 5, 13), "Run", 50.0, 0, 0, 100, 0, 1.0),
    ]
    df = spark.createDataFrame(rows, "activity_id long, activity_day date, sport_type string, trimp double, zone5_seconds long, anomaly_count long, heartrate_sample_count long, stream_sample_count long, distance_m double")
    return df.withColumns({"metric_version": F.lit(1).cast("long"), "cardiac_drift_significant": F.col("activity_id") == 203, "cardiac_drift_quality": F.lit("good")})


def test_status_rules(spark):
    df, as_of = _status_facts(spark), date(2026, 5, 20)
    found = {r.code: r for r in status.all_rules(df, as_of).collect()}
    assert {found.pop(c).status for c in ("stale_mirror_data", "stale_read_model_facts")} == {"unavailable"}
    assert {c: r.status for c, r in found.items()} == {
        "missing_hr": "active", "missing_streams": "active", "excessive_z5_exposure": "active", "hr_anomaly_burst": "active",
        "consecutive_high_load_hikes": "active", "running_volume_jump": "active", "cardiac_drift_significant_quality": "active",
    }
    assert found["consecutive_high_load_hikes"].amount == 850.0 and found["running_volume_jump"].amount == 19.99
    assert found["excessive_z5_exposure"].evidence == "203"
    later = {r.code: r.status for r in status.all_rules(df, date(2027, 1, 1)).collect()}
    assert set(later.values()) == {"unavailable"}
    times = spark.createDataFrame([(date(2026, 5, 18),)], "at date")
    assert status.stale("stale_mirror_data", times, as_of).first().status == "active"
    assert status.stale("stale_mirror_data", times, date(2026, 5, 19)).first().status == "inactive"
    assert status.stale("stale_mirror_data", times.limit(0), as_of).first().status == "unavailable"


def test_projection(spark):
    daily = spark.createDataFrame([(date(2026, 5, 1) + timedelta(days=k), 70.0 if k % 7 == 0 else 0.0) for k in range(28)], "day date, effective_trimp double")
    model = spark.createDataFrame([(date(2026, 5, 28), 40.0, 30.0)], "day date, fitness double, fatigue double")
    today = date(2026, 5, 28)
    rows = services.projection(daily, model, today, today + timedelta(days=7), ("rest", "easy", "maintain", "custom"), [{"date": "2026-05-30", "trimp": 50}]).collect()
    assert len(rows) == 32
    rest = [r for r in rows if r.scenario == "rest"]
    assert rest[0].fitness == round(40 * 0.5 ** (1 / 42), 1) and rest[0].form == round(rest[0].fitness - rest[0].fatigue, 1)
    assert {r.load for r in rows if r.scenario == "easy"} == {80.0}
    friday, monday = date(2026, 6, 5), date(2026, 6, 8)
    short = services.projection(daily, model, today, friday)
    long = {(r.scenario, r.day): r for r in services.projection(daily, model, today, monday, ("rest",)).collect()}
    forms = {r.scenario: (r.day, r.form) for r in services.next_monday_form(short, friday).collect()}
    assert set(forms) == {"rest", "easy", "maintain"} and forms["rest"] == (monday, long["rest", monday].form)
    assert services.next_monday_form(short, date(2026, 6, 4)).count() == 0
    assert [r.load for r in sorted(rows, key=lambda r: r.day) if r.scenario == "maintain"].count(70.0) == 1
    assert {r.day: r.load for r in rows if r.scenario == "custom"}[date(2026, 5, 30)] == 50.0
    for bad in ({"target": today - timedelta(days=1)}, {"target": today + timedelta(days=91)}, {"scenarios": ("x",)}):
        with pytest.raises(ValueError):
            services.projection(daily, model, **({"today": today, "target": today, "scenarios": ("rest",)} | bad))
    for row in ([{"date": "2026-05-27", "trimp": 1}], [{"date": "2026-05-29", "trimp": -1}], [{"date": "2026-05-29", "trimp": 1}] * 2, [{"date": "x", "trimp": 1}]):
        with pytest.raises(ValueError):
            services.validated_custom(row, today, today + timedelta(days=3))


def test_bundles_and_glossary(activity, spark):
    glossary.validate()
    assert "cardiac drift" in glossary.render()
    assert registry.catalog(spark).count() == len(registry.REGISTRY) == 43
    rows = aggregate({"activity": activity}, AggregateRequest(("distance_km", "trimp", "calories"), start=START, end=END)) if "calories_kcal" in activity.columns else aggregate({"activity": activity}, AggregateRequest(("distance_km", "trimp"), start=START, end=END))
    parts = {r.section: r for r in bundles.sections(rows, "monthly_digest").collect()}
    assert parts["workouts"].status == "partial" and "distance_km" in parts["workouts"].included
    assert parts["fitness"].status == "unavailable"
    assert bundles.overall(bundles.sections(rows, "monthly_digest")).first().status == "partial"
    assert {r.metric_id: r.value for r in bundles.first_values(rows).collect()} == {"distance_km": 29.0, "trimp": 310.0}
    assert {r.code for r in bundles.warnings(rows).collect()} == {"partial_data"}


def test_brief_load_covers_14_days(activity):
    sources = {"activity": activity, "social": activity}
    totals = lambda day: {(r.metric_id, r.sport_type): r.value for r in bundles.brief_load(sources, day, "all_time").collect()}
    first, later = totals(date(2026, 5, 18)), totals(date(2026, 5, 19))
    assert (first["distance_km", None], first["kudos_count", None], first["trimp", None]) == (21.0, 3.0, 250.0)
    assert (later["distance_km", None], later["distance_km", "Run"]) == (11.0, 11.0)
    days = bundles.brief_load(sources, date(2026, 5, 19)).filter("metric_id = 'trimp'").collect()
    assert [(r.bucket_start, r.value) for r in days] == [(date(2026, 5, 12), 80.0), (date(2026, 5, 13), 70.0)]


def test_bundles_ask_for_their_ranges(spark, monkeypatch):
    asked = []

    def record(sources, request):
        asked.append((request.bundle, request.bucket, request.start, request.end))
        return spark.createDataFrame([("trimp", None, 5.0 if request.end > date(2026, 5, 18) else 3.0)], "metric_id string, sport_type string, value double")

    monkeypatch.setattr(bundles, "aggregate", record)
    row = bundles.weekly_digest({}, date(2026, 5, 20)).first()  # a Wednesday
    assert (row.sport_type, row.value, row.previous, row.delta) == ("all", 5.0, 3.0, 2.0)
    bundles.daily_brief({}, date(2026, 5, 20))
    assert sorted(asked) == [
        ("daily_brief", "all_time", date(2026, 5, 7), date(2026, 5, 21)),
        ("weekly_digest", "all_time", date(2026, 5, 11), date(2026, 5, 18)),
        ("weekly_digest", "all_time", date(2026, 5, 18), date(2026, 5, 21)),
    ]


def test_memo_is_kept_for_a_time_and_until_a_commit(spark, tmp_path):
    from paceforge.plans.memo import ResponseMemo
    from paceforge.sources.sinks import Store

    store, now, built = Store(spark, str(tmp_path)), [100.0], []
    store.commit({"t": spark.range(3)})
    memo = ResponseMemo(store, entries=2, clock=lambda: now[0])

    def ask(n):
        def build():
            built.append(n)
            return store.read("t").filter(F.col("id") >= n)

        return memo.answer("rows", {"n": n, "of": "t"} if n % 2 else {"of": "t", "n": n}, build)

    first = ask(1)
    assert first.count() == 2 and ask(1) is first and memo.hits == 1 and built == [1] and first.storageLevel.useMemory
    now[0] += 29.9
    assert ask(1) is first
    now[0] += 0.1
    assert ask(1) is not first and built == [1, 1]
    two, one = ask(2), ask(1)
    ask(0)  # a third: the one asked for longest ago goes
    assert not two.storageLevel.useMemory and one.storageLevel.useMemory
    store.commit({"t": spark.range(9)})
    assert ask(1).count() == 8 and not one.storageLevel.useMemory
    memo.clear()
    with pytest.raises(ValueError):
        ResponseMemo(store, entries=0)


def test_rounded_delta_tells_the_trend(spark):
    """1.0 against 0.9997 is flat: the delta is rounded before anything follows from it."""
    days = [(date(2026, 5, 5), 1000.0), (date(2026, 4, 5), 999.7)]
    rows = [(k, d, "Run", m, 1, "complete") for k, (d, m) in enumerate(days)]
    df = spark.createDataFrame(rows, "activity_id long, activity_day date, sport_type string, distance_m double, metric_version long, completeness_status string")
    df = df.withColumn("missing_reasons", F.array().cast("array<string>"))
    request = AggregateRequest(("distance_km",), start=date(2026, 5, 1), end=date(2026, 6, 1))
    r = services.compare_periods({"activity": df}, request, (date(2026, 4, 1), date(2026, 5, 1))).first()
    assert (r.delta, r.delta_pct, r.trend) == (0.0, 0.0, "flat") and (r.activity_count_a, r.metric_version_status) == (1, "single")
    none = services.compare_periods({"activity": df}, request, (date(2025, 4, 1), date(2025, 5, 1))).first()
    assert (none.delta, none.trend, none.missing_reasons, none.coverage_b) == (None, "unavailable", ["no_facts"], 0.0)


@pytest.mark.parametrize("scope, sport, found", [
    ("global", None, [("global", None)]), ("per_sport", None, [("per_sport", None)]), ("per_sport", "Hike", [("per_sport", "Hike")]),
    ("both", None, [("global", None), ("per_sport", None)]),
])
def test_whole_range_without_facts_has_its_row(activity, scope, sport, found):
    request = AggregateRequest(("distance_km",), scope=scope, sport=sport, start=date(2030, 1, 1), end=date(2030, 2, 1))
    rows = aggregate({"activity": activity}, request).collect()
    assert sorted((r.scope, r.sport_type) for r in rows) == sorted(found, key=str)
    assert all((r.row_count, r.missing_reasons, r.completeness_status, r.denominator) == (0, ["no_facts"], "unavailable", "distance_m") for r in rows)


def test_last_of_equal_offsets_counts(spark):
    """51 s of standing with one repeated offset whose last row stands: one pause; whose last row moves: none of 51 s."""
    from paceforge.operators import streams

    def of(last):
        stand = [(1, 100 + k, 140 - k % 3, 0.0, 0) for k in range(51)]
        twice = [(1, 120, 140, 3.0 if last == 0.0 else 0.0, 1), (1, 120, 140, last, 2)]
        move = [(1, k, 150, 3.0, 0) for k in range(100)]
        df = spark.createDataFrame(move + stand + twice, "activity_id long, time_offset long, heartrate long, velocity double, pos long")
        return [r.duration_s for r in streams.pauses(df).collect()]

    assert of(0.0) == [50] and of(3.0) == []
