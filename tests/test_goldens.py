"""Hand-computed values of the single operators."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceforge.functions import hashing, scalars, zones
from paceforge.functions.schema_drift import drift_report, nested_drift
from paceforge.operators import drift, relational, sequence, streams
from paceforge.plans import facts

SAMPLES = "activity_id long, time_offset long, heartrate long, velocity double, altitude double"


def one(df, column):
    return df.select(column).first()[0]


def test_zone_limits(spark):
    assert zones.karvonen(191, 53) == [122, 136, 150, 163, 177, 300]
    with pytest.raises(ValueError):
        zones.karvonen(53, 53)
    row = spark.range(1).select(*zones.zone_bounds(F.lit(191), 53)).first()
    assert list(row) == [122, 136, 150, 163, 177]
    assert list(spark.range(1).select(*zones.zone_bounds(F.lit(50), 53)).first()) == [None] * 5


def test_ten_samples_at_160_load_half(spark):
    df = spark.createDataFrame([(1, k, 160, 3.0, 0.0) for k in range(10)], SAMPLES)
    bounds = zones.karvonen(191, 53)
    assert df.agg(zones.load_of(zones.load_points(F.col("heartrate"), bounds))).first()[0] == 0.5


def test_band_below_the_last_limit_loads_but_lies_in_no_zone(spark):
    df = spark.createDataFrame([(1, k, 170, 3.0, 0.0) for k in range(60)], SAMPLES)
    bounds = zones.karvonen(191, 53)
    row = df.agg(*[c.alias(k) for k, c in zones.zone_seconds(F.col("heartrate"), bounds).items()], zones.load_of(zones.load_points(F.col("heartrate"), bounds)).alias("t")).first()
    assert list(row) == [0, 0, 0, 0, 0, 4.0]


def test_hrr_and_adjusted_cost(spark):
    row = spark.range(1).select(
        streams.hrr_pct(F.lit(150.0), 50, F.lit(200)),
        streams.hrr_pct(F.lit(150.0), 50, F.lit(50)),
        streams.adjusted_cardiac_cost(F.lit(50.0), F.lit(10_000.0), F.lit(100.0)),
        streams.adjusted_cardiac_cost(F.lit(50.0), F.lit(0.0), F.lit(100.0)),
    ).first()
    assert list(row) == [66.7, None, 45.5, None]


def test_pause_sampled_every_two_seconds(spark):
    rows = [(1, 2 * k, 150, 3.0, 0.0) for k in range(120)]
    rows += [(1, 240 + 2 * k, 160 - 2 * k, 0.0, 0.0) for k in range(16)]
    rows += [(1, 272 + 2 * k, 150, 3.0, 0.0) for k in range(10)]
    found = streams.pauses(spark.createDataFrame(rows, SAMPLES)).collect()
    assert len(found) == 1
    p = found[0]
    # first five mean 156, last five mean 134; 16 samples
    assert (p.start_offset, p.duration_s, p.sampled_s, p.drop_bpm, p.rate) == (240, 30, 16, 22.0, 82.5)
    r = streams.recovery(streams.pauses(spark.createDataFrame(rows, SAMPLES))).first()
    assert (r.pause_count, r.total_rest_sec, r.median_rate, r.best_rate) == (1, 30, 82.5, 82.5)


def test_pauses_need_length_and_no_gap(spark):
    moving = [(1, k, 150, 3.0, 0.0) for k in range(130)]
    short = moving + [(1, 130 + k, 150, 0.0, 0.0) for k in range(29)]
    gap = moving + [(1, 130 + k + (10 if k > 20 else 0), 150, 0.0, 0.0) for k in range(45)]
    few = [(1, k, 150, 0.0, 0.0) for k in range(100)]
    for rows in (short, gap, few):
        assert streams.pauses(spark.createDataFrame(rows, SAMPLES)).count() == 0


def test_vertical_speed(spark):
    rows = [(1, 10 * k, None, None, 100.0 + (k if k % 2 else 0)) for k in range(61)]
    r = streams.vertical_speed(spark.createDataFrame(rows, SAMPLES)).first()
    up = sum(k for k in range(61) if k % 2)
    assert (r.vmh, r.total_ascent_m, r.duration_hours) == (round(up / (600 / 3600)), float(up), 0.17)
    assert streams.vertical_speed(spark.createDataFrame(rows[:59], SAMPLES)).first().vmh is None
    close = [(1, k, None, None, 1.0 * k) for k in range(61)]
    assert streams.vertical_speed(spark.createDataFrame(close, SAMPLES)).first().vmh is None


def test_scalars_and_running_max(spark):
    rows = [(1, 0, 140, 0.2, 0.0), (1, 1, 150, 3.0, 0.0), (1, 2, 160, 2.0, 0.0), (1, 3, None, 3.0, 0.0), (2, 0, 180, 1.0, 0.0)]
    df = spark.createDataFrame(rows, SAMPLES)
    r = streams.stream_scalars(df).filter("activity_id = 1").first()
    assert (r.stream_count, r.hr_count, r.min_hr, r.max_hr, r.cardiac_cost, r.median_hr) == (4, 3, 140, 160, 62.0, 150.0)
    acts = spark.createDataFrame([(1, date(2026, 1, 1)), (2, date(2026, 1, 3)), (3, date(2026, 1, 2))], "id long, activity_day date")
    found = {r.activity_day.day: r.max_hr_to_day for r in streams.running_max_hr(acts, df).collect()}
    assert found == {1: 160, 2: 160, 3: 180}
    assert streams.heart_rate_jumps(spark.createDataFrame([(1, 0, 100, 1.0, 0.0), (1, 1, 131, 1.0, 0.0), (1, 2, 161, 1.0, 0.0)], SAMPLES)).first().jumps == 1


def test_drift_goldens():
    pace = np.tile([2.0, 2.01, 3.0, 3.01], 300)
    pace = np.sort(pace)
    flat = drift.drift_of(np.full(1200, 150.0), pace, 10.0)
    assert (flat["pct"], flat["severity"], flat["significant"]) == (0.0, "stable", False)
    ramp = drift.drift_of(np.linspace(140, 170, 600), np.full(600, 3.0) + np.arange(600) % 2 * 0.01, 5.0)
    assert ramp["pct"] is None or ramp["pct"] > 5
    steady = np.repeat([2.0, 3.0], 300)
    climbing = drift.drift_of(np.concatenate([np.linspace(140, 170, 300)] * 2), steady, 5.0)
    assert climbing["pct"] > 5 and climbing["significant"] and climbing["severity"] in ("significant", "severe")
    assert drift.drift_of(np.full(119, 150.0), np.full(119, 3.0), 10.0) is None


def _plain_breaks(x, k):
    n = len(x)
    cost = lambda a, b: float(((x[a:b] - x[a:b].mean()) ** 2).sum())
    best = {(0, 0): 0.0}
    for t in range(1, k + 1):
        for m in range(t, n + 1):
            best[(t, m)] = min(best[(t - 1, j)] + cost(j, m) for j in range(t - 1, m) if (t - 1, j) in best)
    return best[(k, n)]


def test_natural_breaks_are_optimal():
    rng = np.random.default_rng(2)
    x = np.sort(rng.random(40))
    for k in (2, 3, 4):
        borders, fit = drift.NaturalBreaks(x).classes(k)
        got = sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(borders, borders[1:]))
        assert got == pytest.approx(_plain_breaks(x, k)) and len(borders) == k + 1
        assert fit == pytest.approx(1 - got / ((x - x.mean()) ** 2).sum())


def test_streaks_and_last_hike(spark):
    counts = [1, 2, 0, 1, 1, 1, 0, 0, 3]
    days = spark.createDataFrame([(date(2026, 1, 1) + timedelta(days=k), c) for k, c in enumerate(counts)], "day date, activity_count long")
    found = sequence.streaks(days).orderBy("day").collect()
    assert [r.activity_streak_days for r in found] == [1, 2, 0, 1, 2, 3, 0, 0, 1]
    assert [r.rest_streak_days for r in found] == [0, 0, 1, 0, 0, 0, 1, 2, 0]
    hikes = spark.createDataFrame([(date(2026, 1, 3),), (date(2026, 1, 3),), (date(2026, 1, 7),)], "activity_day date")
    since = sequence.days_since(days, hikes, "n").orderBy("day").collect()
    assert [r.n for r in since] == [None, None, 0, 1, 2, 3, 0, 1, 2]


def _plain_model(loads, warm_up=90):
    fit = fat = 0.0
    out = []
    for load in [0.0] * warm_up + loads:
        fit = round(fit + (1 - 0.5 ** (1 / 42)) * (load - fit), 1)
        fat = round(fat + (1 - 0.5 ** (1 / 10)) * (load - fat), 1)
        out.append((fit, fat))
    return out


def test_load_model_is_the_rounded_fold(spark):
    rng = random.Random(4)
    loads = [round(rng.choice([0, 0, 1]) * rng.uniform(20, 200), 1) for _ in range(200)]
    rows = [(date(2025, 1, 1) + timedelta(days=k), v) for k, v in enumerate(loads)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    found = sequence.load_model(spark.createDataFrame(shuffled, "day date, load double")).orderBy("day").collect()
    assert np.allclose([(r.fitness, r.fatigue) for r in found], _plain_model(loads))
    two = spark.createDataFrame([(s, d, v) for s in "ab" for d, v in rows], "athlete string, day date, load double")
    both = sequence.load_model(two, ["athlete"]).filter("athlete = 'b'").orderBy("day").collect()
    assert [(r.fitness, r.fatigue) for r in both] == [(r.fitness, r.fatigue) for r in found]


def test_zones_of_form_and_ratio(spark):
    rows = spark.createDataFrame([(-5.1, 0.79), (-5.0, 0.8), (9.9, 1.3), (10.0, 1.35), (0.0, 1.36), (0.0, None)], "f double, a double")
    found = rows.select(scalars.form_zone(F.col("f")), scalars.acwr_zone(F.col("a"))).collect()
    assert [tuple(r) for r in found] == [("tired", "undertrained"), ("normal", "sweet_spot"), ("normal", "sweet_spot"), ("fresh", "caution"), ("normal", "danger"), ("normal", "unknown")]
    row = spark.range(1).select(scalars.acwr(F.lit(13.0), F.lit(10.0)), scalars.acwr(F.lit(1.0), F.lit(0.0))).first()
    assert list(row) == [1.3, None]


def test_labels(spark):
    assert one(spark.range(1), scalars.relative_label(F.lit(90061))) == "1d 1h"
    assert one(spark.range(1), scalars.relative_label(F.lit(3725))) == "1h 2m"
    assert one(spark.range(1), scalars.relative_label(F.lit(-5))) == "0h 0m"
    for text, expected in (("2026-05-01T07:09:10+02:00", "07:09"), ("2026-05-01 23:59", "23:59"), ("2026-05-01T25:00:00", None), ("x", None), (None, None)):
        assert one(spark.range(1), scalars.local_hhmm(F.lit(text).cast("string"))) == expected
    for x, expected in ((123.4, 123.0), (12.5, 12.0), (1.25, 1.2), (0.256, 0.26), (0.0123, 0.012), (0.00126, 0.0013), (0.0, 0.0)):
        assert one(spark.range(1), scalars.smart_round(F.lit(x))) == expected
    assert one(spark.range(1), scalars.season(F.lit("2026-12-01").cast("date"))) == "winter"
    assert one(spark.range(1), scalars.bucket_start(F.lit("2026-05-05").cast("date"), "week")) == date(2026, 5, 4)
    with pytest.raises(ValueError):
        scalars.bucket_start(F.lit("2026-05-05"), "hour")


def test_canonical_hash(spark):
    a, b = '{"b": 1, "a": {"y": [1, 2], "fetched_at": "x"}}', '{"a": {"fetched_at": "z", "y": [1,2]}, "b":1}'
    assert hashing.canonical(a, ["fetched_at"]) == hashing.canonical(b, ["fetched_at"])
    assert hashing.canonical(a) != hashing.canonical(b)
    assert hashing.canonical('{"x": "{\\"k\\": 1}"}') == hashing.canonical('{"x": {"k": 1}}')
    assert hashing.canonical("not json") == "not json" and hashing.canonical(None) is None
    df = spark.createDataFrame([(a,), (b,), (None,)], "p string")
    found = [r[0] for r in df.select(hashing.semantic_hash(F.col("p"), ["fetched_at"])).collect()]
    assert found[0] == found[1] and found[2] is None and len(found[0]) == 64


def test_whole_days_and_sports(spark):
    rows = [(k, date(2026, 1, 1 + k // 4), "Run" if k % 2 else "Quidditch") for k in range(20)]
    df = spark.createDataFrame(rows, "id long, activity_day date, sport_type string")
    assert sorted(r.id for r in relational.whole_days(df, 5).collect()) == list(range(8))
    assert relational.unknown_sports(df).collect() == [("Quidditch", 10)]
    r = relational.with_sport(df).filter("id = 0").first()
    assert (r.display, r.category, r.is_training) == ("Quidditch", "other", False)


def test_schema_drift(spark):
    df = spark.createDataFrame([('{"id": 1, "new": 2}',), ('{"id": 2, "paid": 5}',), ("broken",), (None,)], "payload_json string")
    found = {(r.kind, r.key, r.rows) for r in drift_report(df, ["id", "paid"], ["paid"]).collect()}
    assert found == {("unknown", "new", 1), ("activated", "paid", 1)}


def test_missing_channels_and_kudos(spark):
    acts = spark.createDataFrame([(1, date(2026, 1, 1), 2), (2, date(2026, 1, 2), 0), (3, date(2026, 1, 3), 1)], "id long, activity_day date, kudos_count long")
    channels = spark.createDataFrame([(1, "time", "available"), (1, "watts", "unavailable"), (2, "time", "failed")], "activity_id long, channel_key string, status string")
    found = {r.id: r.missing for r in relational.missing_channels(acts, channels, ("time", "watts")).collect()}
    assert found == {2: ["time", "watts"], 3: ["time", "watts"]}
    assert {(r.channel, r.n) for r in relational.channel_tally(relational.missing_channels(acts, channels, ("time", "watts"))).collect()} == {("time", 2), ("watts", 2)}
    kudos = spark.createDataFrame([(1, " Ann", "B "), (1, "Ann", "B"), (1, None, " ")], "activity_id long, firstname string, lastname string")
    assert [r.id for r in relational.missing_kudos(acts, kudos).collect()] == [3]
    assert relational.kudos_names(kudos).first().names == ["Ann B"]


def test_smoothed_state_is_not_rounded():
    assert sequence.smoothed([100.0] * 10, 10) == pytest.approx(50.0)
    assert math.isclose(sequence.ALPHA_FITNESS, 1 - 0.5 ** (1 / 42))


def test_nested_drift(spark):
    texts = [
        '{"id":1,"laps":[{"id":1,"w":2.5},{"id":2,"w":null},{"id":3},{"id":4,"late":1}],"paid":0,"flag":false,"list":[],"map":{}}',
        '{"id":"x","laps":[],"paid":0.0,"flag":true,"list":[1],"map":{"a":{"b":{"c":1}}},"new":{"deep":{"er":1}}}',
        '{"id":2,"paid":5,"flag":null,"list":null,"map":{"a":1}}',
        "not json",
        "[1, 2]",
        None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "payload_json string")
    known = ["id", "laps", "laps[].id", "paid", "flag", "list", "map"]
    found = nested_drift(df, known, {"paid": "0", "flag": "false", "list": "[]", "map": "{}"})
    assert {tuple(r) for r in found.collect()} == {
        ("unknown", "laps[].w", "number", 1), ("unknown", "laps[].w", "null", 1), ("unknown", "map.a", "object", 1), ("unknown", "map.a", "number", 1),
        ("unknown", "new", "object", 1), ("unknown", "[]", "number", 2),
        ("activated", "paid", "number", 1), ("activated", "flag", "boolean", 1), ("activated", "list", "array", 1), ("activated", "map", "object", 2),
    }


def test_drift_sql_equals_the_algorithm_on_any_number_of_classes():
    """The dynamic programme in SQL against the vectorised one, on paces of one to five levels, noise, ties and outliers."""
    import duckdb
    import numpy as np

    from paceforge import oracle
    from paceforge.constants import DRIFT_DEFAULT_THRESHOLD, DRIFT_THRESHOLDS
    from paceforge.operators.drift import drift_of

    rng = np.random.default_rng(11)
    acts, rows, expected = [], [], {}
    for i, (n, levels, noise) in enumerate([(119, 1, 0.1), (120, 2, 0.0), (300, 3, 0.05), (420, 5, 0.1), (500, 1, 0.6), (350, 4, 0.3), (1300, 3, 0.1)]):
        pace = np.round(2.0 + np.repeat(rng.integers(0, levels, n // 10 + 1), 10)[:n] * 0.7 + rng.normal(0, noise, n) * (noise > 0), 2)
        pace = np.maximum(pace, 0.5)
        heart = np.round(120 + 10 * pace + np.arange(n) * 0.02 + rng.normal(0, 2, n)).astype(int)
        heart[rng.integers(0, n, 3)] = 30
        sport = ["Run", "TrailRun", "Hike", "Walk", "Ride", "Run", "Hike"][i]
        acts.append((i, sport))
        rows += [(i, k, int(h), float(v)) for k, (h, v) in enumerate(zip(heart, pace))]
        expected[i] = drift_of(heart.astype(float), pace, DRIFT_THRESHOLDS.get(sport, DRIFT_DEFAULT_THRESHOLD))
    con = duckdb.connect()
    con.execute("CREATE TABLE acts (id BIGINT, sport_type VARCHAR)")
    con.execute("CREATE TABLE samp_e (activity_id BIGINT, time_offset BIGINT, heartrate BIGINT, velocity DOUBLE)")
    con.executemany("INSERT INTO acts VALUES (?, ?)", acts)
    con.executemany("INSERT INTO samp_e VALUES (?, ?, ?, ?)", rows)
    found = con.execute(f"WITH RECURSIVE {oracle.DRIFT.replace('{limit}', oracle.SPORT_LIMIT)} SELECT * FROM drift").fetchall()
    assert {i for i, e in expected.items() if e is not None} == {r[0] for r in found}
    for i, pct, severity, significant, quality, classes, fit in found:
        e = expected[i]
        assert (severity, significant, quality, classes) == (e["severity"], e["significant"], e["quality"], e["classes"]), i
        assert fit == pytest.approx(e["fit"], abs=1e-4) and (pct == e["pct"] or pct == pytest.approx(e["pct"], abs=0.011))
    assert len({r[5] for r in found}) > 2


def test_nested_drift_reads_the_payloads_once(spark, tmp_path):
    """All levels and all paid paths come from one scan and one parse of the payloads."""
    where = str(tmp_path / "log")
    spark.createDataFrame([('{"a":[[1,2],3,{"b":null},5],"c":{"d":{"e":{"f":1}}},"paid":2}',), ("no",), (None,)], "payload_json string").write.parquet(where)
    rows = nested_drift(spark.read.parquet(where), ["a", "c"], {"paid": "0", "c": "{}"})
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and plan.count("parseJson") == 1
    got = {(r.change, r.path, r.kind, r.rows) for r in rows.collect()}
    assert got == {("activated", "c", "object", 1), ("activated", "paid", "number", 1), ("unknown", "a[].b", "null", 1), ("unknown", "a[][]", "number", 2), ("unknown", "c.d", "object", 1), ("unknown", "paid", "number", 1)}


def test_latest_payloads_come_from_one_aggregation(spark):
    """No windows: the newest of each kind by time and hash, texts that are null included; ``only`` gives the same rows."""
    log = spark.createDataFrame(
        [(1, "summary", "2026-01-01", '{"average_heartrate":100}', "b"), (1, "summary", "2026-01-02", '{"average_heartrate":120,"start_date_local":"x"}', "a"),
         (1, "summary", "2026-01-02", '{"average_heartrate":110}', "0"), (1, "detail", "2026-01-01", '{"gear":{"name":"n","distance":5}}', "c"),
         (2, "summary", "2026-01-01", '{"average_heartrate":90}', "d"), (2, "summary", "2026-01-03", None, None)],
        "activity_id long, payload_kind string, fetched_at string, payload_json string, raw_hash string",
    )
    acts = spark.range(1, 4).selectExpr("id", "date'2026-01-01' activity_day", "'Run' sport_type", "1L kudos_count", "7D calories_kcal")
    whole = relational.hydrated(acts, log)
    assert "Window" not in whole._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.id: (r.avg_hr, r.calories_kcal, r.gear_name, r.gear_distance_m, r.start_date_local) for r in whole.collect()}
    assert rows == {1: (120.0, 7.0, "n", 5.0, "x"), 2: (None, 7.0, None, None, None), 3: (None, 7.0, None, None, None)}
    assert {r.id: r.avg_hr for r in relational.summaries(log).collect()} == {1: 120.0, 2: None}
    one = relational.hydrated(acts, log, only=spark.createDataFrame([(1,)], "activity_id long")).collect()
    assert one == [r for r in whole.collect() if r.id == 1]


def test_only_long_activities_are_ordered(spark):
    """By a stored tier, samples of short activities go before any window; what is told of the others is the same."""
    samples = spark.range(700).selectExpr(
        "CASE WHEN id < 400 THEN 1L WHEN id < 659 THEN 2L ELSE 3L END activity_id", "id time_offset", "100 + id % 50 heartrate",
        "CASE WHEN id % 100 < 40 THEN 0D ELSE 2D + id % 3 END velocity", "500D + id % 50 altitude",
    )
    acts = spark.range(1, 4).selectExpr("id", "'Run' sport_type")
    tier = streams.heart_rate_tier(samples)
    kept = facts._long_enough(samples, tier)
    assert {r.activity_id for r in kept.select("activity_id").distinct().collect()} == {1, 2}
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(facts.ordered_measures(acts, samples, tier)) == rows(facts.ordered_measures(acts, samples)) != []


def test_median_of_counted_rates(spark):
    """The tier's median is the percentile of the samples, for odd, even, equal and absent rates."""
    rows = [(1, 100), (1, 130), (2, 100), (2, 100), (2, 131), (3, None), (4, 90), (4, 90), (4, 121), (4, 121), (4, None)]
    df = spark.createDataFrame(rows, "activity_id long, heartrate long").selectExpr("*", "1D velocity")
    tier = streams.heart_rate_tier(df)
    assert "percentile" not in tier._jdf.queryExecution().optimizedPlan().toString()
    assert {r.activity_id: (r.median_hr, r.rates) for r in tier.collect()} == {
        1: (115.0, {100: 1, 130: 1}), 2: (100.0, {100: 2, 131: 1}), 3: (None, {}), 4: (105.5, {90: 2, 121: 2}),
    }
