"""Stores, incremental runs, stream payloads and streaming jobs."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paceforge.plans import facts as fx
from paceforge.plans import incremental as inc
from paceforge.plans import materialize as mat
from paceforge.plans import runtime
from paceforge.session import stored
from paceforge.sources import sinks, streams_json
from paceforge.streaming import jobs


def test_store_commits_all_or_nothing(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path / "s"))
    with pytest.raises(sinks.MirrorMissing):
        store.read("a")
    store.commit({"a": spark.range(3), "b": spark.range(2)})
    store.commit({"a": spark.range(5)})
    assert (store.read("a").count(), store.read("b").count()) == (5, 2)
    with pytest.raises(ValueError):
        store.read("a", "id long, other string")
    turn = store.manifest()[0]
    store._create(f"manifest-{turn + 1:08d}", json.dumps(store.manifest()[1]))
    with pytest.raises(sinks.Conflict):
        store._create(f"manifest-{turn + 1:08d}", "{}")
    assert store.vacuum() == 0 and store.vacuum(keep_s=0) == 1 and store.read("a").count() == 5
    assert sinks.small_file_share(spark, str(tmp_path / "s" / "data")) == 1.0


def test_lease(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path))
    assert store.acquire("one", 100.0, 60) and store.acquire("one", 110.0, 60)
    assert not store.acquire("two", 120.0, 60)
    assert store.acquire("two", 200.0, 60)
    store.release("two")
    assert store.acquire("one", 201.0, 60)


def test_table_changes(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sinks.upsert(table, new, ["id"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(sinks.insert_missing(table, new, ["id"])) == [(1, "a"), (2, "b"), (3, "d")]
    null = spark.createDataFrame([(1, None), (2, "z")], "id long, v string")
    assert rows(sinks.update_where_present(table, null, "id", "v")) == [(1, "a"), (2, "z")]
    groups = spark.createDataFrame([(1, "x"), (1, "y")], "id long, v string")
    assert rows(sinks.replace_group(table, groups, "id")) == [(1, "x"), (1, "y"), (2, "b")]
    sinks.assert_unique(table, ["id"])
    with pytest.raises(ValueError):
        sinks.assert_unique(groups, ["id"])
    assert rows(sinks.compacted(table)) == rows(table)


def test_append_only_when_changed(spark):
    kind = "activity_id long, payload_kind string, fetched_at string, raw_hash string"
    log = spark.createDataFrame([(1, "summary", "2026-01-01", "x"), (1, "summary", "2026-01-02", "y")], kind)
    new = spark.createDataFrame([(1, "summary", "2026-01-03", "y"), (1, "detail", "2026-01-03", "y"), (2, "summary", "2026-01-03", "z")], kind)
    found = sinks.append_changed(log, new, ["activity_id", "payload_kind"]).collect()
    assert {(r.activity_id, r.payload_kind) for r in found} == {(1, "detail"), (2, "summary")}
    twice = spark.createDataFrame([(1, "summary", "2026-01-03", "z"), (1, "summary", "2026-01-04", "z"), (1, "summary", "2026-01-05", "y")], kind)
    assert sorted(r.fetched_at for r in sinks.append_changed(log, twice, ["activity_id", "payload_kind"]).collect()) == ["2026-01-03", "2026-01-05"]
    back = spark.createDataFrame([(1, "summary", "2026-01-03", "x")], kind)
    assert sinks.append_changed(log, back, ["activity_id", "payload_kind"]).count() == 1


def test_stream_payloads(spark):
    channel = lambda data: {"data": data, "original_size": len(data), "resolution": "high", "series_type": "time"}
    payload = {"time": channel([0, 1, 1, 3]), "heartrate": channel([100, 101, 102, None]), "latlng": channel([[1.5, 2.5], [1, 2], [1, 2], [3, 4]]), "moving": channel([True, True, False, True]), "mystery": channel([7, 8, 9, 10])}
    df = spark.createDataFrame([(1, json.dumps(payload)), (2, json.dumps({"heartrate": channel([1])})), (3, "broken"), (4, None)], "activity_id long, payload_json string")
    rows = streams_json.samples(df).orderBy("time_offset").collect()
    assert [(r.time_offset, r.heartrate, r.lat, r.is_moving, json.loads(r.values_json)["mystery"]) for r in rows] == [(0, 100, 1.5, True, "7"), (1, 101, 1.0, True, "8"), (3, None, 3.0, True, "10")]
    meta = {(r.activity_id, r.channel_key): r.status for r in streams_json.channel_metadata(df, ("time", "watts")).collect()}
    assert meta[(1, "time")] == "available" and meta[(1, "watts")] == "unavailable" and meta[(1, "mystery")] == "available"
    assert meta[(2, "heartrate")] == "available"
    old = spark.createDataFrame([(1, 0, '{"a":"1","b":"2"}'), (1, 1, None)], "activity_id long, time_offset long, values_json string")
    new = spark.createDataFrame([(1, 0, '{"b":"3","c":"4"}'), (9, 0, '{"x":"1"}')], "activity_id long, time_offset long, values_json string")
    merged = {r.time_offset: r.values_json for r in streams_json.merged_values(old, new).collect()}
    assert json.loads(merged[0]) == {"a": "1", "b": "3", "c": "4"} and merged[1] is None


def _mirror(spark, path, gap=1):
    store = sinks.Store(spark, str(path))
    days = [date(2026, 1, 1) + timedelta(days=k // 2 * gap) for k in range(12)]
    acts = spark.createDataFrame(
        [(k, d, "Run" if k % 3 else "Walk", 5000.0 + k, 1800, 1900, 50.0, k, 100.0, True) for k, d in enumerate(days)],
        "id long, activity_day date, sport_type string, distance_m double, moving_time_s long, elapsed_time_s long, elevation_gain_m double, kudos_count long, calories_kcal double, has_detail boolean",
    )
    samples = spark.createDataFrame(
        [(k, t, 120 + (7 * k + t) % 60, 2.0 + t % 3, 100.0 + t) for k in range(11) for t in range(60)],
        "activity_id long, time_offset long, heartrate long, velocity double, altitude double",
    )
    queue = acts.select(F.col("id").alias("activity_id"), F.lit("new").alias("reason"), F.lit("2026-02-01").alias("enqueued_at"), F.lit(0).cast("long").alias("attempts"))
    store.commit({"activities": acts, "samples": samples, "queue": queue})
    return store


def _full(store, today, version=1):
    """Every table computed anew over the activities that have been claimed so far."""
    tier = store.read("heart_rates").drop("activity_day", "computed_at")
    acts = store.read("activities").join(tier.select(F.col("activity_id").alias("id")), "id", "left_semi")
    samples = store.read("samples").join(tier.select("activity_id"), "activity_id", "left_semi")
    facts = stored(fx.activity_facts(acts, samples, metric_version=version))
    daily = stored(fx.daily_facts(fx.daily_load(acts, samples, until=today), facts, version))
    model = fx.model_facts(daily, version)
    return dict(zip(mat.FACT_TABLES, (facts, daily, model, fx.whole_rolling_facts(daily, facts, model, metric_version=version))))


def _same_as_full(store, today, version=1):
    for name, full in _full(store, today, version).items():
        a, b = (sorted(map(str, df.select(*full.columns).collect())) for df in (store.read(name), full))
        assert a == b, name


def test_batches_equal_one_run(spark, tmp_path):
    whole, parts = _mirror(spark, tmp_path / "w"), _mirror(spark, tmp_path / "p")
    assert mat.materialize(whole, 100, "2026-02-02") == 12
    claimed = []
    while n := mat.materialize(parts, 3, "2026-02-02"):
        claimed.append(n)
    assert claimed == [4, 4, 4]
    for name in mat.FACT_TABLES:
        a, b = (sorted(map(str, s.read(name).collect())) for s in (whole, parts))
        assert a == b, name
    assert [r.id for r in parts.read("ledger").orderBy("id").collect()] == [1, 2, 3, 4]
    assert mat.status(parts) == {"dirty_count": 0, "oldest_enqueued_at": None, "last_ok_at": "2026-02-02"}
    last = parts.read("activity_facts").filter("activity_id = 11").first()
    assert (last.completeness_status, last.missing_reasons, last.trimp) == ("unknown", ["missing_streams", "missing_hr"], 0.0)


def test_every_batch_equals_full_recomputation(spark, tmp_path):
    store = _mirror(spark, tmp_path / "i", gap=19)  # half a year
    kind = "activity_id long, reason string, enqueued_at string, attempts long"

    def change(acts=None, samples=None, ids=()):
        queue = spark.createDataFrame([(i, "changed", "x", 0) for i in ids], kind)
        tables = {"activities": acts, "samples": samples, "queue": queue}
        store.commit({name: df for name, df in tables.items() if df is not None})

    def run(today, limit=100):
        before = {t: store.manifest()[1].get(t, []) for t in mat.DAY_OF}
        n = mat.materialize(store, limit, "2026-09-01", today=today)
        _same_as_full(store, today)
        now = store.manifest()[1]
        return n, store.read("ledger").orderBy(F.desc("id")).first().since, {t: len(set(now[t]) - set(before[t])) for t in mat.DAY_OF}

    first = date(2026, 1, 1)
    assert run(first, 5)[:2] == (6, None)  # six activities of three days
    assert run(date(2026, 5, 1), 100)[1] == "2026-02-09"  # the day after the last one that was computed
    acts, samples = store.read("activities"), store.read("samples")
    # nothing but a distance: the last day alone is dirty, and today has moved on
    change(acts.withColumn("distance_m", F.when(F.col("id") == 11, 9999.0).otherwise(F.col("distance_m"))), ids=[11])
    n, since, months = run(date(2026, 5, 20))
    assert (n, since) == (1, "2026-04-06") and months["activity_facts"] == months["heart_rates"] == 1 and months["daily_facts"] == 2
    # an activity in the middle moves to an earlier day
    acts = store.read("activities")
    change(acts.withColumn("activity_day", F.when(F.col("id") == 8, F.lit(date(2026, 2, 20))).otherwise(F.col("activity_day"))), ids=[8])
    assert run(date(2026, 5, 20))[1] == "2026-02-20"
    # the highest rate of all is another, and later: zones rest on lower maxima, and every load on other limits
    rate = F.when(F.col("activity_id") == 10, 190).otherwise(F.least("heartrate", F.lit(150)))
    change(samples=store.read("samples").withColumn("heartrate", rate).filter("activity_id <> 3"), ids=list(range(12)))
    assert run(date(2026, 5, 21))[:2] == (12, None)
    # an earlier activity gets a rate between: later zones change, the limits of all do not
    change(samples=store.read("samples").withColumn("heartrate", F.when(F.col("activity_id") == 4, 170).otherwise(F.col("heartrate"))), ids=[4])
    n, since, months = run(date(2026, 5, 21))
    assert since is not None and months["activity_facts"] > months["heart_rates"] == 1


def test_upsert_of_a_day_writes_its_month(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(k, date(2026, 1 + k % 3, 1 + k), k * 1.0) for k in range(12)]
    table = spark.createDataFrame(rows, "id long, day date, v double")
    assert sinks.upsert_months(spark, path, table, ["id"], "day") == ["2026-01", "2026-02", "2026-03"]
    files = lambda: {str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([(4, date(2026, 2, 5), -1.0), (99, date(2026, 2, 5), -2.0)], "id long, day date, v double")
    assert sinks.upsert_months(spark, path, new, ["id"], "day") == ["2026-02"]
    kept = {f for f in before if "month=2026-02" not in f}
    assert kept <= files() and not (files() - kept) & before
    found = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert found == {r[0]: r[2] for r in rows} | {4: -1.0, 99: -2.0}
    with pytest.raises(ValueError):
        sinks.upsert_months(spark, path, new.unionByName(new), ["id"], "day")
    group = spark.createDataFrame([(7, date(2026, 2, 5), 0.0), (7, date(2026, 2, 6), 0.5)], "id long, day date, v double")
    sinks.upsert_months(spark, path, group, ["id"], "day", whole_keys=False)
    assert sorted(r.v for r in spark.read.parquet(path).filter("id = 7").collect()) == [0.0, 0.5]


def test_new_logic_queues_everything_and_prunes(spark, tmp_path):
    store = _mirror(spark, tmp_path / "v")
    assert mat.refresh_logic(store, "f1", "2026-02-01") == 1
    mat.materialize(store, 100, "2026-02-02", 1)
    assert mat.refresh_logic(store, "f1", "2026-02-03") == 1 and store.read("queue").count() == 0
    assert mat.refresh_logic(store, "f2", "2026-02-03") == 2 and store.read("queue").count() == 12
    mat.materialize(store, 100, "2026-02-04", 2)
    assert {r.metric_version for r in store.read("activity_facts").collect()} == {2}


def test_failed_run_is_entered(spark, tmp_path):
    store = _mirror(spark, tmp_path / "f")
    store.commit({"samples": store.read("samples").drop("heartrate")})
    with pytest.raises(Exception, match="heartrate"):
        mat.materialize(store, 5, "2026-02-02")
    row = store.read("ledger").first()
    assert row.status == "failed" and store.read("queue").count() == 12


def test_change_detection(spark):
    hashes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "activity_id long, source_hash string")
    state = spark.createDataFrame([(1, "a", 4), (2, "x", 6)], "activity_id long, source_hash string, source_revision int")
    changes = inc.changed(hashes, state)
    assert {(r.activity_id, r.source_revision) for r in changes.collect()} == {(2, 7), (3, 1)}
    assert sorted((r.activity_id, r.source_hash) for r in inc.merged_state(state, changes).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert len(inc.logic_fingerprint([inc, mat])) == 64 and inc.logic_fingerprint([inc, mat]) == inc.logic_fingerprint([mat, inc])


def test_logic_fingerprint_follows_imports(tmp_path, monkeypatch):
    closure = inc.logic_closure(inc.FACT_LOGIC)
    assert {"paceforge.plans.facts", "paceforge.operators.drift", "paceforge.functions.zones", "paceforge.constants"} <= set(closure)
    assert not any(m.startswith(("paceforge.llm", "paceforge.queries", "paceforge.plans.bundles")) for m in closure)
    for folder in ("", "/sub"):
        (tmp_path / f"logicpack{folder}").mkdir(parents=True)
        (tmp_path / f"logicpack{folder}/__init__.py").write_text("")
    files = {
        "facts": "import math\nfrom logicpack.sub import help\ndef f(x):\n    return help.g(x)\n",
        "sub/help": "from ..tables import RATE\ndef g(x):\n    'says'\n    from .far import far\n    return far(x) * RATE\n",
        "sub/far": "def far(x):\n    return x\n",
        "tables": "RATE = 2\n",
        "other": "from logicpack import facts\n",
    }
    for name, text in files.items():
        (tmp_path / f"logicpack/{name}.py").write_text(text)
    monkeypatch.syspath_prepend(str(tmp_path))
    of = lambda: inc.logic_fingerprint(["logicpack.facts"])
    first = of()
    assert set(inc.logic_closure(["logicpack.facts"])) == {f"logicpack{m}" for m in ("", ".facts", ".sub", ".sub.help", ".sub.far", ".tables")}
    for name, old, new, same in (
        ("tables", "RATE = 2", "RATE = 3", False), ("sub/far", "return x", "return -x", False), ("sub/help", "'says'", "'says more'  # and more", True),
        ("other", "facts", "facts as f", True), ("tables", "RATE = 2", "RATE  =  2  # as before", True),
    ):
        path = tmp_path / f"logicpack/{name}.py"
        path.write_text(files[name].replace(old, new))
        assert (of() == first) == same, (name, new)
        path.write_text(files[name])


def test_source_hash_ignores_order_and_volatile_keys(spark):
    kind = "activity_id long, payload_kind string, payload_json string"
    a = spark.createDataFrame([(1, "summary", '{"a":1,"kudos_count":2}'), (1, "detail", '{"b":1}')], kind)
    b = spark.createDataFrame([(1, "detail", '{"b": 1}'), (1, "summary", '{"kudos_count":9,"a":1}')], kind)
    assert inc.source_hashes(a).first().source_hash == inc.source_hashes(b).first().source_hash


def test_stages_resume():
    calls, broken = [], [True]

    def fetch():
        calls.append("fetch")

    def compute():
        calls.append("compute")
        if broken.pop() if broken else False:
            raise RuntimeError("no")

    run = runtime.StageRun({"fetch": fetch, "compute": compute})
    with pytest.raises(RuntimeError):
        run.run()
    assert run.failed == "compute" and run.run() and calls == ["fetch", "compute", "compute"]
    assert runtime.retry_at(10.0, "rate_limit") == 910.0
    assert runtime.source_window(date(2026, 5, 9), date(2026, 5, 1), date(2026, 5, 8)) == (None, True)
    assert runtime.source_window(date(2026, 5, 9), date(2026, 5, 5), date(2026, 5, 8)) == (date(2026, 5, 7), False)
    data = [{"n": k} for k in range(5)]
    assert list(runtime.pages(lambda p, s: data[(p - 1) * s : p * s], 2)) == data


def test_stages_resume_with_a_new_driver(spark, tmp_path):
    store, calls = sinks.Store(spark, str(tmp_path / "s")), []

    def broken():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        runtime.StageRun({"fetch": lambda: calls.append("fetch"), "compute": broken}, store=store).run()
    anew = {name: lambda name=name: calls.append(name) for name in ("fetch", "compute")}
    assert runtime.StageRun(anew, store=store).run() and calls == ["fetch", "compute"]
    assert runtime.StageRun(anew, store=store).run() and calls == ["fetch", "compute"] * 2


def test_requests(spark):
    df = spark.createDataFrame([("manual", "2026-05-01T01:00:00"), ("manual", "2026-05-01T02:00:00"), ("auto", "2026-05-01T01:00:00")], "reason string, requested_at string")
    assert sorted((r.reason, r.requested_at) for r in runtime.requests(df).collect()) == [("auto", "2026-05-01T01:00:00"), ("manual", "2026-05-01T01:00:00")]


def _events(spark):
    start = datetime(2026, 1, 1)
    rows = [(k, start + timedelta(hours=k * (1 if k % 10 else 5)), k % 3, "view" if k % 2 else "click", k / 4) for k in range(120)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")


@pytest.mark.parametrize("job", [jobs.daily_values, jobs.sessions])
def test_stream_equals_batch(spark, tmp_path, job):
    events = _events(spark)
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    name = f"out_{job.__name__}"
    query = job(stream, late="30 days").writeStream.format("memory").queryName(name).outputMode("complete" if job is jobs.daily_values else "append")
    if job is jobs.daily_values:
        running = query.trigger(availableNow=True).start()
        running.awaitTermination()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, job(events).collect()))
    else:
        running = query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        running.awaitTermination()
        known = {str(r) for r in job(events).collect()}
        assert {str(r) for r in spark.table(name).collect()} <= known


def test_promotion_stream(spark, tmp_path):
    kind = "activity_id long, payload_kind string, fetched_at string, payload_json string, raw_hash string"
    store, seen = sinks.Store(spark, str(tmp_path / "store")), []
    for turn, rows in enumerate(([(1, "summary", "1", "a", "a"), (2, "summary", "1", "b", "b")], [(1, "summary", "2", "a", "a"), (2, "summary", "2", "c", "c")])):
        spark.createDataFrame(rows, kind).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        query = jobs.promote(stream, store, "payloads", str(tmp_path / "cp"), lambda new: seen.append(new.count()))
        query.awaitTermination()
        assert query.exception() is None
    assert seen == [2, 1] and store.read("payloads").count() == 3
    assert len(store.manifest()[1]["payloads"]) == 2  # a batch adds a folder and leaves the others


def test_stateful_promotion_goes_on_after_a_restart_and_never_reads_the_log(spark, tmp_path, monkeypatch):
    kind = "activity_id long, payload_kind string, fetched_at string, payload_json string, raw_hash string"
    store, seen = sinks.Store(spark, str(tmp_path / "store")), []
    store.commit({"payloads": spark.createDataFrame([(9, "summary", "0", "z", "z"), (1, "detail", "0", "a", "a")], kind)})
    batches = [
        [(1, "summary", "1", "a", "a"), (2, "summary", "1", "b", "b"), (9, "summary", "1", "z", "z"), (9, "summary", "2", "y", "y")],
        [(1, "summary", "2", "a", "a"), (2, "summary", "3", "c", "c"), (2, "summary", "2", "b", "b"), (1, "detail", "3", "a", "a")],
        [(2, "summary", "4", "c", "c"), (2, "summary", "5", "b", "b"), (9, "summary", "3", "z", "z")],
    ]
    plain = spark.createDataFrame([(9, "summary", "0", "z", "z"), (1, "detail", "0", "a", "a")], kind)
    for turn, rows in enumerate(batches):  # each turn is a new query over the same checkpoint
        new = spark.createDataFrame(rows, kind)
        new.repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        query = jobs.promote(stream, store, "payloads", str(tmp_path / "cp"), lambda new: seen.append(new.count()), stateful=True)
        if turn == 0:  # the state begins with the log's heads; from now on no batch may touch it
            real = store.read
            monkeypatch.setattr(store, "read", lambda n: real(n) if n.endswith("_progress") or stream is None else (_ for _ in ()).throw(AssertionError(n)))
            monkeypatch.setattr(store, "exists", lambda n: n.endswith("_progress") and n in store.manifest()[1])
        query.awaitTermination()
        assert query.exception() is None
        plain = stored(plain.unionByName(sinks.append_changed(plain, new, ["activity_id", "payload_kind"])))
    assert seen == [3, 1, 2]
    assert sorted(map(str, real("payloads").collect())) == sorted(map(str, plain.collect()))


def test_a_batch_that_runs_again_appends_nothing(spark, tmp_path):
    kind = "activity_id long, payload_kind string, fetched_at string, payload_json string, raw_hash string"
    store, broken, seen = sinks.Store(spark, str(tmp_path / "store")), [True], []
    rows = [(1, "summary", "1", "a", "a"), (1, "summary", "2", "b", "b"), (1, "summary", "3", "b", "b")]
    spark.createDataFrame(rows, kind).repartition(1).write.parquet(str(tmp_path / "in"))

    def then(new):
        if broken.pop() if broken else False:
            raise RuntimeError("lost after the commit")
        seen.append(new.count())

    for _ in range(2):
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        query = jobs.promote(stream, store, "payloads", str(tmp_path / "cp"), then)
        try:
            query.awaitTermination()
        except Exception:
            assert not seen
    assert seen == [2] and store.read("payloads").count() == 2


def test_tables_grow_by_folders(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path / "s"))
    store.commit({"a": spark.range(3), "b": spark.range(2)})
    store.commit({"b": spark.range(1)}, grown={"a": store.stage("a", spark.range(3, 5))})
    assert sorted(r.id for r in store.read("a").collect()) == [0, 1, 2, 3, 4] and store.read("b").count() == 1
    assert store.vacuum(keep_s=0) == 1 and store.read("a").count() == 5
    store.commit({"a": store.read("a")})
    assert len(store.manifest()[1]["a"]) == 1 and store.read("a").count() == 5
