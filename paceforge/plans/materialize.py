"""One incremental run over a store: claim, compute, commit."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.constants import RESTING_HR, ROLLING_WINDOWS
from paceforge.functions.zones import DEFAULT_MODEL
from paceforge.operators.streams import heart_rate_tier, running_max_hr, zoned
from paceforge.plans import facts as fx
from paceforge.plans import incremental as inc
from paceforge.sources.sinks import Store, month_of, with_next_ids

FACT_TABLES = ("activity_facts", "daily_facts", "model_facts", "rolling_facts")
#: The day of each table that is kept by months.
DAY_OF = {
    "heart_rates": "activity_day", "activity_facts": "activity_day", "daily_facts": "day", "model_facts": "day", "rolling_facts": "as_of_day",
}
LEDGER = "id long, timestamp string, status string, metric_version long, claimed long, since string, pruned long, error string"


def _ledger(store: Store, status: str, at: str, version: int, claimed: int, since: date | None = None, pruned: int = 0, error: str | None = None) -> DataFrame:
    spark: SparkSession = store.spark
    row = spark.createDataFrame([(None, at, status, version, claimed, since and since.isoformat(), pruned, error)], LEDGER)
    old = store.read("ledger") if store.exists("ledger") else spark.createDataFrame([], LEDGER)
    return old.unionByName(with_next_ids(old, row))


def _months(days: DataFrame, day: str) -> set[str]:
    """The months of some rows: few, however many the rows."""
    return {r[0] for r in days.select(F.date_format(day, "yyyy-MM")).distinct().collect()}


class _Run:
    """The tables of one run: those that it has staged, over those last committed."""

    def __init__(self, store: Store, at: str) -> None:
        self.store, self.at, self.changes = store, at, {}
        self.turn, self.folders = store.manifest()

    def months(self, name: str) -> set[str]:
        return {m for f in self.folders.get(name, ()) if (m := month_of(f))}

    def put(self, name: str, rows: DataFrame, months: set[str], kept: DataFrame | None = None) -> None:
        """Stage the new rows of some months, with the time of the run, beside those that stay."""
        rows = rows.withColumn("computed_at", F.lit(self.at))
        staged = self.store.stage_months(name, rows if kept is None else kept.select(*rows.columns).unionByName(rows), DAY_OF[name])
        self.changes[name] = (staged, months)
        gone = {*months, *map(month_of, staged), ""}
        self.folders = self.folders | {name: [f for f in self.folders.get(name, ()) if month_of(f) not in gone] + staged}

    def read(self, name: str, since: date | None = None, months: set[str] | None = None) -> DataFrame | None:
        """Rows of some months, or of those from that of ``since`` on; None if the table has none of them."""
        folders = self.folders.get(name, [])
        if months is not None:
            folders = [f for f in folders if month_of(f) in months]
        elif since is not None:
            folders = [f for f in folders if month_of(f) >= since.strftime("%Y-%m")]
        return self.store.staged(*folders) if folders else None


def _moved_months(facts: DataFrame, days: DataFrame, since: date, version: int) -> set[str]:
    """Months of facts from ``since`` on whose zones rest on another maximum than the one that now holds on their day."""
    rows = facts.filter((F.col("metric_version") == version) & (F.col("activity_day") >= F.lit(since)) & (F.col("heartrate_sample_count") > 0))
    used = rows.groupBy("activity_day").agg(F.min("hr_max_used").alias("low"), F.max("hr_max_used").alias("high"))
    now = used.join(F.broadcast(days), "activity_day")
    return _months(now.filter("low <> max_hr_to_day OR high <> max_hr_to_day"), "activity_day")


def _rezoned(facts: DataFrame, tier: DataFrame, days: DataFrame, hr_rest: int, zone_model: str) -> DataFrame:
    """Facts with zones and load by the maximum that now holds on their day; from the tier, without samples."""
    own = ("hr_max_used", "trimp", *(f"zone{k}_seconds" for k in range(1, 6)))
    rest = [c for c in facts.columns if c not in own]
    rated = facts.select(*rest).join(F.broadcast(days), "activity_day").join(tier.select("activity_id", "hr_count", "rates"), "activity_id", "left")
    return zoned(rated, hr_rest, tuple(rest), zone_model).withColumn("trimp", F.coalesce("trimp", F.lit(0.0))).select(*facts.columns)


def materialize(
    store: Store,
    limit: int,
    at: str,
    metric_version: int = 1,
    hr_rest: int = RESTING_HR,
    today: date | None = None,
    zone_model: str = DEFAULT_MODEL,
) -> int:
    """Recompute what the earliest dirty days need and commit all tables at once; returns the rows claimed.

    The store holds activities, samples and queue (activity_id, ...).  An activity counts from the run on that
    first claims it.  Samples are read for claimed activities only, into the heart-rate tier and their facts; a higher
    maximum changes the zones of later activities, which follow from the tier.  Days, model and windows run to
    ``today``, or the last activity if that is later, and are recomputed from the first dirty day on: the fold goes
    on from the stored state of the day before, windows need 89 days of days and facts before it.  Only if
    the highest heart rate of all changed, or the version, they are recomputed from the first day, as every load
    rests on it.  Tables are kept by months; others than those touched are neither read whole nor written.

    ``zone_model`` must be one for each version.  Superseded versions go when the queue is empty.  A failed run is entered in the ledger and raises.
    """
    activities, samples, queue = store.read("activities"), store.read("samples"), store.read("queue")
    run = _Run(store, at)
    claimed = inc.claim(queue, activities, limit).select("activity_id", "activity_day").persist()
    try:
        n = claimed.count()
        if n == 0:
            store.commit({"ledger": _ledger(store, "ok", at, metric_version, 0)})
            return 0
        rest = inc.cleared(queue, claimed)
        tier, facts = run.read("heart_rates"), run.read("activity_facts")
        before = claimed.select("activity_day")
        top_before = tier.agg(F.max("max_hr")).first()[0] if tier is not None else None
        if facts is not None:  # an activity may have come from another day
            before = before.unionByName(facts.join(F.broadcast(claimed.select("activity_id")), "activity_id", "left_semi").select("activity_day"))
        first_dirty = before.agg(F.min("activity_day")).first()[0]
        months = _months(before, "activity_day")

        ids = claimed.select("activity_id")
        kept = run.read("heart_rates", months=months)
        kept = kept.join(ids, "activity_id", "left_anti") if kept is not None else None
        own_samples = samples.join(ids, "activity_id", "left_semi")
        run.put("heart_rates", claimed.join(heart_rate_tier(own_samples), "activity_id", "left"), months, kept)
        tier = run.read("heart_rates").drop("activity_day", "computed_at")
        counted = activities.join(tier.select(F.col("activity_id").alias("id")), "id", "left_semi")
        days = running_max_hr(counted, tier)

        moved = _moved_months(facts, days, first_dirty, metric_version) if facts is not None else set()
        stale = set()
        pruned = 0
        if facts is not None and rest.isEmpty():
            superseded = facts.filter(F.col("metric_version") < metric_version)
            stale, pruned = _months(superseded, "activity_day"), superseded.count()
        months = months | moved | stale
        new = fx.activity_facts(counted, samples, hr_rest, metric_version, only=claimed, tier=tier, zone_model=zone_model)
        kept = run.read("activity_facts", months=months)
        if kept is not None:
            own = F.col("metric_version") == metric_version
            current = _rezoned(kept.filter(own).join(ids, "activity_id", "left_anti"), tier, days, hr_rest, zone_model)
            older = kept.filter(~own) if not stale else kept.filter(F.col("metric_version") > metric_version)
            kept = current.unionByName(older)
        run.put("activity_facts", new, months, kept)

        top = tier.agg(F.max("max_hr")).first()[0]
        since = None if stale else _first_day_to_compute(run, first_dirty, metric_version, top == top_before)
        _put_days(run, counted, tier, hr_rest, metric_version, since, top, today, bool(stale), zone_model)
        ledger = _ledger(store, "ok", at, metric_version, n, since, pruned)
        store.commit({"queue": rest, "ledger": ledger}, base=run.turn, months=run.changes)
        return n
    except Exception as e:
        store.commit({"ledger": _ledger(store, "failed", at, metric_version, 0, error=str(e)[:500])})
        raise
    finally:
        claimed.unpersist()


def _first_day_to_compute(run: _Run, first_dirty: date, version: int, same_limits: bool) -> date | None:
    """The first dirty day, or the day after the last one stored if that is earlier; None for all days."""
    daily = run.read("daily_facts")
    if daily is None or not same_limits:
        return None
    ends = daily.filter(F.col("metric_version") == version).agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    if ends["first"] is None or first_dirty <= ends["first"]:
        return None
    return min(first_dirty, ends["last"] + timedelta(days=1))


def _put_days(
    run: _Run, activities: DataFrame, tier: DataFrame, hr_rest: int, version: int, since: date | None, top: int | None, today: date | None, prune: bool, zone_model: str
) -> None:
    """Stage days, model and windows of one version, from ``since`` on."""
    history = since - timedelta(days=max(ROLLING_WINDOWS) - 1) if since else None
    seed = None
    if since:
        day = since - timedelta(days=1)
        state = run.read("model_facts", months={day.strftime("%Y-%m")}).filter((F.col("day") == F.lit(day)) & (F.col("metric_version") == version)).first()
        seed = (day, state["fitness"], state["fatigue"])

    def put(name: str, rows: DataFrame) -> None:
        day = DAY_OF[name]
        months = {m for m in run.months(name) if since is None or m >= since.strftime("%Y-%m")}
        kept = run.read(name, months=months)
        if kept is not None:
            own = F.col("metric_version") == version
            stays = (own & (F.col(day) < F.lit(since))) if since else F.lit(False)
            kept = kept.filter(stays if prune else stays | ~own)
        run.put(name, rows, months, kept)

    facts = run.read("activity_facts", since=history).drop("computed_at")
    load = fx.daily_load(activities, tier, hr_rest, today, since, top if top is not None else hr_rest + 1, zone_model)
    put("daily_facts", fx.daily_facts(load, facts, version))
    daily = run.read("daily_facts", since=history).filter(F.col("metric_version") == version)
    put("model_facts", fx.model_facts(daily if since is None else daily.filter(F.col("day") >= F.lit(since)), version, seed))
    model = run.read("model_facts", since=since)
    if since:
        daily, facts = daily.filter(F.col("day") >= F.lit(history)), facts.filter(F.col("activity_day") >= F.lit(history))
    own = run.read("activity_facts").filter(F.col("metric_version") == version)
    between = (since, daily.agg(F.max("day")).first()[0]) if since else None
    put("rolling_facts", fx.whole_rolling_facts(daily, facts, model, metric_version=version, between=between, firsts=fx.first_days(own)))


def refresh_logic(store: Store, fingerprint: str, at: str) -> int:
    """The version that the logic calls for; if it changed, every activity is queued again."""
    spark: SparkSession = store.spark
    stored = tuple(store.read("logic").select("version", "fingerprint").first()) if store.exists("logic") else None
    version, anew = inc.next_version(stored, fingerprint)
    if anew:
        ids = store.read("activities").select(F.col("id").alias("activity_id"))
        empty = spark.createDataFrame([], "activity_id long, reason string, enqueued_at string, attempts long")
        queue = store.read("queue") if store.exists("queue") else empty
        logic = spark.createDataFrame([(version, fingerprint)], "version int, fingerprint string")
        store.commit({"queue": inc.enqueue(queue, ids, "logic_changed", at), "logic": logic})
    return version


def status(store: Store) -> dict[str, object]:
    """Dirty rows, the oldest of them, and the last good run."""
    queue = store.read("queue").agg(F.count(F.lit(1)).alias("dirty"), F.min("enqueued_at").alias("oldest")).first()
    good = store.read("ledger").filter("status = 'ok'").agg(F.max("timestamp")).first() if store.exists("ledger") else [None]
    return {"dirty_count": queue.dirty, "oldest_enqueued_at": queue.oldest, "last_ok_at": good[0]}
