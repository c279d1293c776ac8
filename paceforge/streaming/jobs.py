"""Streaming twins: daily sums with a watermark, sessions, incremental promotion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from paceforge.sources.sinks import Store, append_changed


def daily_values(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Count and sum of each day and event type; rows later than ``late`` are left out.  Batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").cast("date").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Runs of a user's events without a gap of ``gap`` or more.  Batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class LatestHash(StatefulProcessor):
    """Passes on the payloads of a key that differ from the one before; the state is the latest one passed on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "fetched_at string, raw_hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["fetched_at", "raw_hash"])
        known = self.latest.get() if self.latest.exists() else None
        before = new["raw_hash"].shift()
        before.iloc[0] = known[1] if known else None
        out = new[(new["raw_hash"] != before).to_numpy()]
        if len(out):
            top = (out["fetched_at"].iloc[-1], out["raw_hash"].iloc[-1])
            self.latest.update(top if known is None else max(top, tuple(known)))
        yield out

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.latest.update((initialState["fetched_at"].iloc[0], initialState["raw_hash"].iloc[0]))

    def close(self) -> None:
        pass


def changed_payloads(payloads: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """The stream's payloads that differ from the latest of their activity and kind, by state instead of the log.

    The state store holds one time and hash for each key, so a micro-batch costs what its own rows cost, however
    long the log is.  ``log``: one that is there before the first batch; its heads are the first state.
    Needs the RocksDB state store, which the session is told to use.
    """
    keys = ["activity_id", "payload_kind"]
    payloads.sparkSession.conf.set(*_ROCKS)
    heads = None
    if log is not None:
        top = log.groupBy(*keys).agg(F.max(F.struct("fetched_at", "raw_hash")).alias("x"))
        heads = top.select(*keys, "x.fetched_at", "x.raw_hash").groupBy(*keys)
    return payloads.groupBy(*keys).transformWithStateInPandas(
        LatestHash(), outputStructType=payloads.schema, outputMode="Append", timeMode="None", initialState=heads
    )


_ROCKS = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def promote(
    payloads: DataFrame,
    store: Store,
    name: str,
    checkpoint: str,
    then: Callable[[DataFrame], None] | None = None,
    stateful: bool = False,
) -> StreamingQuery:
    """Append a stream of payloads to a log where they differ from the latest; ``then`` gets what was new.

    ``stateful``: differences are told by changed_payloads(), so that no batch reads the log.  A batch adds a folder to the log and notes itself in ``{name}_progress`` in one
    commit, so a batch that is run again appends nothing; ``then`` sees its rows again.
    """
    progress = f"{name}_progress"

    def batch(rows: DataFrame, number: int) -> None:
        notes = store.read(progress).collect() if store.exists(progress) else []  # one row for each checkpoint
        mine = next((r for r in notes if r.checkpoint == checkpoint), None)
        if mine is None or mine.batch < number:
            rows = rows.persist()
            if stateful:
                new = rows
            else:
                known = store.read(name) if store.exists(name) else rows.limit(0)
                new = append_changed(known, rows, ["activity_id", "payload_kind"]).select(*known.columns)
            folder = store.stage(name, new)
            rows.unpersist()
            notes = [r for r in notes if r.checkpoint != checkpoint] + [(checkpoint, number, folder)]
            table = rows.sparkSession.createDataFrame(notes, "checkpoint string, batch long, folder string")
            grows = not (store.exists(name) and store.staged(folder).isEmpty())
            store.commit({progress: table}, grown={name: folder} if grows else None)
        else:
            folder = mine.folder
        if then is not None:
            then(store.staged(folder))

    if stateful:
        begun = store.exists(progress) and not store.read(progress).filter(F.col("checkpoint") == checkpoint).isEmpty()
        payloads = changed_payloads(payloads, store.read(name) if not begun and store.exists(name) else None)
    return payloads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
