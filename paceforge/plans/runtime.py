"""Orchestration around the plans: stages that resume, backoff, source windows, request queue."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.sources.sinks import Store

#: Seconds to wait after a failure, by its class.
BACKOFF_S = {"rate_limit": 900, "transient": 60, "auth": 3600}
FULL_EVERY_DAYS = 7


@dataclass
class StageRun:
    """Runs named stages in order and remembers those done, so a later run goes on where one failed.

    With a store they are kept in its table ``table``, and outlive the driver; a run that ends whole clears it.
    """

    stages: Mapping[str, Callable[[], None]]
    done: list[str] = field(default_factory=list)
    failed: str | None = None
    store: Store | None = None
    table: str = "stages"

    def __post_init__(self) -> None:
        if self.store is not None and self.store.exists(self.table):
            self.done = [r.name for r in self.store.read(self.table).collect()]

    def _keep(self, names: list[str]) -> None:
        if self.store is not None:
            self.store.commit({self.table: self.store.spark.createDataFrame([(n,) for n in names], "name string")})

    def run(self) -> bool:
        self.failed = None
        for name, work in self.stages.items():
            if name in self.done:
                continue
            try:
                work()
            except Exception:
                self.failed = name
                raise
            self.done.append(name)
            self._keep(self.done)
        self._keep([])
        return True


def retry_at(now: float, kind: str) -> float:
    return now + BACKOFF_S.get(kind, BACKOFF_S["transient"])


def source_window(today: date, last_full: date | None, newest: date | None) -> tuple[date | None, bool]:
    """(first day to fetch or None for all, whether it is a full pass): all once a week, else from the newest day on."""
    full = last_full is None or (today - last_full).days >= FULL_EVERY_DAYS or newest is None
    return (None, True) if full else (newest - timedelta(days=1), False)


def pages(fetch: Callable[[int, int], list[dict]], size: int = 200) -> Iterator[dict]:
    """Rows of a paged source, one page at a time, up to the first short page."""
    number = 1
    while True:
        rows = fetch(number, size)
        yield from rows
        if len(rows) < size:
            return
        number += 1


def requests(df: DataFrame) -> DataFrame:
    """Refresh requests, the first of each reason and day."""
    day = F.to_date("requested_at")
    return df.groupBy("reason", day.alias("day")).agg(F.min("requested_at").alias("requested_at"))
