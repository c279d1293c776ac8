"""Answers kept for a short time, until the store they came from changes."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from paceforge.sources.sinks import Store

#: Seconds that an answer is kept, and how many are.
KEEP_S, ENTRIES = 30.0, 32


class ResponseMemo:
    """Persisted answers by request and by the store's commit.

    An answer is a small table (the rows of a service), held in executor memory and spilled to disk.  It is given
    again within ``keep_s`` seconds of its making while no commit came after it; else it is released and built
    anew.  Beyond ``entries`` answers the one asked for longest ago is released.
    """

    def __init__(self, store: Store, keep_s: float = KEEP_S, entries: int = ENTRIES, clock: Callable[[], float] = time.monotonic) -> None:
        if entries < 1:
            raise ValueError("a memo keeps one answer at least")
        self.store, self.keep_s, self.entries, self.clock = store, keep_s, entries, clock
        self._kept: OrderedDict[str, tuple[int, float, DataFrame]] = OrderedDict()
        self.hits = 0

    def answer(self, service: str, request: Mapping[str, object], build: Callable[[], DataFrame]) -> DataFrame:
        """What ``build`` gives for the request; equal requests are equal whatever the order of their keys."""
        key = json.dumps([service, request], sort_keys=True, default=str)
        turn, now = self.store.manifest()[0], self.clock()
        for old in [k for k, (t, at, _) in self._kept.items() if t != turn or now - at >= self.keep_s]:
            self._release(old)
        if key in self._kept:
            self.hits += 1
            self._kept.move_to_end(key)
            return self._kept[key][2]
        rows = build().persist()
        self._kept[key] = (turn, now, rows)
        while len(self._kept) > self.entries:
            self._release(next(iter(self._kept)))
        return rows

    def _release(self, key: str) -> None:
        self._kept.pop(key)[2].unpersist()

    def clear(self) -> None:
        for key in list(self._kept):
            self._release(key)
