"""A source that gives rows page by page, as a batch and a streaming Spark source.

``fetch(page, size, after, options)`` returns the rows of one page, pages count
from 1, rows come in order of their mark (a text that grows, such as the time of
a change), and a page with fewer than ``size`` rows is the last one.  The function
is named by the option ``fetch`` as "module:function" and must be importable
where tasks run; it is all that knows how pages are got.

A task takes every n-th page and stops at its first short one, so n tasks fetch
at the same time and n - 1 empty pages at most are asked for in vain.

As a stream, ``newest(options)`` (option ``newest``) tells the latest mark.  A
batch has the rows after the mark where the last batch ended, up to that one;
what comes while pages are read belongs to the next batch, and a batch that runs
again gives the same rows.  Once in ``full_every`` days a batch takes all pages,
so that changes of older rows are seen.

Options: fetch, newest, mark (the column, default "updated_at"), size (200),
tasks (4), after (batch only), full_every (7; 0 for never), now (a day, for
tests).  Rows are dicts; columns of the schema that a row lacks are null, others
are left out.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from datetime import UTC, date, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def _named(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


@dataclass
class Pages(InputPartition):
    """Every ``step``-th page from ``first`` on, of the rows after one mark and up to another."""

    first: int
    step: int
    after: str | None = None
    upto: str | None = None


class _Reading:
    def __init__(self, options: Mapping[str, str], schema: StructType) -> None:
        if not options.get("fetch"):
            raise ValueError("option fetch must name a function as module:function")
        self.options, self.names = dict(options), schema.names
        self.mark = options.get("mark", "updated_at")
        self.size, self.tasks = int(options.get("size", 200)), int(options.get("tasks", 4))
        if self.size < 1 or self.tasks < 1:
            raise ValueError("size and tasks must be 1 or more")

    def pages(self, after: str | None = None, upto: str | None = None) -> list[Pages]:
        return [Pages(k + 1, self.tasks, after, upto) for k in range(self.tasks)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        fetch, page = _named(self.options["fetch"]), partition.first
        while True:
            rows = fetch(page, self.size, partition.after, self.options)
            for row in rows:
                mark = row.get(self.mark)
                if (partition.after is None or mark > partition.after) and (partition.upto is None or mark is None or mark <= partition.upto):
                    yield tuple(row.get(c) for c in self.names)
            if len(rows) < self.size:
                return
            page += partition.step


class PagedReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Pages]:
        return self.pages(self.options.get("after"))


class PagedStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"mark": None, "period": None}

    def latestOffset(self) -> dict:
        """The newest mark, and the number of the period of ``full_every`` days that has begun."""
        every = int(self.options.get("full_every", 7))
        now = self.options.get("now")
        today = date.fromisoformat(now) if now else datetime.now(UTC).date()
        return {"mark": _named(self.options["newest"])(self.options), "period": today.toordinal() // every if every else None}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        full = start["mark"] is None or start["period"] != end["period"]
        return self.pages(None if full else start["mark"], end["mark"])

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """``spark.read.format("paged")`` and ``spark.readStream.format("paged")``, once registered; a schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> StructType:
        raise ValueError("give the schema of a paged source")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options, schema)

    def streamReader(self, schema: StructType) -> PagedStreamReader:
        if not self.options.get("newest"):
            raise ValueError("option newest must name a function as module:function")
        return PagedStreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
