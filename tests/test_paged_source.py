"""The paged source as batch and stream, over pages of a JSON file that grows between batches."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from paceforge.sources import paged

KIND = "id long, name string, updated_at string, more string"
HERE = "tests.test_paged_source"


def _rows(options):
    rows = json.loads(Path(options["file"]).read_text())
    return sorted(rows, key=lambda r: (r["updated_at"], r["id"]))


def fetch(page, size, after, options):
    rows = [r for r in _rows(options) if after is None or r["updated_at"] > after]
    with open(options["file"] + ".asked", "a") as f:
        f.write(f"{page} {after}\n")
    return rows[(page - 1) * size : page * size]


def newest(options):
    return max(r["updated_at"] for r in _rows(options))


def _file(path, n, start=0, day="01"):
    rows = json.loads(path.read_text()) if path.exists() else []
    rows += [{"id": start + k, "name": f"n{k}", "updated_at": f"2026-01-{day}T{k:04d}", "left_out": 1} for k in range(n)]
    path.write_text(json.dumps(rows))
    return str(path)


@pytest.mark.parametrize("n, tasks", [(0, 3), (1, 1), (20, 1), (20, 3), (23, 2), (23, 9)])
def test_batch_reads_every_row_once_and_stops_at_short_pages(spark, tmp_path, n, tasks):
    paged.register(spark)
    file = _file(tmp_path / "a.json", n)
    df = spark.read.format("paged").schema(KIND).options(fetch=f"{HERE}:fetch", file=file, size=5, tasks=tasks).load()
    assert df.rdd.getNumPartitions() == tasks
    found = sorted(tuple(r) for r in df.collect())
    assert found == [(k, f"n{k}", f"2026-01-01T{k:04d}", None) for k in range(n)]
    asked = Path(file + ".asked").read_text().splitlines()
    assert len(asked) == len(set(asked)) <= n // 5 + 1 + tasks - 1


def test_batch_after_a_mark_and_bad_options(spark, tmp_path):
    paged.register(spark)
    file = _file(tmp_path / "a.json", 12)
    read = lambda **o: spark.read.format("paged").schema(KIND).options(**o).load()
    assert sorted(r.id for r in read(fetch=f"{HERE}:fetch", file=file, size=4, after="2026-01-01T0008").collect()) == [9, 10, 11]
    for bad in ({}, {"fetch": f"{HERE}:fetch", "size": 0}, {"fetch": f"{HERE}:fetch", "tasks": 0}):
        with pytest.raises(Exception, match="must"):
            read(**bad).collect()


def test_stream_resumes_at_its_mark_and_takes_all_once_a_week(spark, tmp_path):
    paged.register(spark)
    path, out = tmp_path / "a.json", str(tmp_path / "out")

    def batch(now):
        """What a new query over the same checkpoint adds, and the marks that it asked for."""
        file = _file(path, 0)
        Path(file + ".asked").unlink(missing_ok=True)
        options = {"fetch": f"{HERE}:fetch", "newest": f"{HERE}:newest", "file": file, "size": "4", "tasks": "2", "now": now}
        stream = spark.readStream.format("paged").schema(KIND).options(**options).load()
        before = spark.read.schema(KIND).parquet(out).count() if Path(out).exists() else 0
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        query.awaitTermination()
        assert query.exception() is None
        rows = sorted(r.id for r in spark.read.schema(KIND).parquet(out).collect())
        asked = Path(file + ".asked")
        marks = {line.split(" ", 1)[1] for line in asked.read_text().splitlines()} if asked.exists() else set()
        return rows, len(rows) - before, marks

    _file(path, 10)
    assert batch("2026-01-05") == (list(range(10)), 10, {"None"})
    assert batch("2026-01-05")[1] == 0  # nothing new
    _file(path, 3, start=50, day="02")
    rows, added, marks = batch("2026-01-06")
    assert added == 3 and marks == {"2026-01-01T0009"} and rows[-3:] == [50, 51, 52]
    _file(path, 1, start=60, day="03")
    rows, added, marks = batch("2026-01-13")  # another week: all rows again
    assert added == 14 and marks == {"None"}
