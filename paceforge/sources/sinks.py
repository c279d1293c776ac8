"""Writers for Parquet tables: append, upsert, replace, prune, compact.

Parquet has no MERGE.  Tables that change are written to new folders and then
named by a manifest, so a reader never sees half a change and a lost executor
costs a retry.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: New keys of this many rows at most are broadcast.
_FEW = 500_000


_MONTH = "month"


def month_of(folder: str) -> str:
    """The month of a folder written by Store.stage_months(), else an empty text."""
    return folder.partition(f"/{_MONTH}=")[2]


class MirrorMissing(RuntimeError):
    """A table that must exist does not."""


class Conflict(RuntimeError):
    """Another writer committed first."""


class Store:
    """Parquet tables under ``path``: data folders, and manifests that name the current folders of each table.

    A commit writes all changed tables to new folders and then creates the next
    manifest; creating it is the commit, and fails if another writer was first.
    A table that only grows gets one folder more for each commit, and its older
    rows are neither read nor written.  Any file system that Hadoop knows will do.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, prefix: str) -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        return sorted(n for s in self._fs.listStatus(self._at("")) if (n := s.getPath().getName()).startswith(prefix))

    def _create(self, name: str, text: str) -> None:
        """A new small file; raises Conflict if it exists.

        The file system must create a file only where none is, as HDFS and local ones do; on an
        object store without such a request two writers could both succeed, so there one must
        write at a time (acquire()).
        """
        try:
            out = self._fs.create(self._at(name), False)
        except Exception as e:
            raise Conflict(name) from e
        out.write(bytearray(text.encode()))
        out.close()

    def _text(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def manifest(self) -> tuple[int, dict[str, list[str]]]:
        """(number, folders of each table); (0, {}) before the first commit."""
        names = self._names("manifest-")
        if not names:
            return 0, {}
        tables = json.loads(self._text(names[-1]))
        return int(names[-1].split("-")[1]), {t: [f] if isinstance(f, str) else f for t, f in tables.items()}

    def exists(self, name: str) -> bool:
        return name in self.manifest()[1]

    def read(self, name: str, schema: StructType | str | None = None) -> DataFrame:
        """The table as last committed; raises MirrorMissing without one, ValueError if columns are missing."""
        folders = self.manifest()[1]
        if name not in folders:
            raise MirrorMissing(f"no table {name} at {self.path}")
        df = self.staged(*folders[name])
        if schema is not None:
            wanted = schema if isinstance(schema, StructType) else self.spark.createDataFrame([], schema).schema
            if lacking := [f.name for f in wanted if f.name not in df.columns]:
                raise ValueError(f"columns missing in {name}: {', '.join(lacking)}")
        return df

    def stage(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> str:
        """Write a table to a new folder that no manifest names yet; commit() takes the folder."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{folder}")
        return folder

    def stage_months(self, name: str, df: DataFrame, day: str) -> list[str]:
        """Write rows to a new folder for each month of ``day``; commit() takes the list as the table's new months."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        rows = df.withColumn(_MONTH, F.date_format(day, "yyyy-MM"))
        rows.repartition(_MONTH, F.pmod(F.xxhash64(day), F.lit(8))).write.partitionBy(_MONTH).parquet(f"{self.path}/{folder}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._at(folder)) if s.isDirectory()]
        return [f"{folder}/{m}" for m in sorted(found) if m.startswith(f"{_MONTH}=")] or [self.stage(name, df.limit(0))]

    def months(self, name: str) -> list[str]:
        """The months, as yyyy-MM, of a table that was written by months."""
        return sorted(m for f in self.manifest()[1].get(name, ()) if (m := month_of(f)))

    def read_months(self, name: str, months: Iterable[str]) -> DataFrame:
        """The rows of some months; the files of others are not touched."""
        folders = self.manifest()[1][name]
        wanted = set(months)
        return self.staged(*([f for f in folders if month_of(f) in wanted] or folders[:1])).filter(F.lit(bool(wanted & {*map(month_of, folders)})))

    def staged(self, *folders: str) -> DataFrame:
        """Rows of some folders, which have the same columns in the same order."""
        parts = [self.spark.read.parquet(f"{self.path}/{f}") for f in folders[:1]]
        if folders[1:]:
            rest = self.spark.read.schema(parts[0].schema).parquet(*[f"{self.path}/{f}" for f in folders[1:]])
            parts.append(rest.select(*parts[0].columns))
        return reduce(DataFrame.unionByName, parts)

    def commit(
        self,
        changes: Mapping[str, DataFrame | str],
        partition_by: Mapping[str, Sequence[str]] | None = None,
        base: int | None = None,
        grown: Mapping[str, str] | None = None,
        months: Mapping[str, tuple[Sequence[str], Iterable[str]]] | None = None,
    ) -> int:
        """Write the changed tables, then make them current all at once; returns the commit's number.

        A change is a DataFrame or a staged folder, and takes the table's place; the staged
        folders of ``grown`` join the table's others.  ``months``: for a table its folders by stage_months() and
        the months that they replace; its other months stay as they are.  ``base``: the commit that the changes
        were computed from; raises Conflict if another came after it.
        """
        turn, folders = self.manifest()
        if base is not None and base != turn:
            raise Conflict(f"commit {turn} came after {base}")
        written = {
            name: [df if isinstance(df, str) else self.stage(name, df, (partition_by or {}).get(name, ()))] for name, df in changes.items()
        }
        written |= {name: [*folders.get(name, ()), folder] for name, folder in (grown or {}).items()}
        for name, (staged, replaced) in (months or {}).items():
            gone = {*replaced, *map(month_of, staged), ""}
            written[name] = [f for f in folders.get(name, ()) if month_of(f) not in gone] + list(staged)
        self._create(f"manifest-{turn + 1:08d}", json.dumps(folders | written))
        return turn + 1

    def vacuum(self, keep_s: float = 86_400) -> int:
        """Delete data folders that the current manifest doesn't name; returns how many.

        Folders younger than ``keep_s`` stay: another writer may be about to commit them, or a reader may use them.
        """
        current = {f for folders in self.manifest()[1].values() for f in folders}
        whole = {f.split("/")[1] for f in current}
        before = (time.time() - keep_s) * 1000
        gone = 0
        for status in self._fs.listStatus(self._at("data")):
            name = status.getPath().getName()
            old = [status] if name not in whole else []
            if name in whole and f"data/{name}" not in current:  # months of it are in use
                parts = self._fs.listStatus(status.getPath())
                old = [p for p in parts if p.isDirectory() and f"data/{name}/{p.getPath().getName()}" not in current]
            for folder in old:
                if folder.getModificationTime() <= before:
                    gone += bool(self._fs.delete(folder.getPath(), True))
        return gone

    def acquire(self, owner: str, now: float, seconds: float) -> bool:
        """Take or renew the writer's lease; False while another owner's holds."""
        names = self._names("lease-")
        if names:
            held = json.loads(self._text(names[-1]))
            if held["owner"] != owner and held["until"] > now:
                return False
        turn = int(names[-1].split("-")[1]) + 1 if names else 1
        try:
            self._create(f"lease-{turn:08d}", json.dumps({"owner": owner, "until": now + seconds}))
        except Conflict:
            return False
        return True

    def release(self, owner: str) -> None:
        names = self._names("lease-")
        if names and json.loads(self._text(names[-1]))["owner"] == owner:
            turn = int(names[-1].split("-")[1]) + 1
            self._create(f"lease-{turn:08d}", json.dumps({"owner": owner, "until": 0}))


def append_changed(log: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose raw hash differs from that of the row before, in the log or in ``new`` itself.

    Both have fetched_at and raw_hash.  Of the log only the keys, times and hashes of the new rows' keys are read;
    files whose range of the first key lies apart from the new rows' are skipped.
    """
    wanted = new.select(*keys).distinct()
    first = F.col(keys[0])
    n, low, high = wanted.agg(F.count(F.lit(1)), F.min(first), F.max(first)).first()
    known = log.select(*keys, "fetched_at", "raw_hash")
    if low is not None:
        known = known.filter(first.between(F.lit(low), F.lit(high)))
    known = known.join(F.broadcast(wanted) if n <= _FEW else wanted, list(keys), "left_semi")
    heads = known.groupBy(*keys).agg(F.max(F.struct("fetched_at", "raw_hash"))["raw_hash"].alias("known_hash"))
    order = Window.partitionBy(*keys).orderBy("fetched_at", "raw_hash")
    rows = new.withColumn("before_hash", F.lag("raw_hash").over(order)).join(heads, list(keys), "left")
    before = F.coalesce("before_hash", "known_hash")
    return rows.filter(~F.col("raw_hash").eqNullSafe(before)).select(*new.columns)


def insert_missing(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Table and those new rows whose key it lacks."""
    return table.unionByName(new.join(table.select(*keys), list(keys), "left_anti").select(*table.columns))


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Table with new rows in place of those with their key."""
    kept = table.join(new.select(*keys), list(keys), "left_anti").select(*table.columns)
    return kept.unionByName(new.select(*table.columns))


def upsert_months(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], day: str, whole_keys: bool = True) -> list[str]:
    """Upsert into a Parquet table partitioned by the month of ``day``; only months of the new rows are read and written.

    Spark replaces those partitions as it commits the job (partitionOverwriteMode dynamic), and leaves the others
    alone.  A key must keep its month.  With ``whole_keys`` false ``keys`` name groups, of which all rows are replaced.
    Returns the months written.
    """
    rows = new.withColumn(_MONTH, F.date_format(day, "yyyy-MM"))
    months = sorted(r[0] for r in rows.select(_MONTH).distinct().collect())  # as many as there are months
    if whole_keys:
        assert_unique(new, keys)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        old = spark.read.schema(rows.schema).parquet(path).filter(F.col(_MONTH).isin(months))
        rows = upsert(old, rows, keys)
    rows = rows.repartition(_MONTH, F.pmod(F.xxhash64(*keys), F.lit(8)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_MONTH).parquet(path)
    return months


def replace_group(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Table with all rows of the new rows' groups replaced."""
    return upsert(table, new, [key])


def update_where_present(table: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Table with ``column`` taken from ``new`` where that has a value."""
    fresh = new.select(key, F.col(column).alias("__new"))
    return table.join(fresh, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new").select(*table.columns)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` as it is; raises ValueError if a key occurs twice."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key: {twice[0].asDict()}")
    return df


def with_next_ids(ledger: DataFrame, new: DataFrame, id_col: str = "id", order: str = "timestamp") -> DataFrame:
    """New ledger rows numbered on from the ledger's largest id; meant for a few rows."""
    top = ledger.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    place = F.row_number().over(Window.orderBy(order))
    return new.join(F.broadcast(top)).withColumn(id_col, F.col("top") + place).drop("top").select(*ledger.columns)


def compacted(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` dealt into files of about equal size; AQE sizes them, rows with equal keys stay near."""
    return df.hint("rebalance", *keys)


def small_file_share(spark: SparkSession, path: str, least: int = 32 << 20) -> float:
    """Share of a folder's Parquet files under ``least`` bytes: what compaction can gain."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    found = files.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("length") < least).alias("small")).first()
    return found.small / found.n if found.n else 0.0
