"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow tables of this many rows at most are broadcast.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(col: str, buckets: int) -> Column:
    """crc32 of an id written as text, modulo ``buckets``; a null id gives null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % buckets


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` rows and about ``most`` bytes of text, or one row; none is empty.

    Python then holds few texts at a time, however long they are.
    """
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            end = max(at + 1, min(at + rows, fits))
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset and everything runs on one machine (tests) it lies
    in the warehouse; on a cluster it must be set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return where or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def row_ids(df: DataFrame, id_col: str) -> None:
    """Raises ValueError unless the ids are whole numbers, which the near-duplicate operators need."""
    kind = df.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} must hold whole numbers, not {kind}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has ``rows`` rows at most, else as it is; for tables that are cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
