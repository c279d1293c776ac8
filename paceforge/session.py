"""Session defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on, and those that large inputs need.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "paceforge", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | extra)
    return (builder.master(master) if master else builder).getOrCreate()


def stored(df: DataFrame) -> DataFrame:
    """The rows written once, to the checkpoint folder, so that what follows is planned and computed from them.

    The folder is the one that ``spark.checkpoint.dir`` names.  Where it is unset, a local session
    uses its warehouse; on a cluster that raises, as driver and executors need not share one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = df.sparkSession.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        context.setCheckpointDir(folder)
    return df.checkpoint()
