"""Session defaults, and cutting a plan where several jobs would repeat it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "spendframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and the time zone pinned to UTC.

    ``master`` and the shuffle width are left alone unless given, so the same code runs under
    ``spark-submit`` with whatever the cluster configures.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # a call-site capture per expression costs more than building the plan
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if master and master.startswith("local"):
        defaults.update(
            {
                "spark.ui.enabled": "false",
                "spark.ui.showConsoleProgress": "false",
                "spark.sql.shuffle.partitions": "8",
                "spark.driver.memory": os.environ.get("SPENDFRAME_DRIVER_MEMORY", "8g"),
            }
        )
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, or the one set on the context."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Compute a table once for several later jobs, and cut its lineage.

    Meant for a cost series, which is small next to the usage lines behind it.  The copy goes to
    ``folder``, or else to the one the session names in ``spark.checkpoint.dir``; all executors must
    share it, so that the copy outlives a lost one.  Without either this raises: a folder of one
    machine would not do.  ``spark.cleaner.referenceTracking.cleanCheckpoints`` releases copies.
    """
    folder = folder or shared_folder(df.sparkSession)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir, or give a folder that all executors share")
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()
