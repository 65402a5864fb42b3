"""Session settings, lineage cuts and size checks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# A side is broadcast only after counting at most this many rows of it.
BROADCAST_ROWS = 100_000


def build_session(app: str = "paperlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; a cluster's own settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # a checkpoint is removed once no frame refers to it
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    Taken from ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder: on a cluster, executors could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = os.path.join(tempfile.gettempdir(), f"paperlake-{spark.sparkContext.applicationId}")
    os.makedirs(folder, exist_ok=True)
    return folder


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark writes to, with all in it."""
    files, at = _file_system(spark, path)
    files.delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage, so a lost executor replays nothing before it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` holds at most ``rows`` rows; reads no more than ``rows + 1`` of them."""
    return df.limit(rows + 1).count() <= rows
