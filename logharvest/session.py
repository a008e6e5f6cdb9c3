"""Session settings the library is designed for, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STORED: list[str] = []

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Rows handed to the parser hold whole files: small batches, small tasks.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.files.maxPartitionBytes": "64m",
    # Cut map outputs to the quota for every planned sample size.
    "spark.sql.optimizer.windowGroupLimitThreshold": "2000",
    # Survey exports come in windows-1252.
    "spark.sql.legacy.javaCharsets": "true",
}


def recommended(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def apply_recommended(spark: SparkSession) -> SparkSession:
    """The same for a session that is already running."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or
    what ``SparkContext.setCheckpointDir`` was given.

    Only a local master may do without; then a temporary folder is set as the
    checkpoint directory, once per session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="logharvest-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared folder of the session."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    For results that several later branches use: they read a table instead of
    repeating the work, and a lost executor costs one task of one branch.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    _STORED.append(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever file system it is."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> int:
    """Delete what ``stored`` has written so far in this process; returns how many.

    For the end of a job, when nothing lazily reads those tables any more.
    """
    gone = 0
    while _STORED:
        remove(spark, _STORED.pop())
        gone += 1
    return gone
