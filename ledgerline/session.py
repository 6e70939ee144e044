"""Spark session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC dates, adaptive execution (runtime
# broadcast conversion, partition coalescing, skew-join splitting).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "ledgerline",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system). Only when nothing is configured -- local runs and tests --
    do we fall back to a folder of our own. Written tables go directly under
    this folder (``checkpoint()`` data goes to Spark's per-application
    subfolder of it), so a table written once is found again by later jobs.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = os.path.join(tempfile.gettempdir(), "ledgerline-checkpoints")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, in the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/ledgerline-run-{spark.sparkContext.applicationId}"


#: Tables that the library keeps for itself are small on disk; long ones of keys and quantities more so.
#: Tables that a plan may broadcast aren't delta-encoded: their size in files says what they hold.
PACKED = {"compression": "zstd"}
DELTA = {**PACKED, "parquet.writer.version": "PARQUET_2_0"}
_MARK = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession):
    """Queries that run in here delete their shuffle files when they end, not when the driver's
    garbage is collected: for queries whose result is written, so nothing reads those files again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def write_packed(df: DataFrame, path: str, mode: str = "error", delta: bool = False, last: bool = True) -> None:
    """Writes a table that the library keeps for itself; its shuffles leave the disk with the write.
    The ``last`` part of a table marks it as complete."""
    with shuffles_released(df.sparkSession):
        (df.write.mode(mode).options(**(DELTA if delta else PACKED)).option(_MARK, str(last).lower()).parquet(path))


def write_parts(parts: list[DataFrame], path: str) -> None:
    """Writes (or replaces) a long table part by part: the disk holds the shuffles of one part at a time."""
    for i, part in enumerate(parts):
        write_packed(part, path, "append" if i else "overwrite", delta=True, last=i + 1 == len(parts))


def written(df: DataFrame | list[DataFrame], name: str, delta: bool = False) -> DataFrame:
    """Writes ``df`` (or parts of a long table) as Parquet to the run's folder and reads it back: for a
    result that several parts of a plan read, or that a lost executor shouldn't compute again."""
    first = df[0] if isinstance(df, list) else df
    path = f"{run_folder(first.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if isinstance(df, list):
        write_parts(df, path)
    else:
        write_packed(df, path, delta=delta)
    return first.sparkSession.read.schema(first.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes :func:`written` tables that nothing will read again."""
    for df in tables:
        folder = os.path.dirname(df.inputFiles()[0])
        if f"/{os.path.basename(run_folder(df.sparkSession))}/" not in folder:
            raise ValueError(f"{folder} isn't a table of this run")
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean_run(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables; call it when its results have been written."""
    _delete(spark, run_folder(spark))
