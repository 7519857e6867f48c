"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_FILE = 20_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is set a temporary folder
    serves, but only if the executors are threads of this process: others could not read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/siteflux-{uuid.uuid4().hex}"


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows without their lineage, written to the shared folder. rows: a bound of their
    number, by which few rows go to few files."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    return df.checkpoint(eager=True)


def frugal(df: DataFrame) -> DataFrame:
    """df, in a session that sends Arrow batches of 4 MB rather than 64: a batch is held in the JVM, in the
    worker and again in what the worker makes of it. A size that the session has set itself stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES).strip("b") in (str(1 << 26), "64m"):
        conf.set(BATCH_BYTES, str(1 << 22))
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
