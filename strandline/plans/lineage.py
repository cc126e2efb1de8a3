"""Cutting lineage where executors can be lost: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, as in tests, a temporary folder of a local session. On a cluster it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandline-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


def tables(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/strandline/{spark.sparkContext.applicationId}"


#: Rows of two or three numbers, and bytes of long columns, that make one file; and so many that a further file is worth a task, up to eight.
ROWS_A_FILE, BYTES_A_FILE = 250_000, 16 << 20
ROWS_A_TASK, BYTES_A_TASK = 25_000, 1 << 20
#: Bytes of text, before compression, whose rows make one file.
TEXT_A_FILE = 64 << 20


def files(rows: int = 0, size: int = 0) -> int:
    """How many files a table fills that has at most so many rows of a few numbers, and so many bytes in long columns."""
    few = max(-(-rows // ROWS_A_TASK), -(-size // BYTES_A_TASK))
    return max(1, min(8, few), -(-rows // ROWS_A_FILE), -(-size // BYTES_A_FILE))


def filled(df: DataFrame, size: int) -> DataFrame:
    """The table in as few partitions as ``size`` bytes of text fill, but two for each core at least."""
    return df.coalesce(max(-(-size // TEXT_A_FILE), 2 * df.sparkSession.sparkContext.defaultParallelism))


def materialise(df: DataFrame, name: str, most: int | None = None, size: int = 0) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again, so a lost executor costs one read. ``clear`` deletes what was written.

    A table of at most ``most`` rows, where that is known, goes into as few files as they fill, with at most ``size`` bytes in long columns. Without Hadoop's native
    library, an executor starts processes for the permissions of every file that it writes, so many small files cost more than their rows.
    """
    path = f"{tables(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df if most is None else df.coalesce(files(most, size))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables. Results that were not read or written yet can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, name: str, most: int = 100_000) -> DataFrame:
    """``df``, written first, to be broadcast if it has at most ``most`` rows; else as it is, for a join by shuffle whose large side Spark may split."""
    held = materialise(df, name)
    return F.broadcast(held) if held.count() <= most else held
