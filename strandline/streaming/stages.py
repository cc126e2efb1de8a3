"""Stage tables as streams: new Parquet files of points are classified and inverted as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import bathymetry


def watch(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    """Points of the Parquet files that arrive in a folder, at most so many files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def classified(points: DataFrame) -> DataFrame:
    """Depth flags of a stream of points; stateless, so any trigger gives what a batch gives."""
    return bathymetry.classify(points)


def run(stream: DataFrame, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts a query that appends what ``step`` makes of the stream to a Parquet folder: of all there is now, or with ``every`` (such as "1 minute") on and on.

    ``checkpoint`` is a folder that driver and executors share; a query that starts again with it goes on where it stopped, and a lost executor repeats its trigger alone.
    """
    writer = step(stream).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
