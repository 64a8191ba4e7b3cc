"""Continuous intake, content dedupe and running counts."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import scratch_path
from ..functions import text as T
from ..options import RouteOptions
from ..sources.route import route, with_source_ids

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def file_feed(spark: SparkSession, path: str, routes: RouteOptions = RouteOptions(), max_files: int = 10000) -> DataFrame:
    """New files of a folder as typed sources, each once."""
    raw = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files).load(path)
    )
    return route(with_source_ids(raw.withColumnRenamed("path", "file_path")), routes)


def _timed(feed: DataFrame, time: str) -> DataFrame:
    """Watermarks need an instant; plain date-times are read in session time."""
    return feed.withColumn(time, F.col(time).cast("timestamp"))


def dedupe_feed(feed: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """One row per content key within the delay; state is dropped behind the
    watermark, so it stays bounded."""
    return _timed(feed, time).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts_feed(feed: DataFrame, kind: str, time: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts per type and time window; rows behind the watermark are dropped."""
    return _timed(feed, time).withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), T.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w")["start"].alias("window_start"), "kind", "n"
    )


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into files of the shared folder and
    give the result back as a table; for tests and catch-up jobs."""
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    q = (
        stream.writeStream.format("parquet").option("path", f"{root}/data").option("checkpointLocation", f"{root}/log")
        .outputMode(mode).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")
