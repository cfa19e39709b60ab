"""Arrays that grow along their first axis as streams: appended elements, and windows over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_growth(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Elements of a growing array as they are appended to a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there to an array's folder, once and exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def extent(stream: DataFrame) -> DataFrame:
    """``n``: the extent of the growing axis so far."""
    return stream.agg((F.max("d0") + 1).alias("n"))


def windowed(stream: DataFrame, time: str, value: str, late: str, size: str, slide: str | None = None, by: str | None = None) -> DataFrame:
    """``start, [by,] n, total`` for each time window; elements later than ``late`` are dropped by the watermark, which bounds the state."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    keys = [w.alias("w")] + ([F.col(by)] if by else [])
    out = stream.withWatermark(time, late).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *([by] if by else []), "n", "total")
