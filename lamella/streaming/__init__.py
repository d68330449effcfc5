"""Deep images as streams: per-sample operators are stateless, so a stream of samples goes through them as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from ..sources.image import Box, DeepImage


def read_stream(spark: SparkSession, path: str, schema: T.StructType, bbox: Box, format: tuple[int, int], configure: Callable[[DataStreamReader], DataStreamReader] = lambda r: r) -> DeepImage:
    """Samples from a folder of Parquet files, as they arrive."""
    return DeepImage(configure(spark.readStream.schema(schema)).parquet(path), bbox, format)


def write_stream(image: DeepImage, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append samples to a Parquet folder; ``once`` ends when what is there has been written. Exactly once, by the checkpoint."""
    out = image.df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def per_batch(image: DeepImage, fn: Callable[[DeepImage, int], None], checkpoint: str) -> StreamingQuery:
    """Run an operator that needs whole pixels on each micro-batch, for sources that deliver pixels whole."""
    return image.df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: fn(image.with_df(df), n)).start()
