"""The calibration histogram over arriving scene files: an extension, as the batch operators need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridmetric.operators.calibration import fine_histogram


def stream_scores(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def accumulate(scores: DataFrame, keys, name: str, checkpoint: str, bins: int = 1000):
    """Runs over all files there are and stops; the running histogram is the in-memory table `name`."""
    query = fine_histogram(scores, keys, bins).writeStream.outputMode("complete").format("memory").queryName(name)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
