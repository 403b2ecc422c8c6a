"""A session with the settings the engine expects."""

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int | None = None, name: str = "gridmetric") -> SparkSession:
    """AQE with skew handling and UTC; partitions of shuffles are coalesced at run time, so the number is an upper bound."""
    builder = SparkSession.builder.master(master).appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
