"""Folders that the driver and all executors share, and files in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in spark.checkpoint.dir. A local session without that setting gets a temporary folder; any other is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="gridmetric-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and place of its file system, by Spark's defaults, for readers that don't know these."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


class Tables:
    """Tables written to a folder of their own in the shared one, which cut lineage and survive lost executors. What a result still reads stays there."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, scratch_folder(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that keep() wrote and nothing will read again."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _glob(spark: SparkSession, pattern: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(conf)
    return fs, list(fs.globStatus(path) or [])


def newest_folder(spark: SparkSession, root: str) -> str | None:
    """Name of the folder in root that changed last (ties: the last by name); null without one."""
    _, found = _glob(spark, f"{root}/*")
    folders = [(s.getModificationTime(), s.getPath().getName()) for s in found if s.isDirectory()]
    return max(folders)[1] if folders else None


def clean_up(spark: SparkSession, patterns: list[str], dry_run: bool = False) -> DataFrame:
    """pattern, path, existed, deleted, bytes: what the patterns name, deleted unless it is a dry run. A pattern without a match is a row too.

    The patterns are a manifest's outputs, a short list; their trees are deleted by the file system, not read.
    """
    rows = []
    for pattern in patterns:
        fs, found = _glob(spark, pattern)
        for status in found:
            size = fs.getContentSummary(status.getPath()).getLength()
            rows.append((pattern, status.getPath().toString(), True, not dry_run and bool(fs.delete(status.getPath(), True)), size))
        if not found:
            rows.append((pattern, None, False, False, 0))
    return spark.createDataFrame(rows, "pattern string, path string, existed boolean, deleted boolean, bytes long")


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Gives a file or folder another name, in place of what had it."""
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(new, True)
    if not fs.rename(old, new):
        raise OSError(f"{path} can't be renamed to {to}")


def freed_bytes(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.sum(F.when(F.col("deleted"), F.col("bytes"))), F.lit(0)).alias("freed"))


def write_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Writes the partitions (one to three text or whole-number keys) that the folder at path doesn't have yet."""
    spark = df.sparkSession
    _, found = _glob(spark, path + "/" + "/".join(f"{k}=*" for k in keys))
    have = [[part.partition("=")[2] for part in s.getPath().toString().rsplit("/", len(keys))[1:]] for s in found]
    if have:
        names = [f"_{k}" for k in keys]
        there = spark.createDataFrame(have, ", ".join(f"{n} string" for n in names))
        same = [F.col(k).cast("string") == F.col(n) for k, n in zip(keys, names)]
        df = df.join(F.broadcast(there), same, "left_anti")  # one row a partition of the folder, as the driver's listing has them
    df.write.mode("append").partitionBy(*keys).parquet(path)


def load_config(path: str) -> dict:
    """A configuration file of the driver as plain values: JSON, or YAML where its library is installed."""
    with open(path) as f:
        text = f.read()
    if path.endswith(".json"):
        import json

        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs PyYAML; use JSON instead") from e
    return yaml.safe_load(text)
