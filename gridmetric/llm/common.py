"""Small helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1 << 20
#: While a table is written: what was shuffled for it is of no use afterwards, and descriptions of plans with a long literal aren't kept whole.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "20000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """The same columns named c0, c1, ..., as functions over Arrow batches need plain names; toDF gives them theirs back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where that is unset, a local session gets a folder of its
    own; any other is an error, as machines would write where the others don't read."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    chosen = spark.conf.get("gridmetric.shared.dir", None)
    if not chosen:
        chosen = tempfile.mkdtemp(prefix="gridmetric-")
        spark.conf.set("gridmetric.shared.dir", chosen)
    return chosen


class Scratch:
    """Written tables in the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        before = {k: self.spark.conf.get(k, None) for k in WRITING}
        for k, v in WRITING.items():
            self.spark.conf.set(k, v)
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that keep() wrote and nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of text in a table (null: none)."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).cast("long")).first()[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns unused memory to the system: Spark's Python workers live on for other stages, whose executors have other needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the C library, where it is glibc
        ctypes.CDLL(None).malloc_trim(0)


_model: dict = {}


def held_model(key, make: Callable[[], object]):
    """The model of that key, which a worker keeps for later tasks until another one is asked for: workers outlive stages, and so would all their models."""
    if key not in _model:
        _model.clear()
        gc.collect()
        give_back()
        _model[key] = make()
    return _model[key]


def pieces(batches: Iterator[pa.RecordBatch], text_col: str, max_bytes: int = 8 * MB) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches at rows so that each holds about max_bytes of text, one row at least. At the end the task gives back what it no longer uses."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    give_back()


def texts(batch: pa.RecordBatch, text_col: str) -> list[str]:
    """The batch's texts; null is the empty text."""
    return pc.fill_null(batch.column(text_col), "").to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gather_ragged(starts: np.ndarray, lengths: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Flat positions of the runs named by picks, one after the other."""
    n = lengths[picks]
    total = int(n.sum())
    first = np.cumsum(n) - n
    return np.repeat(starts[picks] - first, n) + np.arange(total, dtype=np.int64)


def dictionary(items: list, kind: pa.DataType) -> tuple[np.ndarray, list]:
    """Codes of the items, and the distinct items in order of code."""
    coded = pa.array(items, type=kind).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
