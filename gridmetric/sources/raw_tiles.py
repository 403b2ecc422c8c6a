"""Python data source "rawtile": flat binary files of equal records, each three float32 planes (two bands and a mask) or one.

A path is a file, or a folder of files with a sub-folder a split. Files are read by record ranges and written by tasks under temporary names, which
the driver's commit renames once every task has ended. They are opened through pyarrow's file systems, so that a path may be a URI of any store that
these know; shared.qualified gives a path its scheme.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.taskcontext import TaskContext

from gridmetric.schemas import CHIP

#: Columns of records with one plane.
BAND = "chip_id LONG, split STRING, band ARRAY<FLOAT>"


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path there. A path without a scheme is this machine's; shared.qualified tells where Spark would look."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


class Records:
    """Shape and type of a file's records, from a source's options."""

    def __init__(self, options: dict):
        get = lambda k, v: type(v)(options.get(k, v))
        self.path = options["path"]
        self.shape = (get("planes", 3), get("height", 224), get("width", 224))
        self.dtype = np.dtype(options.get("dtype", "float32")).newbyteorder("<")
        self.per = get("recordsPerPartition", 1024)
        if self.shape[0] not in (1, 3):
            raise ValueError("a record has three planes, two bands and a mask, or one")

    @property
    def record_bytes(self) -> int:
        return int(np.prod(self.shape)) * self.dtype.itemsize

    @property
    def columns(self) -> list[str]:
        return ["vv", "vh", "mask"] if self.shape[0] == 3 else ["band"]


class RecordRange(InputPartition):
    def __init__(self, path: str, split: str, start: int, stop: int, before: int):
        super().__init__(None)
        self.path, self.split, self.start, self.stop, self.before = path, split, start, stop, before


class RawTileReader(DataSourceReader):
    """chip_id counts a split's records, over its files in order of their names. splits (a JSON list of names): only these; one that has no file has no
    records."""

    def __init__(self, options: dict):
        self.records = Records(options)
        self.splits = json.loads(options["splits"]) if options.get("splits") else None

    def _files(self) -> list[tuple[str, str, int]]:
        """Path in the store, split and size of each file, from one listing."""
        store, at = _located(self.records.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.records.path)
        if info.type == fs.FileType.File:
            return [(at, "", info.size)]
        out = []
        for found in store.get_file_info(fs.FileSelector(at, recursive=True)):
            inner = found.path.removeprefix(at.rstrip("/")).strip("/").split("/")
            split = "/".join(inner[:-1])
            if found.type == fs.FileType.File and inner[-1].endswith(".bin") and not any(x.startswith("_") for x in inner) and (self.splits is None or split in self.splits):
                out.append((found.path, split, found.size))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def partitions(self):
        """Ranges of records. A file that isn't whole records, or has none, is an error."""
        out, before, of = [], 0, None
        for path, split, size in self._files():
            before = before if split == of else 0
            of = split
            n, rest = divmod(size, self.records.record_bytes)
            if rest or n == 0:
                raise ValueError(f"{path}: {size} bytes are not a positive number of records of {self.records.record_bytes}")
            out += [RecordRange(path, split, a, min(n, a + self.records.per), before) for a in range(0, n, self.records.per)]
            before += n
        return out or [RecordRange("", "", 0, 0, 0)]

    def read(self, part: RecordRange):
        if part.start == part.stop:
            return
        planes, h, w = self.records.shape
        size = self.records.record_bytes
        store, _ = _located(self.records.path)
        with store.open_input_file(part.path) as f:
            for a in range(part.start, part.stop, 64):
                n = min(64, part.stop - a)
                block = np.frombuffer(f.read_at(n * size, a * size), self.records.dtype).reshape(n, planes, h * w)
                plane = lambda k, t, block=block, n=n: pa.ListArray.from_arrays(np.arange(0, (n + 1) * h * w, h * w, dtype=np.int32), pa.array(block[:, k].ravel().astype(t)))
                bands = [plane(0, np.float32), plane(1, np.float32), plane(2, np.int16)] if planes == 3 else [plane(0, np.float32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n) + part.before), pa.array([part.split] * n), *bands], names=["chip_id", "split", *self.records.columns])


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written: number of the task, and of each file its temporary path and split."""

    task: int
    files: list


class RawTileWriter(DataSourceArrowWriter):
    """Writes rows as records, in the order of partitions and their rows: a file a task and run of rows of one split.

    A task writes under names of its own attempt, so that repeated and concurrent attempts never share a file; commit renames the files of those that
    count, and what other attempts have left goes with the job's temporary folder. An attempt that is killed after its job was aborted can leave files
    there, which no reader takes.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.records, self.overwrite, self.job = Records(options), overwrite, uuid.uuid4().hex

    def _block(self, batch: pa.RecordBatch) -> np.ndarray:
        planes, h, w = self.records.shape
        out = np.empty((batch.num_rows, planes, h * w), self.records.dtype)
        for k, name in enumerate(self.records.columns):
            column = batch.column(name)
            if column.null_count or not pc.all(pc.equal(pc.list_value_length(column), h * w)).as_py():
                raise ValueError(f"{name}: each row needs {h} x {w} values")
            out[:, k] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, h * w)
        return out

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _located(self.records.path)
        own = f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}"
        files, stream, now = [], None, None
        try:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                block = self._block(batch)
                split = batch.column("split").to_pylist() if "split" in batch.schema.names else [""] * batch.num_rows
                begins = [0, *[i for i in range(1, len(split)) if split[i] != split[i - 1]], len(split)]
                for a, b in zip(begins, begins[1:]):
                    if stream is None or split[a] != now:
                        if stream is not None:
                            stream.close()
                        now = split[a]
                        store.create_dir(own, recursive=True)
                        files.append((f"{own}/{len(files)}", now or ""))
                        stream = store.open_output_stream(files[-1][0])
                    stream.write(np.ascontiguousarray(block[a:b]).tobytes())
        except BaseException:
            if stream is not None:
                stream.close()
                store.delete_dir(own)
            raise
        if stream is not None:
            stream.close()
        return Written(TaskContext.get().partitionId(), files)

    def commit(self, messages: list) -> None:
        store, root = _located(self.records.path)
        store.create_dir(root, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".bin") and "/_temporary/" not in f.path]
        turns = [int(path.rsplit("/", 1)[1].split("-")[0]) for path in old if path.rsplit("/", 1)[1].split("-")[0].isdigit()]
        turn = 0 if self.overwrite else max(turns, default=-1) + 1  # what is appended comes after what is there
        if self.overwrite:
            for path in old:
                store.delete_file(path)
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            for nth, (path, split) in enumerate(message.files):
                folder = f"{root}/{split}".rstrip("/")
                store.create_dir(folder, recursive=True)
                store.move(path, f"{folder}/{turn:04}-{message.task:06}-{nth:04}.bin")
        self._clear(store, root)

    def abort(self, messages: list) -> None:
        self._clear(*_located(self.records.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        top = f"{root}/_temporary"
        if store.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/{self.job}")
        if store.get_file_info(top).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(top)):
            store.delete_dir(top)


class RawTileSource(DataSource):
    """spark.dataSource.register(RawTileSource); spark.read.format("rawtile").option("height", 224)....load(path), and df.write likewise."""

    @classmethod
    def name(cls) -> str:
        return "rawtile"

    def schema(self) -> str:
        return BAND if int(self.options.get("planes", 3)) == 1 else CHIP

    def reader(self, schema) -> RawTileReader:
        return RawTileReader(self.options)

    def writer(self, schema, overwrite: bool) -> RawTileWriter:
        return RawTileWriter(self.options, overwrite)


def raster_options(sidecar: dict) -> dict:
    """Reader options of a raw raster from its JSON metadata; a byte size that doesn't fit is found when it is read."""
    height, width = sidecar["shape"][-2:]
    return {"height": str(height), "width": str(width), "dtype": sidecar.get("precision", "float32")}
