"""Token ids as one ``.npy`` array of uint16 that a trainer can map: a Spark data source and sink.

Reading cuts the array into byte ranges; each task seeks to its own. Writing fills slices of
one array: the driver lays out a file of the final size under another name, tasks write
their slices in place, and the commit checks that they cover the array before it renames
the file. A task that is run again writes the same bytes to the same place; a write that
fails leaves nothing. The folder has to be one that driver and executors share and that
takes writes in place (a local disk in tests, NFS or the like on a cluster).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "start long, ids array<int>"


def _local(path: str) -> str:
    scheme, found, rest = path.partition("://")
    if found and scheme != "file":
        raise ValueError(f"{path}: an array is written in place, which {scheme} does not offer")
    return rest if found else path.removeprefix("file:")


def _layout(path: str) -> tuple[int, int]:
    """Where the ids begin, and how many there are."""
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if kind != np.dtype("<u2") or len(shape) != 1:
            raise ValueError(f"{path} holds {kind} of {len(shape)} dimensions, not a row of uint16")
        return f.tell(), shape[0]


def _rows(starts: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(starts), lists], names=["start", "ids"])


@dataclass
class Range(InputPartition):
    start: int
    stop: int


class _Reader(DataSourceReader):
    """Rows of ``rows`` ids each, or with ``window`` rows of that many and one more every ``window`` ids."""

    def __init__(self, options):
        self.path = _local(options["path"])
        self.window = int(options.get("window", 0))
        self.step = self.window or int(options.get("rows", 4096))
        self.split = max(1, int(options.get("splitIds", 4_000_000)) // self.step) * self.step

    def partitions(self):
        _, n = _layout(self.path)
        n = max(0, n - 1) // self.step * self.step if self.window else n
        return [Range(a, min(n, a + self.split)) for a in range(0, n, self.split)] or [Range(0, 0)]

    def read(self, partition):
        begin, _ = _layout(self.path)
        over, block = int(self.window > 0), max(1, 500_000 // self.step) * self.step
        with open(self.path, "rb") as f:
            for a in range(partition.start, partition.stop, block):
                b = min(partition.stop, a + block)
                f.seek(begin + 2 * a)
                ids = np.frombuffer(f.read(2 * (b - a + over)), "<u2")
                if len(ids) != b - a + over:
                    raise OSError(f"{self.path} ends before its header says")
                starts = np.arange(a, b, self.step)
                sizes = np.minimum(starts + self.step, b) - starts + over
                first = np.repeat(starts - a - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
                yield _rows(starts, ids[first + np.arange(int(sizes.sum()))], sizes)


@dataclass
class Filled(WriterCommitMessage):
    runs: list[tuple[int, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.length = _local(options["path"]), int(options["length"])
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.writing"
        os.makedirs(os.path.dirname(self.temporary) or ".", exist_ok=True)
        with open(self.temporary, "wb") as f:
            np.lib.format.write_array_header_1_0(f, {"descr": "<u2", "fortran_order": False, "shape": (self.length,)})
            self.begin = f.tell()
            f.truncate(self.begin + 2 * self.length)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Filled:
        runs: list[list[int]] = []
        with open(self.temporary, "r+b") as f:
            for batch in iterator:
                column = batch.column("ids")
                bounds = column.offsets.to_numpy()
                values = column.values.to_numpy(zero_copy_only=False)
                if len(values) and (values.min() < 0 or values.max() > 65535):
                    raise ValueError("an id does not fit two bytes")
                data = values.astype("<u2")
                for start, a, b in zip(batch.column("start").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if a == b:
                        continue
                    if start < 0 or start + b - a > self.length:
                        raise ValueError(f"ids {start} to {start + b - a} of an array of {self.length}")
                    if runs and runs[-1][1] == start:
                        runs[-1][1] += b - a
                    else:
                        runs.append([start, start + b - a])
                        f.seek(self.begin + 2 * start)
                    f.write(data[a:b].tobytes())
            f.flush()
            os.fsync(f.fileno())
        return Filled([(a, b) for a, b in runs])

    def commit(self, messages) -> None:
        at = 0
        for a, b in sorted(r for m in messages if m is not None for r in m.runs):
            if a != at:
                self.abort(messages)
                raise ValueError(f"the slices {'overlap' if a < at else 'leave a gap'} at id {min(a, at)}")
            at = b
        if at != self.length:
            self.abort(messages)
            raise ValueError(f"the slices end at id {at} of {self.length}")
        os.replace(self.temporary, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.temporary):
            os.remove(self.temporary)


class TokenArray(DataSource):
    """``spark.read.format("token_array")`` and ``df.write.format("token_array").option("length", n)``."""

    @classmethod
    def name(cls) -> str:
        return "token_array"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def write_array(stream: DataFrame, path: str, length: int) -> None:
    """The ids of ``stream(start, ids)``, in whatever order its rows are, as one array."""
    stream.sparkSession.dataSource.register(TokenArray)
    stream.select("start", F.col("ids").cast("array<int>")).write.format("token_array").option("length", length).mode("overwrite").save(path)


def read_array(spark: SparkSession, path: str, **options) -> DataFrame:
    """``start, ids`` of an array's blocks; ``rows`` ids each, or windows of ``window`` ids and the next."""
    spark.dataSource.register(TokenArray)
    return spark.read.format("token_array").options(**options).load(path)
