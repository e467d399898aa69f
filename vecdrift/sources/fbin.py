"""``fbin`` files: little-endian uint32 N, uint32 D, then N x D float32. A Python data source, read in row ranges.

Paths are opened by the executors' local file system (mount object stores, or use Parquet there).
"""

from __future__ import annotations

import os
import struct

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

ROWS_A_PARTITION = 65_536


def peek(path: str) -> tuple[int, int]:
    """(N, D) from the header, after checking the file's exact size."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(8)
    if len(head) < 8:
        raise ValueError(f"{path}: no header")
    n, d = struct.unpack("<II", head)
    if size != 8 + 4 * n * d:
        raise ValueError(f"{path}: {size} bytes, not {8 + 4 * n * d}")
    return n, d


def write_array(path: str, array: np.ndarray) -> None:
    array = np.asarray(array)
    if array.ndim != 2:
        raise ValueError("a 2-D array is needed")
    if max(array.shape) > 0xFFFFFFFF:
        raise ValueError("shape beyond uint32")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "wb") as f:
        f.write(struct.pack("<II", *array.shape))
        f.write(np.ascontiguousarray(array, dtype="<f4").tobytes())


def read_array(path: str, mmap: bool = False) -> np.ndarray:
    n, d = peek(path)
    if mmap:
        return np.memmap(path, dtype="<f4", mode="r", offset=8, shape=(n, d))
    with open(path, "rb") as f:
        f.seek(8)
        return np.frombuffer(f.read(), "<f4").reshape(n, d)


class _Rows(InputPartition):
    def __init__(self, path: str, start: int, end: int, d: int):
        self.path, self.start, self.end, self.d = path, start, end, d


class _Reader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step = path, step

    def partitions(self):
        n, d = peek(self.path)
        return [_Rows(self.path, s, min(n, s + self.step), d) for s in range(0, n, self.step)] or [_Rows(self.path, 0, 0, d)]

    def read(self, part):
        import pyarrow as pa

        with open(part.path, "rb") as f:
            f.seek(8 + 4 * part.d * part.start)
            raw = np.frombuffer(f.read(4 * part.d * (part.end - part.start)), "<f4")
        n = part.end - part.start
        offsets = pa.array(np.arange(0, n * part.d + 1, max(part.d, 1), dtype=np.int32)[: n + 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.start, part.end)), pa.ListArray.from_arrays(offsets, pa.array(raw))], names=["id", "vec"])


class _Part(WriterCommitMessage):
    def __init__(self, file: str, n: int, d: int):
        self.file, self.n, self.d = file, n, d


class _Writer(DataSourceWriter):
    """Each task writes its rows beside the target; the commit joins them, ordered by first id, under one header."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows):
        import uuid

        found = sorted((r["id"], r["vec"]) for r in rows)
        if not found:
            return _Part("", 0, 0)
        file = f"{self.path}.{found[0][0]:020d}.{uuid.uuid4().hex}"
        np.array([v for _, v in found], "<f4").tofile(file)
        return _Part(file, len(found), len(found[0][1]))

    def commit(self, messages):
        parts = sorted((m for m in messages if m and m.n), key=lambda m: m.file)
        if len({m.d for m in parts}) > 1:
            self.abort(messages)
            raise ValueError("vectors of unequal dimension")
        if not os.path.exists(self.path) or self.overwrite:
            with open(f"{self.path}.tmp", "wb") as out:
                out.write(struct.pack("<II", sum(m.n for m in parts), parts[0].d if parts else 0))
                for m in parts:
                    with open(m.file, "rb") as f:
                        while chunk := f.read(1 << 22):
                            out.write(chunk)
            os.replace(f"{self.path}.tmp", self.path)
        self.abort(parts)

    def abort(self, messages):
        for m in messages:
            if m and m.n and os.path.exists(m.file):
                os.remove(m.file)


class FbinDataSource(DataSource):
    """``spark.read.format('fbin').load(path)`` -> ``id bigint, vec array<float>``; write range-partitioned by id."""

    @classmethod
    def name(cls):
        return "fbin"

    def schema(self):
        return "id bigint, vec array<float>"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("rowsperpartition", ROWS_A_PARTITION)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def register(spark) -> None:
    spark.dataSource.register(FbinDataSource)


def write(df, path: str, mode: str = "overwrite") -> None:
    """Write ``id, vec`` in id order."""
    register(df.sparkSession)
    df.select("id", df["vec"].cast("array<float>").alias("vec")).repartitionByRange("id").write.format("fbin").mode(mode).save(path)
