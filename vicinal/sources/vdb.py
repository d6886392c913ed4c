"""The compact binary collection format, and a Spark data source for it.

Little-endian: magic, u32 version, u32 flags; u32 length and the configuration as JSON; u32 count; per item u16 length and id,
u32 length and document, u32 length and metadata as JSON, f64 created_at, and the vector as f32 - so vectors lose precision.
An empty document reads as null.
"""

from __future__ import annotations

import io
import itertools
import json
import struct
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import BinaryIO

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage

from vicinal.sources.files import MAGIC, atomic_write

VERSION = 1
#: Bytes of a file that one task reads, about.
SPLIT_BYTES = 64 << 20


def header(config: dict, count: int) -> bytes:
    body = json.dumps(config).encode()
    return MAGIC + struct.pack("<II", VERSION, 0) + struct.pack("<I", len(body)) + body + struct.pack("<I", count)


def pack_item(id_: str, vector, metadata: str | None, document: str | None, created_at: float | None) -> bytes:
    i, d, m = id_.encode(), (document or "").encode(), (metadata or "{}").encode()
    if len(i) > 0xFFFF:
        raise ValueError("an id of more than 65535 bytes does not fit the format")
    return struct.pack("<H", len(i)) + i + struct.pack("<I", len(d)) + d + struct.pack("<I", len(m)) + m + struct.pack("<d", created_at or 0.0) + np.asarray(vector, "<f4").tobytes()


def _opened(stream: BinaryIO) -> tuple[dict, int]:
    """(config, count); the stream stands at the first item."""
    if stream.read(4) != MAGIC:
        raise ValueError("not a binary collection")
    version, _flags = struct.unpack("<II", stream.read(8))
    if version != VERSION:
        raise ValueError(f"unknown version {version}")
    config = json.loads(stream.read(struct.unpack("<I", stream.read(4))[0]))
    return config, struct.unpack("<I", stream.read(4))[0]


def _items(stream: BinaryIO, width: int, count: int) -> Iterator[tuple]:
    for _ in range(count):
        id_ = stream.read(struct.unpack("<H", stream.read(2))[0]).decode()
        doc = stream.read(struct.unpack("<I", stream.read(4))[0]).decode()
        meta = stream.read(struct.unpack("<I", stream.read(4))[0]).decode()
        created = struct.unpack("<d", stream.read(8))[0]
        vector = np.frombuffer(stream.read(4 * width), "<f4").astype(float).tolist()
        yield id_, vector, meta, doc or None, created


def unpack(stream: BinaryIO) -> tuple[dict, int, Iterator[tuple]]:
    """(config, count, items as (id, vector, metadata, document, created_at))."""
    config, count = _opened(stream)
    return config, count, _items(stream, int(config["dimension"]), count)


def splits(path: str, size: int) -> list[tuple[int, int, int]]:
    """(offset, number of the first item, items) of runs of about ``size`` bytes; only the items' lengths are read."""
    found = []
    with open(path, "rb") as f:
        config, count = _opened(f)
        width, begin, first = 4 * int(config["dimension"]), f.tell(), 0
        for n in range(1, count + 1):
            f.seek(struct.unpack("<H", f.read(2))[0], io.SEEK_CUR)
            for _ in range(2):  # document, metadata
                f.seek(struct.unpack("<I", f.read(4))[0], io.SEEK_CUR)
            f.seek(8 + width, io.SEEK_CUR)
            if f.tell() - begin >= size or n == count:
                found.append((begin, first, n - first))
                begin, first = f.tell(), n
    return found


def write_file(path: str, config: dict, rows: Iterable[tuple]) -> int:
    """One file of item rows, written as they come; returns their number."""
    n = 0

    def blocks() -> Iterator[bytes]:
        nonlocal n
        yield header(config, 0)
        for n, row in enumerate(rows, 1):
            yield pack_item(*row)

    def number(f: BinaryIO) -> None:
        f.seek(len(header(config, 0)) - 4)
        f.write(struct.pack("<I", n))

    atomic_write(path, blocks(), number)
    return n


SCHEMA = "id string, vector array<double>, metadata string, document string, created_at double, ord bigint"


class _Message(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        from pyspark.sql.datasource import InputPartition

        path = Path(self.path)
        files = sorted(path.glob("*.vdb")) if path.is_dir() else [path]
        return [InputPartition((str(f), *run)) for f in files for run in splits(str(f), SPLIT_BYTES)]

    def read(self, partition):
        path, offset, first, count = partition.value
        with open(path, "rb") as f:
            width = int(_opened(f)[0]["dimension"])
            f.seek(offset)
            for n, row in enumerate(_items(f, width, count), first):
                yield (*row, n)


class _Writer(DataSourceWriter):
    """Each task writes one file into the target folder, which all executors share."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.config, self.overwrite = options["path"], json.loads(options.get("config", "{}")), overwrite
        if overwrite and Path(self.path).is_dir():
            for old in Path(self.path).glob("*.vdb"):
                old.unlink()

    def write(self, iterator):
        import uuid

        rows = ((str(r["id"]), r["vector"], r["metadata"], r["document"], r["created_at"]) for r in iterator)
        name = f"part-{uuid.uuid4().hex}.vdb"
        first = next(rows, None)
        if first is not None:
            write_file(f"{self.path}/{name}", {"dimension": len(first[1])} | self.config, itertools.chain([first], rows))
        return _Message(name)

    def abort(self, messages):
        for m in messages:
            if m is not None:
                Path(self.path, m.name).unlink(missing_ok=True)


class VdbSource(DataSource):
    """``spark.read.format("vdb").load(path)`` and ``df.write.format("vdb").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "vdb"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VdbSource)
