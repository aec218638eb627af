"""Written tables and small Arrow helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from panelgrid.sources.sinks import shared_folder


#: the written table takes the place of the job's shuffle files: they go at once, not when the driver collects garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once as zstd Parquet to the shared folder (or ``path``) and read it back.

    ``group_bytes``, for rows of megabytes: row groups end where they have as many. A reader holds the rows of a group at once.
    Cuts the lineage: a lost executor costs a re-read, and a retried task rewrites only its own file.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        groups = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1} if group_bytes else {}
        df.write.options(compression="zstd", **groups).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | T.StructType
) -> DataFrame:
    """``mapInArrow`` for a function that yields dicts of columns; types come from ``schema``."""
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
                    for f in arrow
                ],
                schema=arrow,
            )

    return df.mapInArrow(run, schema=target)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def binary_slices(data: bytes | memoryview, offsets) -> pa.Array:
    """A binary column whose rows are ``data[offsets[i]:offsets[i + 1]]``, without copying each."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(data)]
    ).cast(pa.binary())


def crc32(col) -> "F.Column":
    """Unsigned CRC-32 of a string or binary column; a null counts as empty."""
    return F.crc32(F.coalesce(col.cast("binary"), F.lit("").cast("binary")))


def given_back() -> None:
    """Memory of finished work goes back to the machine: a worker lives on, next to those of the following stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of its underscored forms that no column of ``df`` has (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block."""
    head = np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.char), len(a))]], dtype=np.int64)
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(block)
    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    head = np.frombuffer(raw, dtype=np.int64, count=2 * n, offset=8)
    out, at = [], 8 * (2 * n + 1)
    for kind, size in zip(head[::2].tolist(), head[1::2].tolist()):
        out.append(np.frombuffer(raw, dtype=np.dtype(chr(kind)), count=size, offset=at))
        at += out[-1].nbytes
    return out
