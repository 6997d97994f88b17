"""Shared plumbing of the corpus operators: table access, shared files, batches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds unpacked at once.
CHUNK_BYTES = 1 << 18
#: Bytes of an Arrow batch between Spark and a worker, where the session has Spark's default.
BATCH_BYTES, _BATCHES, _DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(df: DataFrame) -> SparkSession:
    """The session of df. Batches are bounded by bytes there: a batch of Spark's default size is
    held several times over, by both sides."""
    spark = df.sparkSession
    if spark.conf.get(_BATCHES, None) in _DEFAULT:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the session's checkpoint folder, which all nodes share.

    A local session without spark.checkpoint.dir gets a temporary one; on a cluster, where no
    such folder is shared, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        base = tempfile.mkdtemp(prefix="provena-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read back: lineage ends there and lost
    executors cost no recomputation."""
    path = shared_dir(session(df), label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    release(spark)
    return out


#: Seconds between collections on the driver, and when the last one was.
RELEASE_S = 0.25
_released = [0.0]


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps soon: Spark's cleaner removes them once the
    driver has collected its garbage, by default every half hour. Steps that are over in no
    time leave little, and do not collect each."""
    if time.monotonic() - _released[0] > RELEASE_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released[0] = time.monotonic()


def local_path(path: str) -> str | None:
    """The plain path of a file: URI, or None when another file system holds it."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def write_bytes(path: str, chunks: list[bytes | memoryview]) -> None:
    """Write a whole file under a name that appears only when complete, so that a task
    that is run again leaves the same file."""
    local = local_path(path)
    if local is None:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        system.create_dir(os.path.dirname(inner), recursive=True)
        with system.open_output_stream(inner) as out:
            for c in chunks:
                out.write(c)
        return
    os.makedirs(os.path.dirname(local), exist_ok=True)
    with open(partial := f"{local}.{uuid.uuid4().hex}", "wb") as out:
        for c in chunks:
            out.write(c)
    os.replace(partial, local)


def map_bytes(path: str) -> np.ndarray:
    """The bytes of a file, memory-mapped where it is local, else fetched once."""
    local = local_path(path)
    if local is not None:
        return np.memmap(local, np.uint8, "r") if os.path.getsize(local) else np.empty(0, np.uint8)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        return np.frombuffer(f.read(), np.uint8)


def fold(column: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; -1 for a null id."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5, F.lit(-1))


def trim() -> None:
    """Give the memory that freed arrays left in this process back to the machine: idle workers
    stay small, whatever they did before."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library, which has no such call


def chunks(batches: Iterator[pa.RecordBatch], text: str | int = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about `size` bytes of text each. text: the column's
    name, or its place where other columns may have any name."""
    for batch in batches:
        col = batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text))
        lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64)
        group = np.cumsum(lengths + 64) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
    trim()


def runs(mask_start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expand starts and counts into every index: start, start+1, ..., for each."""
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(mask_start, n)


def seg_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i; 0 for an empty one."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
