"""Tables written once to the session's shared folder, to end lineage between iterations."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new name under spark.checkpoint.dir. Where that is unset, a temporary folder stands in
    for it in a local session; on a cluster that is an error, as nodes share no such folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="provena-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch between Spark and a worker, where the session has Spark's default:
#: a batch is held several times over, by both sides.
BATCH_BYTES, _BATCHES, _DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB")


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by bytes."""
    conf = df.sparkSession.conf
    if conf.get(_BATCHES, None) in _DEFAULT:
        conf.set(_BATCHES, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return the memory that freed arrays left in this process to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library, which has no such call
