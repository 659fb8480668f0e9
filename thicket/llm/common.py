"""What the operators of this subpackage share: bounded Arrow batches, the shared folder, and binary packing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

try:
    LIBC = ctypes.CDLL(None)
    LIBC.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):  # another C library
    LIBC = None
ROOT = str(Path(__file__).resolve().parents[2])
#: Rows and bytes of one Arrow batch; a worker holds one batch at a time.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and let Python workers find this library."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), ROOT) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local folder serves a local session; a cluster has no such folder, so that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


class Tables:
    """Intermediate tables in the shared folder. Lineage ends at each: a lost executor costs no recomputation of what came before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.held = spark, shared_dir(spark), {}

    def cut(self, df: DataFrame) -> DataFrame:
        """Write df and read it back."""
        path = f"{self.top}/{len(self.held)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[path] = out
        return out

    def free(self, *keep: DataFrame) -> None:
        """Delete the tables but those to keep, which what is still to be run reads."""
        for path, df in list(self.held.items()):
            if not any(df is k for k in keep):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
                self.held[path] = None


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores as tell it from all columns."""
    lower = [c.lower() for c in columns]
    while name.lower() in lower:
        name += "_"
    return name


def trim() -> None:
    """Give back to the system what a worker has freed; idle workers would hold it beside the ones at work."""
    pa.default_memory_pool().release_unused()
    if LIBC is not None:
        LIBC.malloc_trim(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    col = batch.column(column)
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def lines(it: Iterator[pa.RecordBatch], fn, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """fn turns a batch into columns of schema."""
    for batch in it:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(fn(batch), schema.types, strict=True)], schema=schema)
