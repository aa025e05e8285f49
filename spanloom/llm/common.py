"""Shared plumbing of the training-data operators: readers, batching, checkpoints."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanloom import ship

#: Bytes of an Arrow batch, but for a single row that is longer.
BATCH_BYTES = 8 << 20
_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by rows and bytes, so that long texts don't fill a worker; workers get the package.

    The two settings stay lowered for the session: a plan reads them when it runs.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch("([0-9]+)b?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines see.

    Only where the setting is empty and all runs in one process on one machine, as in
    tests, a folder of our own is used; on a cluster an empty setting is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spanloom-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return _OWN[0]


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def crc_of(ids: Iterable[int]) -> np.ndarray:
    """crc32 of each id written as text; a null id counts as empty text."""
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) for i in ids), np.int64)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Whole texts as UTF-8 bytes; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [b"" if x is None else x for x in col.to_pylist()]


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, or ``name`` with a number, whichever no column has yet."""
    taken, out, k = {c.lower() for c in columns}, name, 0
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def shared_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    The files stay while the session lives, so that a lost executor's work can be read
    again, and are removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spanloom-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        try:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the session has ended
            pass

    atexit.register(drop)
    return spark.read.schema(df.schema).parquet(path)
