"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the master is local, as in tests,
    a temporary folder of this machine is used; a cluster without the setting is an error.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='loomquery-')}"
        spark.sparkContext.setCheckpointDir(where)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/loomquery/{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(remove_written)
    _WRITTEN.append(path)
    return path


def remove_written() -> None:
    """Deletes the intermediate tables of this process; runs at exit."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    while _WRITTEN:
        p = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 32 << 20
SALTS = 64


def _small(df: DataFrame, row_bytes: Column) -> bool:
    return (df.agg(F.sum(row_bytes.cast("bigint"))).first()[0] or 0) <= BROADCAST_BYTES


def broadcast_checked(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df``, a written table, marked for broadcast if its rows sum up to BROADCAST_BYTES at most by the size given for each."""
    return F.broadcast(df) if _small(df, row_bytes) else df


def salted_join(rows: DataFrame, side: DataFrame, key: str, side_key: str, spread: Column, row_bytes: Column) -> DataFrame:
    """Inner join with a written table of unique keys: by broadcast if that is small, else by (key, salt), so that hot keys are dealt out."""
    if _small(side, row_bytes):
        return rows.join(F.broadcast(side), F.col(key) == F.col(side_key)).drop(side_key)
    salted = side.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt2"))
    rows = rows.withColumn("salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    return rows.join(salted, (F.col(key) == F.col(side_key)) & (F.col("salt") == F.col("salt2"))).drop("salt", "salt2", side_key)


def pieces(batch: pa.RecordBatch, column: int, max_bytes: int = 4 << 20):
    """Slices of a batch that hold about max_bytes of one string column; one row at least."""
    col = batch.column(column)
    if col.nbytes <= max_bytes:
        yield batch
        return
    sizes = pa.compute.binary_length(col).fill_null(0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def groups(batches, key: int):
    """(key, [record batches of that key]) runs of a stream sorted by an integer or string column.

    A run is split where a batch ends: callers gather as much of it as they can hold.
    """
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield keys[a], batch.slice(a, b - a)
