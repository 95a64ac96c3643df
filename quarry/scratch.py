"""Tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T


_local = threading.local()


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a session on one machine that names none gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints/quarry"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/quarry-{spark.sparkContext.applicationId}"


def nullable(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    return kind


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back; codec is one of Parquet's compressions.

    The copy outlives lost executors, and each consumer prunes its columns. The folder goes with clear().
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path, compression=codec)
    for paths in getattr(_local, "recording", ()):
        paths.append(path)
    return spark.read.schema(nullable(df.schema)).parquet(path)


def shared(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that is released like a staged table."""
    out = spark.sparkContext.broadcast(value)
    for held in getattr(_local, "recording", ()):
        held.append(out)
    return out


def located(df: DataFrame, name: str) -> tuple[DataFrame, Column, Column]:
    """A table read from Parquet files with df's rows, and each row's file and place in it, the same in every scan.

    A table just as it was read is taken as it is; anything else is staged.
    """
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation" or "parquet" not in df._jdf.queryExecution().analyzed().toString().lower():
        df = staged(df, name)
    meta = df.metadataColumn("_metadata")
    return df, meta["file_path"], meta["row_index"]


@contextmanager
def recorded() -> Iterator[list[str | Broadcast]]:
    """The paths of the tables that this thread stages meanwhile, and its broadcasts."""
    paths: list[str | Broadcast] = []
    _local.recording = [*getattr(_local, "recording", ()), paths]
    try:
        yield paths
    finally:
        _local.recording = _local.recording[:-1]


def _delete(spark: SparkSession, folder: str) -> None:
    jvm, sc = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, held: list[str | Broadcast]) -> None:
    """Remove staged tables and broadcasts whose readers have all been written."""
    while held:
        one = held.pop()
        if isinstance(one, Broadcast):
            one.destroy()
        else:
            _delete(spark, one)


def clear(spark: SparkSession) -> None:
    """Remove this application's staged tables."""
    _delete(spark, _folder(spark))
