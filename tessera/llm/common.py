"""Shared plumbing: the shared folder, materialised tables and Arrow batches of bounded size."""

from __future__ import annotations

import gc
import os
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tessera.session import shared_folder

#: Text bytes that a Python worker handles at once.
CHUNK_BYTES = 4 << 20
#: Bytes of an Arrow batch that Spark hands to a Python worker.
ARROW_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only for a run on one machine."""
    return shared_folder(spark)


def bounded(df: DataFrame) -> DataFrame:
    """df, with Arrow batches to and from Python limited by size: texts may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage and survives the
    loss of any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df, when nothing will read it again."""
    delete(df.sparkSession, df.written_to)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


_left: list[str] = []


def leave(df: DataFrame) -> DataFrame:
    """Notes that df's written table is still read by a result that its caller is about to write."""
    _left.append(df.written_to)
    return df


def sweep(docs: DataFrame) -> None:
    """Deletes the noted tables, but for those that docs reads: its caller has written what was made of them."""
    leaves, used, spark = docs._jdf.queryExecution().analyzed().collectLeaves(), "", docs.sparkSession
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            used += leaf.relation().location().rootPaths().mkString(" ")
    for path in [p for p in _left if p.rsplit("/", 1)[-1] not in used]:
        _left.remove(path)
        delete(spark, path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps now; else they stay until the driver happens
    to collect its garbage. A plan lets go of its shuffles only in a second round."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's strings as bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices Arrow batches so that each slice holds about `limit` text bytes (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def local_file(uri: str) -> str:
    """The mount path of a shared folder. Memory-mapped formats need one; object stores don't have it."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: memory-mapped files need a shared folder that is mounted on every node")
    return os.path.abspath(uri)
