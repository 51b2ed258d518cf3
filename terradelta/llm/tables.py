"""Staged tables in the cluster's shared folder, and Arrow batches in bounded slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names. Where it is unset, a new local one on one machine, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
    return folder or _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    The lineage ends there: what reads the table survives lost executors without computing it again, and
    joins with it meet a plain scan, so that Spark knows its size and can split skewed partitions.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def drop_staged(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` has written and that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.staged_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shared_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    """The values of ``key`` that at least two rows of ``df`` have, staged."""
    return staged(df.groupBy(key).agg(F.count("*").alias("n")).where("n >= 2").select(key), name)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches, so that few rows at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
