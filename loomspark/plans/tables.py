"""Written tables between steps: they cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Where it is unset, a local one serves a local master; on a cluster that is an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomspark-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def _on(spark: SparkSession, path: str):
    """(file system, path) of the driver's JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = _on(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _on(spark, path)
    fs.delete(where, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the path is kept as ``loom_path``."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.loom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df.loom_path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, so that what Python makes of them stays small however long a batch is."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
