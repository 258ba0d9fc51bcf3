"""Incremental work over a growing folder of chunks: only new ids are processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomspark.sources.io import missing_rows


def embed_stream(spark: SparkSession, source: str, target: str, checkpoint: str, encode: Callable[[DataFrame], DataFrame], schema: str, key: str = "id") -> StreamingQuery:
    """Read new Parquet files of ``source``, encode the rows whose key ``target`` lacks, and append them; ends when all is read."""

    def batch(df: DataFrame, _: int) -> None:
        try:
            done = spark.read.parquet(target)
        except Exception as e:  # noqa: BLE001  the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            new = df.dropDuplicates([key])
        else:
            new = missing_rows(df.dropDuplicates([key]), done, key)
        encode(new).write.mode("append").parquet(target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
