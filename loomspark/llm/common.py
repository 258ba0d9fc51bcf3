"""What the operators of this subpackage share: the shared folder, materialised tables and two-level ranks."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.plans import tables
from loomspark.plans.tables import discard, shared_dir, shared_path

__all__ = ["WORD_PATTERN", "discard", "materialise", "read_table", "shared_dir", "shared_path", "two_level", "utf8", "word_count"]

#: Words are maximal runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives the loss of executors."""
    out = tables.materialise(df, name)
    gc.collect()  # lets Spark remove the shuffle files behind the table
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str) -> Column:
    """A text column as bytes; null becomes empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def two_level(df: DataFrame, keys: list[str], bucket: str, order: list[Column], rank: str, running: dict[str, str] | None = None) -> DataFrame:
    """Add ``rank`` (from 0) and exclusive running sums within ``keys``, in the order of ``bucket`` and then ``order``.

    A single window over ``keys`` would put a hot key into one task. Here each (keys, bucket) is a window of its
    own, and the counts of the buckets before it come from a join with per-bucket totals, aggregated map-side first.
    ``bucket`` must rise with the wanted order; with about sqrt(n) buckets a key, both levels stay at about sqrt(n) rows.
    running: name of each added sum -> the summed column.
    """
    running = running or {}
    stats = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{a}") for a, c in running.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = stats.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(bucket).alias("_bucket"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), *[F.coalesce(F.sum(f"_s_{a}").over(before), F.lit(0)).alias(f"_base_{a}") for a in running])
    on = F.col(bucket).eqNullSafe(F.col("_bucket"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(base, on)
        .withColumn(rank, F.col("_base") + F.row_number().over(inside) - 1)
        .withColumns({a: F.col(f"_base_{a}") + F.coalesce(F.sum(c).over(so_far), F.lit(0)) for a, c in running.items()})
        .drop("_base", "_bucket", *[f"_k_{k}" for k in keys], *[f"_base_{a}" for a in running])
    )
