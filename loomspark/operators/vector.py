"""Dense vectors: truncation and normalisation, checks, encoding and exact top-k."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import let
from loomspark.operators.lexical import tokens, top_k


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def truncate_normalize(v: Column | str, dims: int | None = None, floor: float = 1e-12) -> Column:
    """The first ``dims`` components, scaled to length one."""
    v = F.col(v) if isinstance(v, str) else v
    cut = F.slice(v, 1, dims) if dims else v
    return let(cut, lambda c: let(F.greatest(norm(c), F.lit(floor)), lambda n: F.transform(c, lambda x: x.cast("double") / n)))


def finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def norm_stats(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row over all vectors: n, n_bad (not finite) and the least, mean and greatest norm."""
    v = F.col(column)
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(~finite(v)).alias("n_bad"), F.round(F.min(norm(v)), 6).alias("min_norm"), F.round(F.avg(norm(v)), 6).alias("avg_norm"), F.round(F.max(norm(v)), 6).alias("max_norm"))


def index_table(vectors: DataFrame, column: str = "embedding", metric: str = "ip") -> DataFrame:
    """The vectors as an index: rows with a component that isn't finite are an error; the metric 'cosine' stores them at length one."""
    metric = {"ip": "ip", "inner_product": "ip", "dot": "ip", "cosine": "cosine", "l2": "l2", "euclidean": "l2"}[metric.lower()]
    checked = F.when(finite(F.col(column)), F.col(column)).otherwise(F.raise_error(F.lit("a vector isn't finite")).cast("array<float>"))
    return vectors.withColumn(column, truncate_normalize(checked) if metric == "cosine" else checked)


def hashed_encoder(text: Column | str, dims: int = 64) -> Column:
    """A deterministic stand-in for a trained encoder: counts of hashed tokens, at length one."""
    slots = F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    return truncate_normalize(let(slots, lambda held: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(held, lambda s: s == i)).cast("double"))))


def _block_top(asked: pa.Table, there: pa.Table, k: int, metric: str) -> pa.Table:
    """(query_id, vec_id, score): rows that may be among the k best, of one block of queries and one of vectors of one length.

    Where both sides carry ``hashes``, only pairs that share one in its place count.
    """
    matrix = lambda t, c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
    q, v = matrix(asked, "query"), matrix(there, "embedding")
    score = q @ v.T
    if metric == "l2":
        score = np.maximum((q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * score, 0.0)
    score = np.round(score, 6) + 0.0
    better = -score if metric == "l2" else score
    met = None
    if "hashes" in asked.schema.names:
        met = np.zeros(score.shape, bool)
        for a, b in zip(matrix(asked, "hashes").T, matrix(there, "hashes").T, strict=True):
            met |= a[:, None] == b[None, :]
        better = np.where(met, better, -np.inf)
    kth = np.partition(better, len(v) - k, axis=1)[:, len(v) - k] if k < len(v) else np.full(len(q), -np.inf)
    i, j = np.nonzero(better >= kth[:, None] if met is None else (better >= kth[:, None]) & met)
    return pa.table({"query_id": asked["query_id"].take(pa.array(i)), "vec_id": there["vec_id"].take(pa.array(j)), "score": pa.array(score[i, j])})


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "ip", block: int = 8192, query_block: int = 1024) -> DataFrame:
    """(query_id, vec_id, score, rank) of a stated query set against all vectors. Inner products descend, squared distances ascend.

    vectors: (vec_id, embedding); queries: (query_id, query). Both sides are dealt into blocks; a block of queries meets each block of vectors as
    one matrix product, and only what may be among its k best goes on. Vectors that are null, or hold a null, take no part; only
    equal lengths meet. Where both sides carry ``hashes``, arrays of one length, only pairs that share one in its place count.
    """
    hashed = [c for c in ("hashes",) if c in queries.columns and c in vectors.columns]
    whole = lambda df, c: df.where(F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull())).withColumn("dim", F.size(c))
    q, v = whole(queries.select("query_id", "query", *hashed), "query"), whole(vectors.select("vec_id", "embedding", *hashed), "embedding")
    blocks, query_blocks = (max(1, math.ceil(df.count() / n)) for df, n in ((v, block), (q, query_block)))
    number = lambda *c, n: F.pmod(F.xxhash64(*c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = q.withColumns({"qb": number("query_id", "query", n=query_blocks)}).withColumn("b", every(blocks))
    v = v.withColumns({"b": number("vec_id", "embedding", n=blocks)}).withColumn("qb", every(query_blocks))
    keys, tasks = ("dim", "b", "qb"), min(4 * blocks * query_blocks, 1 << 14)
    out = f"query_id {q.schema['query_id'].dataType.simpleString()}, vec_id {v.schema['vec_id'].dataType.simpleString()}, score double"
    empty = pa.schema([("query_id", pa.null()), ("vec_id", pa.null()), ("score", pa.float64())])

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            ids = {c: t.schema.field(c).type for c, t in (("query_id", asked), ("vec_id", there)) if c in t.schema.names}
            return pa.table({f.name: pa.array([], ids.get(f.name, f.type)) for f in empty})
        return _block_top(asked, there, k, metric)

    # The names differ on both sides, and one is projected anew: a cogroup takes no self-join.
    asked = q.toDF(*q.columns).repartition(tasks, *keys).groupBy(*keys)
    met = asked.cogroup(v.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(run, out)
    return top_k(met, k, "vec_id", ascending=metric == "l2")


def approximate_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, bucket_length: float = 2.0, tables: int = 6) -> DataFrame:
    """(query_id, vec_id, score, rank) by random projections: an approximate search by squared distance; misses are possible.

    A pair counts if a projection puts both into one bucket in some table. Near vectors share buckets, so nearly all pairs meet in one: as joined rows
    they grow with queries times vectors. Here blocks of both sides meet, as in ``vector_top_k``, and only what may be among the k best goes on.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    features = lambda df, c: df.withColumn("features", array_to_vector(F.col(c).cast("array<double>")))
    v, q = features(vectors.select("vec_id", "embedding"), "embedding"), features(queries.select("query_id", "query"), "query")
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=7).fit(v)
    bucket = lambda df: model.transform(df).withColumn("hashes", F.transform("hashes", lambda h: vector_to_array(h)[0])).drop("features")
    return vector_top_k(bucket(v), bucket(q), k, "l2")


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (n_queries, recall): the share of exact (query_id, vec_id) that was found."""
    hit = found.select("query_id", "vec_id").distinct().withColumn("hit", F.lit(1))
    return exact.join(hit, ["query_id", "vec_id"], "left").agg(F.countDistinct("query_id").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def write_index(vectors: DataFrame, path: str, column: str = "embedding", metric: str = "ip") -> None:
    """An index on disk: checked vectors, and how many there are."""
    index_table(vectors, column, metric).write.mode("overwrite").parquet(f"{path}/vectors")
    n = vectors.sparkSession.read.parquet(f"{path}/vectors").count()
    vectors.sparkSession.createDataFrame([(metric, n)], "metric string, n long").write.mode("overwrite").parquet(f"{path}/manifest")


def read_index(spark: SparkSession, path: str, metadata: DataFrame | None = None) -> DataFrame:
    """The vectors of a written index; another number of them than was written, or than there are rows of metadata, is an error."""
    vectors, n = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/manifest").first()["n"]
    for have in (vectors.count(), *(() if metadata is None else (metadata.count(),))):
        if have != n:
            raise ValueError(f"{path} was written with {n} vectors, there are {have} rows")
    return vectors


def self_probe(vectors: DataFrame, first: int = 5, metric: str = "ip") -> DataFrame:
    """(vec_id, found): whether each of the first vectors finds itself first."""
    asked = vectors.orderBy("vec_id").limit(first).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    best = vector_top_k(vectors, asked, 1, metric)
    return best.select(F.col("query_id").alias("vec_id"), (F.col("query_id") == F.col("vec_id")).alias("found"))
