"""Keyword search: tokens, postings and BM25 top-k for a whole batch of queries."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.plans.tables import shared_path

TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column | str) -> Column:
    """Lower-case runs of at least two letters, digits or underscores; null has none."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(TOKEN), F.lit(0))


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl): how often each term is in each document, and the document's length in tokens."""
    t = docs.select(F.col(doc_id).alias("doc_id"), tokens(text).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term")).groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row (n, avgdl) over all documents, those without tokens included."""
    return docs.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.size(tokens(text))) / F.count(F.lit(1))).alias("avgdl"))


@dataclass(frozen=True)
class Index:
    """A keyword index: postings (doc_id, term, tf, dl), documents that hold a term (term, df), and the corpus's size and mean length."""

    postings: DataFrame
    df: DataFrame
    n: int
    avgdl: float


def query_terms(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, term, qtf)."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(query)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def build_index(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", vocabulary: DataFrame | None = None) -> Index:
    """The index of docs, written to ``path`` (the shared folder, where none is given). With a vocabulary (term), of its terms only.

    Documents are tokenised once: the corpus's size and length are observed while the postings are written. Postings are sorted by
    term, so that a query's terms prune files.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "bm25")
    seen = Observation()
    t = docs.select(F.col(doc_id).alias("doc_id"), tokens(text).alias("t")).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.size("t")).alias("total"))
    rows = t.select("doc_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    if vocabulary is not None:
        rows = rows.join(vocabulary, "term", "left_semi")
    post = rows.groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf")).select("doc_id", "term", "tf", "dl")
    post.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/df")
    n, total = seen.get["n"], seen.get["total"] or 0
    spark.createDataFrame([(n, total / n if n else 0.0)], "n long, avgdl double").write.mode("overwrite").parquet(f"{path}/stats")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> Index:
    """A written index. The table of frequencies must be that of the postings."""
    post, df = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/df")
    stats = spark.read.parquet(f"{path}/stats").first()
    if post.count() != (df.agg(F.sum("df")).first()[0] or 0):
        raise ValueError(f"{path}: postings and document frequencies don't belong together")
    return Index(post, df, stats["n"], stats["avgdl"])


def index_scores(index: Index, asked: DataFrame, k1: float = 1.5, b: float = 0.75, salts: int = 16) -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with a query. asked: (query_id, term, qtf).

    Query terms count as often as the query has them. A frequent term's postings are dealt by (term, salt), so that it is no single task.
    """
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(index.df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    tf = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.avgdl)))
    hit = index.postings.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).join(weighted, ["term", "salt"])
    return hit.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * tf), 6).alias("score"))


def bm25_scores(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query: str = "query", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``index_scores`` over an index of the queries' vocabulary."""
    asked = query_terms(queries, query_id, query)
    return index_scores(build_index(docs, None, doc_id, text, asked.select("term").distinct()), asked, k1, b)


def top_k(scores: DataFrame, k: int, id_column: str = "doc_id", ascending: bool = False) -> DataFrame:
    """The k best of each query; rank from 1, ties by id."""
    order = F.col("score").asc() if ascending else F.col("score").desc()
    w = Window.partitionBy("query_id").orderBy(order, F.col(id_column).asc())
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _block_best(asked: pa.Table, there: pa.Table, k: int) -> pa.Table:
    """(query_id, doc_id, score): documents that may be among the k best of each query, of one block of queries and all postings of one of documents."""
    encode = lambda c: c.combine_chunks().dictionary_encode(null_encoding="encode")
    queries, terms, docs = encode(asked["query_id"]), encode(asked["term"]), encode(there["doc_id"])
    weights = np.zeros((len(terms.dictionary), len(queries.dictionary)))
    np.add.at(weights, (terms.indices.to_numpy(), queries.indices.to_numpy()), asked["w"].to_numpy())
    term = pc.index_in(there["term"].combine_chunks(), value_set=terms.dictionary).fill_null(-1).to_numpy()
    order = np.argsort(docs.indices.to_numpy(), kind="stable")
    order = order[term[order] >= 0]
    held, doc, tf = term[order], docs.indices.to_numpy()[order], there["tf"].to_numpy()[order]
    score = np.zeros((len(docs.dictionary), weights.shape[1]))
    for at in range(0, len(order), 8192):
        part = slice(at, at + 8192)
        starts = np.flatnonzero(np.r_[True, np.diff(doc[part]) != 0])
        score[doc[part][starts]] += np.add.reduceat(weights[held[part]] * tf[part, None], starts, axis=0)
    # Scores are rounded after this: what rounding may lift to the k-th stays.
    kth = np.partition(score, len(score) - k, axis=0)[len(score) - k] if k < len(score) else np.zeros(score.shape[1])
    i, j = np.nonzero((score >= kth - 2e-6) & (score > 0))
    return pa.table({"query_id": queries.dictionary.take(pa.array(j)), "doc_id": docs.dictionary.take(pa.array(i)), "score": pa.array(score[i, j])})


def index_top_k(index: Index, asked: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, block: int = 4096, query_block: int = 256) -> DataFrame:
    """(query_id, doc_id, score, rank): ``top_k`` of the positive ``index_scores``, without a row for each query and document that share a term.

    Nearly every document shares some term with every query. So postings of the queries' terms are dealt into blocks of documents, terms into blocks of
    queries, and two blocks meet as a product; only what may be among a block's k best goes on.
    """
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    blocks, query_blocks = (max(1, math.ceil(n / size)) for n, size in ((index.n, block), (asked.select("query_id").distinct().count(), query_block)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    tf = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.avgdl)))
    q = asked.join(index.df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("w"), number("query_id", query_blocks).alias("qb"), every(blocks).alias("b"))
    p = index.postings.join(asked.select("term").distinct(), "term", "left_semi").select("doc_id", "term", tf.alias("tf"), number("doc_id", blocks).alias("b"), every(query_blocks).alias("qb"))
    keys, tasks = ("b", "qb"), min(4 * blocks * query_blocks, 1 << 14)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((q, "query_id"), (p, "doc_id"))]

    def run(mine: pa.Table, there: pa.Table) -> pa.Table:
        if not mine.num_rows or not there.num_rows:
            ids = {c: t.schema.field(c).type for c, t in (("query_id", mine), ("doc_id", there)) if c in t.schema.names}
            return pa.table({c: pa.array([], ids.get(c, pa.null())) for c in ("query_id", "doc_id")} | {"score": pa.array([], pa.float64())})
        return _block_best(mine, there, k)

    met = q.toDF(*q.columns).repartition(tasks, *keys).groupBy(*keys).cogroup(p.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return top_k(met.withColumn("score", F.round("score", 6)).where("score > 0"), k)


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query: str = "query", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): positive scores only."""
    asked = query_terms(queries, query_id, query)
    return index_top_k(build_index(docs, None, doc_id, text, asked.select("term").distinct()), asked, k, k1, b)
