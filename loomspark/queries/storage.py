"""Queries of sources and sinks: each writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import evaluate, graph, lexical, vector
from loomspark.plans.tables import materialise, shared_path
from loomspark.queries import retrieval, texts
from loomspark.sources import io
from loomspark.streaming.incremental import embed_stream

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return io.read_table(spark, f"{d}/{name}.parquet")


@query("SELECT CASE WHEN doc_id % 3 > 0 THEN doc_id + 2000000 WHEN doc_id % 2 > 0 THEN doc_id + 1000000 ELSE doc_id END::BIGINT AS document_id, source AS title, lang AS legal_type, length(text)::INT AS n FROM documents")
def corpus_load(spark: SparkSession, d: str) -> DataFrame:
    """Content and metadata by position; the id is the content's, else the metadata's, else the position."""
    docs, path = _t(spark, d, "documents"), shared_path(spark, "corpus")
    docs.select(F.col("doc_id").alias("row"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") + 2000000).alias("id"), F.col("text").alias("content")).write.parquet(f"{path}/content/data")
    docs.select(F.col("doc_id").alias("row"), F.when(F.col("doc_id") % 2 > 0, F.col("doc_id") + 1000000).alias("id"), F.col("source").alias("title"), F.col("lang").alias("legal_type")).write.parquet(f"{path}/metadata")
    return io.read_corpus(spark, f"{path}/content", f"{path}/metadata").select("document_id", "title", "legal_type", F.length("content").alias("n"))


@query("SELECT doc_id, lang, CASE WHEN doc_id % 4 > 0 THEN source END AS title FROM documents")
def corpus_join_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Documents without metadata stay."""
    docs = _t(spark, d, "documents")
    from loomspark.operators.chunker import join_metadata

    known = docs.where("doc_id % 4 > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("title"))
    out = join_metadata(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("content")), known)
    return out.select(F.col("document_id").alias("doc_id"), F.col("content").alias("lang"), "title")


@query("SELECT 'chunks' AS name, true AS present, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'index', false, 0")
def artifact_check(spark: SparkSession, d: str) -> DataFrame:
    """Tables are written whole; a rebuild removes what was derived and keeps the chunks."""
    folder = shared_path(spark, "artifacts")
    io.write_table(_t(spark, d, "documents"), f"{folder}/chunks")
    io.write_table(_t(spark, d, "labels"), f"{folder}/index")
    io.clear_derived(spark, folder)
    rows = [(n, io.has_rows(spark, f"{folder}/{n}")) for n in ("chunks", "index")]
    n = spark.read.parquet(f"{folder}/chunks").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame(rows, "name string, present boolean").join(n.withColumn("present", F.lit(True)), "present", "left").select("name", "present", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT c_custkey, c_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def zipped_by_position(spark: SparkSession, d: str) -> DataFrame:
    """Two halves of a table put together by their stored ordinal."""
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = materialise(c.select("c_custkey", "c_name", "r_name", F.col("c_custkey").alias("row")), "halves")
    return io.zip_by_position(c.select("row", "c_custkey", "c_name"), c.select("row", "r_name")).drop("row")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS embedding_row, vec_id, label FROM embeddings")
def embedding_metadata(spark: SparkSession, d: str) -> DataFrame:
    """All columns but the vectors, numbered."""
    path = shared_path(spark, "metadata")
    io.write_table(io.metadata_table(_t(spark, d, "embeddings"), "vec_id"), f"{path}/rows")
    return spark.read.parquet(f"{path}/rows").select(F.col("embedding_row").cast("long").alias("embedding_row"), "vec_id", "label")


_FIRST = "round(embedding[1]::DOUBLE / greatest(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding[1:8]])), 1e-12), 6)"


@query(f"SELECT vec_id, {_FIRST} AS first, (SELECT count(*) FROM embeddings)::BIGINT AS n FROM embeddings")
def embedding_resume(spark: SparkSession, d: str) -> DataFrame:
    """An interrupted run is taken up again; only missing rows are encoded."""
    v, path = _t(spark, d, "embeddings").select("vec_id", "embedding"), shared_path(spark, "store")
    encode = lambda df: df.select("vec_id", vector.truncate_normalize("embedding", 8).alias("e"))
    io.resume_embedding(v.where("vec_id % 3 = 0"), path, encode, "first eight", "vec_id")
    n = io.resume_embedding(v, path, encode, "first eight", "vec_id")
    return spark.read.parquet(f"{path}/rows").select("vec_id", F.round(F.col("e")[0], 6).alias("first"), F.lit(n).cast("long").alias("n"))


@query(f"SELECT vec_id, {_FIRST} AS first FROM embeddings")
def embedding_stream(spark: SparkSession, d: str) -> DataFrame:
    """S10 as a stream: files that arrive are encoded, ids that are there already are not."""
    v, path = _t(spark, d, "embeddings").select("vec_id", "embedding"), shared_path(spark, "stream")
    v.where("vec_id % 2 = 0").write.parquet(f"{path}/in")
    encode = lambda df: df.select("vec_id", vector.truncate_normalize("embedding", 8).alias("e"))
    for _ in range(2):
        embed_stream(spark, f"{path}/in", f"{path}/out", f"{path}/progress", encode, "vec_id long, embedding array<float>", "vec_id").awaitTermination()
        v.write.mode("append").parquet(f"{path}/in")
    return spark.read.parquet(f"{path}/out").select("vec_id", F.round(F.col("e")[0], 6).alias("first"))


@query("SELECT count(*)::BIGINT AS n, 0::BIGINT AS n_bad, 1.0::DOUBLE AS min_norm, 1.0::DOUBLE AS avg_norm, 1.0::DOUBLE AS max_norm FROM embeddings")
def vector_index_store(spark: SparkSession, d: str) -> DataFrame:
    """A cosine index on disk; its rows are counted against the metadata's."""
    v, path = _t(spark, d, "embeddings"), shared_path(spark, "index")
    vector.write_index(v.select("vec_id", "embedding"), path, metric="cosine")
    return vector.norm_stats(vector.read_index(spark, path, v))


@query(f"WITH {retrieval._BM25} SELECT query_id, doc_id, score, rank::BIGINT AS rank FROM r WHERE rank <= 10")
def bm25_stored_index(spark: SparkSession, d: str) -> DataFrame:
    """A search in a stored index."""
    path = shared_path(spark, "bm25")
    lexical.build_index(_t(spark, d, "documents"), path)
    asked = lexical.query_terms(retrieval._items(spark, d))
    return lexical.index_top_k(lexical.load_index(spark, path), asked, 10)


@query(f"""WITH {texts.LEGAL} SELECT 'node_type' AS what, node_type AS name, count(*)::BIGINT AS n FROM nodes GROUP BY ALL
UNION ALL SELECT 'relationship', relationship, count(*) FROM edges GROUP BY ALL UNION ALL SELECT 'resolution', resolution_status, count(*) FROM edges WHERE edge_type = 'DOCUMENT_LINK' GROUP BY ALL""")
def graph_store(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, edges and statistics, checked and written."""
    chunks, path = texts.legal_chunks(spark, d), shared_path(spark, "graph")
    io.write_graph(graph.build_nodes(chunks), graph.build_edges(chunks), path)
    return spark.read.schema("what string, name string, n long").json(f"{path}/statistics")


@query("""WITH i AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS n FROM benchmark)
SELECT 'jsonl' AS kind, (n + 1)::VARCHAR AS query_id, text AS query, item_id || ',' || (item_id + 1) AS relevant FROM i
UNION ALL SELECT 'json', n::VARCHAR, text, item_id || ',' || (item_id + 1) FROM i UNION ALL SELECT 'csv', n::VARCHAR, text, item_id || ',' || (item_id + 1) FROM i""")
def items_read(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items in three formats, without ids of their own."""
    path, out = shared_path(spark, "items"), None
    i = _t(spark, d, "benchmark").coalesce(1).sortWithinPartitions("item_id")
    ids = lambda a, b, c: F.concat(F.lit(a), F.col("item_id").cast("string"), F.lit(b), (F.col("item_id") + 1).cast("string"), F.lit(c))
    i.select(F.col("text").alias("query"), F.array(F.col("item_id").cast("string"), (F.col("item_id") + 1).cast("string")).alias("relevant_chunk_ids")).write.json(f"{path}/items.jsonl")
    whole = F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("item_id", F.struct(F.col("text").alias("question"), ids("['", "', '", "']").alias("ground_truth")).alias("x")))), lambda s: s["x"]).alias("data")))
    i.agg(whole.alias("value")).write.text(f"{path}/items.json")
    i.select(F.col("text").alias("text"), ids("", "|", "").alias("answers")).write.option("header", True).option("escape", '"').csv(f"{path}/items.csv")
    for kind in ("jsonl", "json", "csv"):
        one = evaluate.parse_items(io.read_items(spark, f"{path}/items.{kind}")).select(F.lit(kind).alias("kind"), "query_id", "query", F.array_join("relevant_chunk_ids", ",").alias("relevant"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {retrieval._BM25}, {retrieval._RELEVANT}, {retrieval._METRICS}, n AS (SELECT query_id, count(*) AS c FROM top GROUP BY query_id) SELECT m.query_id::VARCHAR AS query_id, round(recall_5, 6) AS recall_5, round(mrr_10, 6) AS mrr_10, hit_10 = 0 AS miss, coalesce(c, 0)::INT AS n_ranked, (SELECT count(*) FROM rel WHERE rel.query_id = m.query_id)::INT AS n_relevant FROM m LEFT JOIN n USING (query_id)")
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation's report and its tables; here the rows by query, read back."""
    path, ks = shared_path(spark, "report"), retrieval.KS
    ranked = materialise(retrieval.bm25_topk(spark, d).withColumnRenamed("doc_id", "chunk_id"), "ranked")
    relevant = materialise(retrieval._relevant(spark, d), "relevant")
    items = retrieval._items(spark, d)
    metrics = materialise(evaluate.per_query(ranked, relevant, ks, items), "metrics")
    known = relevant.groupBy("query_id").agg(F.collect_list(F.col("chunk_id").cast("string")).alias("relevant_chunk_ids"))
    asked = items.join(known, "query_id", "left").withColumn("relevant_chunk_ids", F.coalesce("relevant_chunk_ids", F.array().cast("array<string>")))
    io.write_evaluation(evaluate.summary(metrics, ks), evaluate.query_details(metrics, ranked, asked, ks), path, query_count=asked.count())
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/query_level_results")
    listed = lambda c: F.size(F.from_json(c, "array<string>"))
    return rows.select("query_id", F.round(F.col("recall_5").cast("double"), 6).alias("recall_5"), F.round(F.col("mrr_10").cast("double"), 6).alias("mrr_10"), (F.col("miss") == "true").alias("miss"), listed("ranked_chunk_ids").alias("n_ranked"), listed("relevant_chunk_ids").alias("n_relevant"))


_VARIANT = "SELECT source AS variant, (doc_id % 7 = 0)::INT AS missing, " + ", ".join(f"(doc_id % {k}) / {k}.0::DOUBLE AS recall_{k}" for k in (5, 10, 100, 200)) + ", 1 / (1 + doc_id % 4)::DOUBLE AS mrr_10 FROM documents"


@query(f"SELECT variant, count(*)::BIGINT AS n_queries, sum(missing)::BIGINT AS n_missing, {', '.join(f'round(avg(recall_{k}), 6) AS recall_{k}' for k in (5, 10, 100, 200))}, round(avg(mrr_10), 6) AS mrr_10 FROM ({_VARIANT}) GROUP BY variant")
def variant_summary(spark: SparkSession, d: str) -> DataFrame:
    """Variants of a system side by side, here sources of documents with measures made of their ids."""
    i, path = F.col("doc_id"), shared_path(spark, "variants")
    m = _t(spark, d, "documents").select("doc_id", F.col("source").alias("variant"), (i % 7 == 0).cast("int").alias("missing"), *[((i % k) / float(k)).alias(f"recall_{k}") for k in (5, 10, 100, 200)], (1.0 / (1 + i % 4)).alias("mrr_10"))
    io.write_variants(evaluate.variant_report(m), m, path)
    rows = spark.read.option("header", True).csv(f"{path}/variant_summary")
    return rows.select(*[F.col(c).cast("long" if c.startswith("n_") else "string" if c == "variant" else "double").alias(c) for c in rows.columns])
