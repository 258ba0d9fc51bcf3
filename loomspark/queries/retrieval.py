"""Queries of search, fusion and evaluation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import evaluate, fusion, graph, lexical, vector
from loomspark.plans import retrieval as plans
from loomspark.plans.tables import materialise
from loomspark.sources.io import read_table

KS = (5, 10)
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _items(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, f"{d}/embeddings.parquet")


def _asked(vectors: DataFrame) -> DataFrame:
    """The stated query set of searches: ids divisible by 20."""
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


_BM25 = r"""
t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
s AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM t),
p AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM benchmark) GROUP BY ALL),
b AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b WHERE score > 0)"""


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank::BIGINT AS rank FROM r WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """R1-R3."""
    return lexical.bm25_top_k(read_table(spark, f"{d}/documents.parquet"), _items(spark, d), 10)


@query(r"SELECT term, count(*)::BIGINT AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) GROUP BY term")
def bm25_document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """R2: the index's document frequencies."""
    return lexical.document_frequencies(lexical.postings(read_table(spark, f"{d}/documents.parquet")))


_DOT = "round(list_sum([a[1]::DOUBLE * a[2]::DOUBLE FOR a IN list_zip({0}, {1})]), 6)"
_L2 = "round(list_sum([(a[1]::DOUBLE - a[2]::DOUBLE) * (a[1]::DOUBLE - a[2]::DOUBLE) FOR a IN list_zip({0}, {1})]), 6)"


def _knn(score: str, order: str, k: int = 10) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {score.format('q.embedding', 'v.embedding')} AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0) QUALIFY rank <= {k})"


@query(f"SELECT query_id, vec_id, score, rank::BIGINT AS rank FROM {_knn(_DOT, 'DESC')}")
def vector_topk_ip(spark: SparkSession, d: str) -> DataFrame:
    """M7."""
    return vector.vector_top_k(_vectors(spark, d).select("vec_id", "embedding"), _asked(_vectors(spark, d)), 10)


@query(f"SELECT query_id, vec_id, score, rank::BIGINT AS rank FROM {_knn(_L2, 'ASC')}")
def vector_topk_l2(spark: SparkSession, d: str) -> DataFrame:
    """M8."""
    return vector.vector_top_k(_vectors(spark, d).select("vec_id", "embedding"), _asked(_vectors(spark, d)), 10, "l2")


@query("WITH n AS (SELECT vec_id, embedding[1:32] AS e, greatest(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding[1:32]])), 1e-12) AS l FROM embeddings) SELECT vec_id, i::INT AS dim, round(e[i]::DOUBLE / l, 6) AS value FROM n, range(1, 33) t(i)")
def vector_truncate_normalize(spark: SparkSession, d: str) -> DataFrame:
    """M3."""
    v = _vectors(spark, d).select("vec_id", F.posexplode(vector.truncate_normalize("embedding", 32)).alias("dim", "value"))
    return v.select("vec_id", (F.col("dim") + 1).alias("dim"), F.round("value", 6).alias("value"))


@query("SELECT count(*)::BIGINT AS n, count(*) FILTER (len([x FOR x IN embedding IF NOT isfinite(x)]) > 0)::BIGINT AS n_bad, round(min(l), 6) AS min_norm, round(avg(l), 6) AS avg_norm, round(max(l), 6) AS max_norm FROM (SELECT embedding, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) AS l FROM embeddings)")
def vector_norm_stats(spark: SparkSession, d: str) -> DataFrame:
    """M4."""
    return vector.norm_stats(_vectors(spark, d))


@query("WITH f AS (SELECT * FROM embeddings ORDER BY vec_id LIMIT 5), s AS (SELECT f.vec_id AS q, v.vec_id, row_number() OVER (PARTITION BY f.vec_id ORDER BY " + _DOT.format("f.embedding", "v.embedding") + " DESC, v.vec_id) AS r FROM f, embeddings v) SELECT q AS vec_id, q = vec_id AS found FROM s WHERE r = 1")
def vector_self_probe(spark: SparkSession, d: str) -> DataFrame:
    """M5, M6: an index finds its own first vectors."""
    return vector.self_probe(vector.index_table(_vectors(spark, d).select("vec_id", "embedding")))


_FUSED = f"""
a AS {_knn(_DOT, 'DESC', 20)},
b AS (SELECT query_id, doc_id AS vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {_L2.format('q.embedding[1:32]', 'v.embedding[1:32]')} AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0)) WHERE rank <= 20),
u AS (SELECT query_id, vec_id AS chunk_id, rank, 'vector' AS source, 0 AS l, 1.0::DOUBLE AS w FROM a UNION ALL SELECT query_id, vec_id, rank, 'short' AS source, 1, 0.5::DOUBLE FROM b),
f AS (SELECT query_id, chunk_id, round(sum(w / (60.0::DOUBLE + rank)), 9) AS score, array_to_string(list_sort(list(DISTINCT source)), '+') AS source, min((l, rank)) AS met FROM u GROUP BY ALL),
h AS (SELECT query_id, chunk_id, score, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, met, chunk_id)::BIGINT AS rank FROM f)"""


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select("vec_id", "embedding")
    short = v.withColumn("embedding", F.slice("embedding", 1, 32))
    one = vector.vector_top_k(v, _asked(v), 20)
    two = vector.vector_top_k(short, _asked(short), 20, "l2")
    return fusion.rrf([fusion.ranked_list(one, "vector", 0, "vec_id"), fusion.ranked_list(two, "short", 1, "vec_id")], [1.0, 0.5])


@query(f"WITH {_FUSED} SELECT * FROM h")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """R4-R6."""
    return _hybrid(spark, d)


_GRAPH = "g AS (SELECT query_id, vec_id AS chunk_id, round(1.0 / rank, 6) AS score, rank AS first_pos FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.label = v.label))"


@query(f"""WITH {_FUSED}, {_GRAPH},
m AS (SELECT query_id, chunk_id, round(0.8 * coalesce(h.score, 0) + 0.2 * coalesce(g.score, 0), 9) AS score, concat_ws('+', source, CASE WHEN g.score IS NOT NULL THEN 'graph' END) AS source, h.rank AS hr, first_pos FROM h FULL JOIN g USING (query_id, chunk_id))
SELECT query_id, chunk_id, score, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hr NULLS LAST, first_pos NULLS LAST, chunk_id)::BIGINT AS rank FROM m""")
def hybrid_graph_merge(spark: SparkSession, d: str) -> DataFrame:
    """Fused scores with a graph's, here neighbours of the same label."""
    from pyspark.sql import Window

    v = _vectors(spark, d)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    n = v.join(q, "label").withColumn("first_pos", F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id")).cast("long"))
    graph = n.select("query_id", F.col("vec_id").alias("chunk_id"), F.round(1.0 / F.col("first_pos"), 6).alias("score"), "first_pos")
    return fusion.with_graph(_hybrid(spark, d), graph)


#: A document is relevant to a passage that it holds.
_RELEVANT = "rel AS (SELECT DISTINCT item_id AS query_id, doc_id AS chunk_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, chunk_id): the documents that hold a passage.

    Candidates share the passage's words two to four (its first word may begin inside one); then the whole passage is compared. Passages of
    under five words have no such words: they are compared with every document, as a stated query set.
    """
    words = lambda c: F.split(c, r"[ \n]+")
    three = lambda i: F.xxhash64(F.array_join(F.slice("w", i, 3), " "))
    docs = read_table(spark, f"{d}/documents.parquet").select("doc_id", "text").where("text is not null")
    items = read_table(spark, f"{d}/benchmark.parquet").select("item_id", F.col("text").alias("passage"), words("text").alias("w"))
    keyed = items.where(F.size("w") >= 5).select("item_id", "passage", three(F.lit(2)).alias("h"))
    grams = docs.select("doc_id", words("text").alias("w")).where(F.size("w") >= 5).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 2), three))).alias("h"))
    cand = grams.join(keyed, "h").select("doc_id", "item_id", "passage").distinct().join(docs, "doc_id")
    short = docs.crossJoin(items.where((F.size("w") < 5) & F.col("passage").isNotNull()).select("item_id", "passage"))
    both = cand.select("item_id", "passage", "doc_id", "text").unionByName(short.select("item_id", "passage", "doc_id", "text"))
    return both.where(F.contains("text", "passage")).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id")).distinct()


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    ranked = bm25_topk(spark, d).withColumnRenamed("doc_id", "chunk_id")
    return evaluate.per_query(ranked, _relevant(spark, d), KS, _items(spark, d))


_METRICS = f"""
top AS (SELECT query_id, doc_id AS chunk_id, rank FROM r WHERE rank <= 10),
hits AS (SELECT query_id, chunk_id, rank FROM top JOIN rel USING (query_id, chunk_id)),
m AS (SELECT i.item_id AS query_id, {", ".join(f"coalesce((SELECT count(*) FROM hits h WHERE h.query_id = i.item_id AND rank <= {k}) / nullif((SELECT count(*) FROM rel WHERE rel.query_id = i.item_id), 0), 0)::DOUBLE AS recall_{k}, ((SELECT count(*) FROM hits h WHERE h.query_id = i.item_id AND rank <= {k}) / {k}.0)::DOUBLE AS precision_{k}, (SELECT count(*) > 0 FROM hits h WHERE h.query_id = i.item_id AND rank <= {k})::INT::DOUBLE AS hit_{k}, coalesce(1 / (SELECT min(rank) FROM hits h WHERE h.query_id = i.item_id AND rank <= {k}), 0)::DOUBLE AS mrr_{k}" for k in KS)} FROM benchmark i)"""


@query(f"WITH {_BM25}, {_RELEVANT}, {_METRICS} SELECT * FROM m")
def query_metrics(spark: SparkSession, d: str) -> DataFrame:
    """E5-E8."""
    return _metrics(spark, d)


@query(f"WITH {_BM25}, {_RELEVANT}, {_METRICS} SELECT count(*)::BIGINT AS n_queries, count(*) FILTER (hit_10 = 0)::BIGINT AS n_miss, " + ", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for k in KS for m in ("recall", "precision", "hit", "mrr")) + ", round((avg(recall_5) + avg(mrr_5) + avg(recall_10) + avg(mrr_10)) / 4, 6) AS objective FROM m")
def method_summary(spark: SparkSession, d: str) -> DataFrame:
    """E9, E10."""
    return evaluate.summary(_metrics(spark, d), KS)


_TRIALS = plans.GRIDS["hybrid"]


def _trials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(t.values()) for t in _TRIALS], "trial int, semantic_weight double, lexical_weight double, rrf_k double")


def _trial_summaries(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    one = vector.vector_top_k(v.select("vec_id", "embedding"), _asked(v), 20)
    short = v.select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    two = vector.vector_top_k(short, _asked(short), 20, "l2")
    lists = one.select("query_id", F.col("vec_id").alias("chunk_id"), "rank", F.lit("vector").alias("source")).unionByName(two.select("query_id", F.col("vec_id").alias("chunk_id"), "rank", F.lit("bm25").alias("source")))
    lists = materialise(lists, "lists")
    ranked = evaluate.fusion_trials(lists, _trials(spark), max(KS))
    # Relevant are all vectors of the query's label: they are counted, and paired only where a list holds the pair.
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("_asked"))
    pairs = lists.select("query_id", "chunk_id").distinct()
    relevant = pairs.join(q, "query_id").join(v.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id").where("label = _asked").select("query_id", "chunk_id").distinct()
    n_rel = q.join(v.groupBy("label").agg(F.count(F.lit(1)).alias("_n")), F.col("_asked") == F.col("label")).groupBy("query_id").agg(F.sum("_n").alias("n_rel"))
    return evaluate.summary(evaluate.per_query(ranked, relevant, KS, keys=["trial"], n_rel=n_rel), KS, ["trial"])


_GRID = f"""
a AS {_knn(_DOT, 'DESC', 20)},
b AS (SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {_L2.format('q.embedding[1:32]', 'v.embedding[1:32]')} AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0)) WHERE rank <= 20),
x AS (SELECT query_id, vec_id AS chunk_id, a.rank AS v, b.rank AS b FROM a FULL JOIN b USING (query_id, vec_id)),
t(trial, rrf_k, sw, lw) AS (VALUES {", ".join(f"({t['trial']}, {t['rrf_k']}::DOUBLE, {t['semantic_weight']}::DOUBLE, {t['lexical_weight']}::DOUBLE)" for t in _TRIALS)}),
f AS (SELECT trial, query_id, chunk_id, row_number() OVER (PARTITION BY trial, query_id ORDER BY round(coalesce(sw / (rrf_k + v), 0) + coalesce(lw / (rrf_k + b), 0), 9) DESC, v NULLS LAST, b NULLS LAST, chunk_id) AS rank FROM x, t),
rel AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.label = v.label),
n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY query_id),
y AS (SELECT trial, f.query_id, any_value(n_rel) AS n_rel, {", ".join(f"count(*) FILTER (rank <= {k} AND rel.chunk_id IS NOT NULL) AS n{k}" for k in KS)}, min(rank) FILTER (rel.chunk_id IS NOT NULL) AS first FROM f JOIN n ON n.query_id = f.query_id LEFT JOIN rel ON rel.query_id = f.query_id AND rel.chunk_id = f.chunk_id WHERE rank <= 10 GROUP BY ALL),
z AS (SELECT trial, count(*)::BIGINT AS n_queries, count(*) FILTER (n10 = 0)::BIGINT AS n_miss, {", ".join(f"round(avg(n{k} / n_rel), 6) AS recall_{k}, round(avg(n{k} / {k}.0::DOUBLE), 6) AS precision_{k}, round(avg((n{k} > 0)::INT), 6) AS hit_{k}, round(avg(CASE WHEN first <= {k} THEN 1 / first ELSE 0 END), 6) AS mrr_{k}" for k in KS)},
  round((avg(n5 / n_rel) + avg(CASE WHEN first <= 5 THEN 1 / first ELSE 0 END) + avg(n10 / n_rel) + avg(CASE WHEN first <= 10 THEN 1 / first ELSE 0 END)) / 4, 6) AS objective FROM y GROUP BY trial)"""


@query(f"WITH {_GRID} SELECT * FROM z")
def grid_search_rrf(spark: SparkSession, d: str) -> DataFrame:
    """27 trials in one plan."""
    return _trial_summaries(spark, d)


@query(f"WITH {_GRID} SELECT * FROM z ORDER BY objective DESC, trial LIMIT 1")
def grid_search_best(spark: SparkSession, d: str) -> DataFrame:
    """The first best trial."""
    return evaluate.best_trial(_trial_summaries(spark, d))


@query("SELECT CASE WHEN doc_id % 10 = 9 THEN 'gone-' || doc_id ELSE doc_id::VARCHAR END AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'own' WHEN doc_id % 10 = 9 THEN '' ELSE coalesce(text, '') END AS text, CASE WHEN doc_id % 4 = 0 THEN 'mine' WHEN doc_id % 10 = 9 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE source END AS source FROM documents")
def hydrate_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Results take texts and attributes of their chunks where they have none; unknown ids stay."""
    docs, i = read_table(spark, f"{d}/documents.parquet"), F.col("doc_id")
    results = docs.select(F.when(i % 10 == 9, F.concat(F.lit("gone-"), i.cast("string"))).otherwise(i.cast("string")).alias("chunk_id"), F.when(i % 3 == 0, "own").otherwise(" ").alias("text"), F.when(i % 4 == 0, "mine").alias("lang"))
    first = docs.select(F.concat(F.lit(" "), i.cast("string")).alias("id"), F.col("text").alias("content"), "lang", "source", F.lit(0).alias("chunk_ord"))
    again = first.withColumns({"content": F.lit("second"), "chunk_ord": F.lit(1)})
    return fusion.hydrate(results, first.unionByName(again)).select("chunk_id", "text", "lang", "source")


@query("SELECT count(*)::BIGINT AS n_queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """M9: approximate search finds at least nine of ten of the exact neighbours."""
    v = materialise(_vectors(spark, d).select("vec_id", "embedding"), "vectors")
    exact = vector.vector_top_k(v, _asked(v), 10, "l2")
    return vector.recall_of(vector.approximate_top_k(v, _asked(v), 10), exact).select("n_queries", (F.col("recall") >= 0.9).alias("reached"))


@query(r"SELECT doc_id, 64::INT AS dims, CASE WHEN regexp_matches(coalesce(text, ''), '[\p{L}\p{N}_]{2,}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents")
def encoder_norms(spark: SparkSession, d: str) -> DataFrame:
    """M1: the stand-in encoder's vectors."""
    e = read_table(spark, f"{d}/documents.parquet").select("doc_id", vector.hashed_encoder("text").alias("e"))
    return e.select("doc_id", F.size("e").alias("dims"), F.round(vector.norm(F.col("e")), 6).alias("norm"))


@query("""WITH x AS (SELECT doc_id, doc_id // 5 AS query_id, doc_id % 5 + 1 AS rank, CASE WHEN doc_id % 4 = 0 THEN 's' || doc_id // 2 WHEN doc_id % 4 = 1 THEN 'c' || doc_id WHEN doc_id % 4 = 2 THEN NULL ELSE 'p' || doc_id // 10 END AS chunk_id FROM documents),
k AS (SELECT query_id, chunk_id, min(rank) AS r FROM x WHERE chunk_id IS NOT NULL GROUP BY ALL) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY r, chunk_id) AS rank FROM k""")
def variant_projection(spark: SparkSession, d: str) -> DataFrame:
    """Each result stands for its seed, else its first source chunk, else itself unless it is a node."""
    i = F.col("doc_id")
    half = lambda k: F.floor(i / k).cast("string")
    docs = read_table(spark, f"{d}/documents.parquet")
    r = docs.select(F.floor(i / 5).alias("query_id"), F.when(i % 4 == 3, F.concat(F.lit("p"), half(10))).otherwise("article:1").alias("id"), F.when(i % 4 == 0, F.concat(F.lit("s"), half(2))).otherwise(" ").alias("seed_id"), F.when(i % 4 == 1, F.array(F.concat(F.lit("c"), i.cast("string")), F.lit("z"))).otherwise(F.array().cast("array<string>")).alias("source_chunk_ids"), (i % 5 + 1).alias("rank"))
    return evaluate.variant_ids(r)


def _setup(spark: SparkSession, d: str) -> tuple[plans.Index, DataFrame, DataFrame]:
    """(index, queries, relevance): documents as chunks, those with a vector's id as vectors, sources as sections of a graph, passages as queries.

    The query's vector is that of its number. A document is relevant if it holds the passage.
    """
    docs = materialise(read_table(spark, f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), F.coalesce("source", F.lit("")).alias("source")), "chunks")
    v = materialise(_vectors(spark, d).select(F.col("vec_id").cast("string").alias("vec_id"), "embedding"), "vectors")
    section = F.concat(F.lit("section:"), F.col("source"))
    article = F.concat(F.lit("article:"), F.col("chunk_id"))
    edges = graph.with_positions(docs.select(section.alias("source"), article.alias("target"), F.lit(1).alias("reference_count")), ["target"], "edge_pos", "target")
    nodes = graph.with_positions(docs.select(article.alias("node_id"), F.array("chunk_id").alias("source_chunk_ids")), ["node_id"], "node_pos", "node_id")
    q = _items(spark, d).select(F.col("query_id").cast("string").alias("query_id"), "query")
    q = materialise(q.join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id"), "queries")
    relevant = materialise(_relevant(spark, d).select(F.col("query_id").cast("string").alias("query_id"), F.col("chunk_id").cast("string").alias("chunk_id")).join(q.select("query_id"), "query_id", "left_semi"), "relevant")
    return plans.Index(docs, v, materialise(nodes, "nodes"), materialise(edges, "edges")), q, relevant


_K = 20
_PARTS = f"""
q5 AS (SELECT item_id::VARCHAR AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id),
rel5 AS (SELECT query_id::VARCHAR AS query_id, chunk_id::VARCHAR AS chunk_id FROM rel WHERE query_id::VARCHAR IN (SELECT query_id FROM q5)),
lb AS (SELECT query_id::VARCHAR AS query_id, doc_id::VARCHAR AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) AS rank FROM r WHERE query_id::VARCHAR IN (SELECT query_id FROM q5)),
b5 AS (SELECT * FROM lb WHERE rank <= {_K}),
v5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, vec_id::VARCHAR AS chunk_id, {_DOT.format('q5.embedding', 'e.embedding')} AS score FROM q5, embeddings e)) WHERE rank <= {_K}),
secs AS (SELECT doc_id::VARCHAR AS chunk_id, coalesce(source, '') AS section, row_number() OVER (ORDER BY 'article:' || doc_id) AS pos FROM documents)"""


def _fusions(trials: str) -> str:
    """CTEs for a table of trials: h5 (hybrid lists), g5 (graph lists), m5 (both), of trials(trial, sw, lw, k, hops, decay, gw)."""
    return f"""
t5 AS ({trials}),
u5 AS (SELECT trial, query_id, chunk_id, rank, 'vector' AS source, 0 AS l, sw / (k + rank) AS s FROM v5, t5 UNION ALL SELECT trial, query_id, chunk_id, rank, 'bm25', 1, lw / (k + rank) FROM b5, t5),
h5 AS (SELECT trial, query_id, chunk_id, score, source, row_number() OVER (PARTITION BY trial, query_id ORDER BY score DESC, met, chunk_id) AS rank FROM (SELECT trial, query_id, chunk_id, round(sum(s), 9) AS score, array_to_string(list_sort(list(DISTINCT source)), '+') AS source, min((l, rank)) AS met FROM u5 GROUP BY ALL)),
seed5 AS (SELECT h5.*, section, pos FROM h5 JOIN secs USING (chunk_id) WHERE rank <= {_K}),
w5 AS (SELECT trial, query_id, chunk_id, score, (rank, 0, 0::BIGINT) AS o FROM seed5
  UNION ALL SELECT s.trial, query_id, c.chunk_id, s.score * decay * decay, (s.rank, 2, c.pos) FROM seed5 s JOIN t5 USING (trial) JOIN secs c ON c.section = s.section AND c.chunk_id <> s.chunk_id WHERE hops >= 2),
g5 AS (SELECT trial, query_id, chunk_id, score, row_number() OVER (PARTITION BY trial, query_id ORDER BY score DESC, o, chunk_id) AS rank, row_number() OVER (PARTITION BY trial, query_id ORDER BY o, chunk_id) AS first_pos FROM (SELECT trial, query_id, chunk_id, round(greatest(max(score), 0), 9) AS score, min(o) AS o FROM w5 GROUP BY ALL)),
m5 AS (SELECT trial, query_id, chunk_id, score, source, row_number() OVER (PARTITION BY trial, query_id ORDER BY score DESC, hr NULLS LAST, first_pos NULLS LAST, chunk_id) AS rank
  FROM (SELECT trial, query_id, chunk_id, round((1 - gw) * coalesce(h.score, 0) + gw * coalesce(g.score, 0), 9) AS score, concat_ws('+', h.source, CASE WHEN g.score IS NOT NULL THEN 'graph' END) AS source, h.rank AS hr, g.first_pos FROM (SELECT * FROM h5 WHERE rank <= {_K}) h FULL JOIN g5 g USING (trial, query_id, chunk_id) JOIN t5 USING (trial)))"""


_FIVE = f"""WITH {_BM25}, {_RELEVANT}, {_PARTS}, {_fusions("SELECT 0 AS trial, 1.0::DOUBLE AS sw, 1.0::DOUBLE AS lw, 60.0::DOUBLE AS k, 2 AS hops, 0.65::DOUBLE AS decay, 0.2::DOUBLE AS gw")},
five AS (SELECT 'bm25' AS method, query_id, chunk_id, score, 'bm25' AS source, rank FROM b5 UNION ALL SELECT 'vector', query_id, chunk_id, score, 'vector', rank FROM v5 UNION ALL SELECT 'hybrid', query_id, chunk_id, score, source, rank FROM h5
UNION ALL SELECT 'graph', query_id, chunk_id, score, 'graph', rank FROM g5 UNION ALL SELECT 'hybrid+graph', query_id, chunk_id, score, source, rank FROM m5)"""
_P = plans.Parameters(candidate_k=_K)


def _summarised(ranked: str, by: str) -> str:
    """SELECT: the summary of ranked (by, query_id, chunk_id, rank)."""
    n = ", ".join(f"count(*) FILTER (rank <= {k}) AS n{k}" for k in KS)
    mrr = lambda k: f"CASE WHEN first <= {k} THEN 1 / first ELSE 0 END"
    return f"""SELECT {by}, count(*)::BIGINT AS n_queries, count(*) FILTER (coalesce(n10, 0) = 0)::BIGINT AS n_miss, {", ".join(f"round(avg(coalesce(n{k} / n_rel, 0)), 6) AS recall_{k}, round(avg(coalesce(n{k}, 0) / {k}.0::DOUBLE), 6) AS precision_{k}, round(avg((coalesce(n{k}, 0) > 0)::INT), 6) AS hit_{k}, round(avg({mrr(k)}), 6) AS mrr_{k}" for k in KS)},
  round(({' + '.join(f"avg(coalesce(n{k} / n_rel, 0)) + avg({mrr(k)})" for k in KS)}) / {2 * len(KS)}, 6) AS objective
  FROM (SELECT DISTINCT {by} FROM {ranked}) CROSS JOIN q5 LEFT JOIN (SELECT query_id, count(*) AS n_rel FROM rel5 GROUP BY query_id) USING (query_id)
  LEFT JOIN (SELECT {by}, query_id, {n}, min(rank) AS first FROM (SELECT {by}, query_id, chunk_id, rank FROM {ranked} SEMI JOIN rel5 USING (query_id, chunk_id) WHERE rank <= 10) GROUP BY ALL) USING ({by}, query_id) GROUP BY {by}"""


@query(f"{_FIVE} SELECT method, query_id, chunk_id, score, source, rank FROM five WHERE rank <= 10")
def five_method_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best chunks by each method."""
    index, queries, _ = _setup(spark, d)
    found = [plans.search(index, queries, m, 10, _P).withColumn("method", F.lit(m)) for m in plans.METHODS]
    return reduce(DataFrame.unionByName, found).select("method", "query_id", "chunk_id", "score", "source", F.col("rank").cast("long").alias("rank"))


@query(f"{_FIVE} SELECT *, 0::BIGINT AS mapped_zero, 0::BIGINT AS graph_zero FROM ({_summarised('five', 'method')})")
def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Five methods side by side."""
    index, queries, relevant = _setup(spark, d)
    return plans.compare(index, queries, relevant, KS, dict.fromkeys(plans.METHODS, _P))[0]


def _trial_rows(stage: str) -> str:
    """Trials of a stage; where it doesn't set the hybrid's parameters, they are the best ones'."""
    own = plans.GRIDS[stage]
    if stage == "hybrid":
        return "VALUES " + ", ".join(f"({t['trial']}, {t['semantic_weight']}::DOUBLE, {t['lexical_weight']}::DOUBLE, {t['rrf_k']}::DOUBLE, 2, 0.65::DOUBLE, 0.2::DOUBLE)" for t in own)
    values = ", ".join(f"({t['trial']}, {t['max_hops']}, {t['hop_decay']}::DOUBLE, {t.get('graph_weight', 0.2)}::DOUBLE)" for t in own)
    return f"SELECT x.trial, sw, lw, k, x.hops, x.decay, x.gw FROM (VALUES {values}) x(trial, hops, decay, gw), best0"


def _renamed(ctes: str, tail: str) -> str:
    """The CTEs of ``_fusions`` under names of their own."""
    for name in ("t5", "u5", "h5", "seed5", "w5", "g5", "m5"):
        ctes = re.sub(rf"\b{name}\b", name + tail, ctes)
    return ctes


_HYBRID_TRIALS = _renamed(_fusions(f"SELECT * FROM ({_trial_rows('hybrid')}) x(trial, sw, lw, k, hops, decay, gw)"), "a")


@query(f"""WITH {_BM25}, {_RELEVANT}, {_PARTS}, {_HYBRID_TRIALS}, sa AS ({_summarised('h5a', 'trial')}),
best0 AS (SELECT sw, lw, k FROM t5a JOIN sa USING (trial) ORDER BY objective DESC, trial LIMIT 1),
{_renamed(_fusions(_trial_rows('graph')), 'b')}, {_renamed(_fusions(_trial_rows('hybrid+graph')), 'c')}
SELECT 'hybrid' AS stage, * FROM sa UNION ALL SELECT 'graph', * FROM ({_summarised('g5b', 'trial')}) UNION ALL SELECT 'hybrid+graph', * FROM ({_summarised('m5c', 'trial')})""")
def tuning_trials(spark: SparkSession, d: str) -> DataFrame:
    """27 hybrid, 6 graph and 18 hybrid+graph trials; the graph's start from the best hybrid ones."""
    index, queries, relevant = _setup(spark, d)
    return plans.tune(index, queries, relevant, KS, _P)[0]
