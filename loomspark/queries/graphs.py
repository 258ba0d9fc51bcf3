"""Queries of graph building, expansion and viewing: regions, nations and customers as hierarchy, part-supplier pairs as links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import expand, fusion, graph
from loomspark.sources.io import read_table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, f"{d}/{name}.parquet")


def _hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, relationship): region > nation > customer, and nation > supplier."""
    name = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    n, c, s = _t(spark, d, "nation"), _t(spark, d, "customer"), _t(spark, d, "supplier")
    return n.select(name("region", "n_regionkey").alias("source"), name("nation", "n_nationkey").alias("target"), F.lit("HAS_NATION").alias("relationship")).union(c.select(name("nation", "c_nationkey"), name("customer", "c_custkey"), F.lit("HAS_CUSTOMER"))).union(s.select(name("nation", "s_nationkey"), name("supplier", "s_suppkey"), F.lit("HAS_SUPPLIER")))


_H = "h AS (SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'HAS_NATION' AS relationship FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'HAS_CUSTOMER' FROM customer UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'HAS_SUPPLIER' FROM supplier)"


def _links(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, relationship): a row for each line item, from part to supplier by return flag."""
    return _t(spark, d, "lineitem").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("target"), F.concat(F.lit("SUPPLIED_"), F.col("l_returnflag")).alias("relationship"), "l_orderkey", "l_linenumber", "l_linestatus")


_L = "l AS (SELECT 'part:' || l_partkey AS source, 'supplier:' || l_suppkey AS target, 'SUPPLIED_' || l_returnflag AS relationship, l_orderkey, l_linenumber, l_linestatus FROM lineitem)"


@query(f"WITH {_H} SELECT 'edge:' || substr(sha1(source || chr(31) || target || chr(31) || relationship), 1, 20) AS edge_id, source, target, relationship FROM (SELECT DISTINCT * FROM h)")
def hierarchy_edges(spark: SparkSession, d: str) -> DataFrame:
    """G6, G11, T19."""
    e = _hierarchy(spark, d).distinct().withColumns({"edge_type": F.lit("HIERARCHY"), "reference_count": F.lit(1).cast("long")})
    return graph.with_edge_ids(e).select("edge_id", "source", "target", "relationship")


_N = "n AS (SELECT n_nationkey AS k, n_regionkey::VARCHAR AS d, 'Chương ' || (n_nationkey % 3 + 1) AS chapter, n_name FROM nation)"
_NID = "'{}:' || substr(sha1(array_to_string([d, {}], chr(31))), 1, 20)"


@query(f"""WITH {_N}, x AS (SELECT *, {_NID.format('part', "'__NO_PART__'")} AS p, {_NID.format('chapter', "'__NO_PART__', chapter")} AS c, {_NID.format('section', "'__NO_PART__', chapter, '__NO_SECTION__'")} AS s FROM n)
SELECT DISTINCT p AS node_id, 'part' AS node_type, 'Không có Phần' AS label, 'doc:' || d AS parent_node_id, true AS is_virtual FROM x UNION SELECT c, 'chapter', chapter, p, false FROM x UNION SELECT s, 'section', 'Không có Mục', c, true FROM x""")
def hierarchy_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Regions as documents, nations as their articles."""
    n = _t(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("document_id"), F.lit(None).cast("string").alias("part"), F.concat(F.lit("Chương  "), (F.col("n_nationkey") % 3 + 1).cast("string")).alias("chapter"), F.col("n_name").alias("section"), F.concat(F.lit("Điều "), F.col("n_nationkey").cast("string"), F.lit(". "), F.col("n_name")).alias("articles"), F.col("n_nationkey").alias("chunk_ord"))
    return graph.level_nodes(graph.article_rows(n)).select("node_id", "node_type", "label", "parent_node_id", "is_virtual")


@query("SELECT 'doc:' || c_nationkey AS node_id, arg_min(c_mktsegment, c_custkey) FILTER (c_custkey % 3 > 0) AS title, arg_min(c_name, c_custkey) FILTER (c_custkey % 5 = 4) AS url FROM customer GROUP BY c_nationkey")
def document_nodes_first_nonblank(spark: SparkSession, d: str) -> DataFrame:
    """Nations as documents, customers as their chunks; an attribute is the first value that isn't blank."""
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("document_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise(" ").alias("title"), F.when(F.col("c_custkey") % 5 == 4, F.col("c_name")).alias("url"), F.col("c_custkey").alias("chunk_ord"))
    return graph.document_nodes(c).select("node_id", "title", "url")


@query("SELECT c_custkey::VARCHAR AS node_id, CASE WHEN c_custkey % 3 = 0 THEN 'later' WHEN c_custkey % 2 = 0 THEN c_name ELSE 'later' END AS label, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment FROM customer")
def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    """First writes win, later ones fill what is missing."""
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    name = k.cast("string").alias("node_id")
    first = c.where("c_custkey % 3 > 0").select(name, F.when(k % 2 == 0, F.col("c_name")).otherwise(" ").alias("label"), F.col("c_mktsegment").alias("segment"))
    return graph.fill_missing(first, c.select(name, F.lit("later").alias("label")))


@query("""WITH u AS (SELECT upper(regexp_replace(b, '\\s', '', 'g')) AS number_key, count(*) AS n_documents, min('part:' || p_partkey) AS node_id FROM (SELECT *, CASE WHEN p_partkey % 10 = 0 THEN p_brand || '/' || p_partkey ELSE p_brand END AS b FROM part) GROUP BY 1),
x AS (SELECT upper(regexp_replace(CASE WHEN p_partkey % 10 = 0 THEN p_brand || '/' || p_partkey ELSE p_brand END, '\\s', '', 'g')) || CASE WHEN l_linenumber = 7 THEN '?' ELSE '' END AS number_key FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT CASE WHEN u.n_documents = 1 THEN 'internal' WHEN u.n_documents IS NULL THEN 'not_found' ELSE 'ambiguous' END AS resolution_status, CASE WHEN u.n_documents = 1 THEN u.node_id ELSE 'external_doc:' || substr(sha1(x.number_key), 1, 20) END AS target, count(*)::BIGINT AS n FROM x LEFT JOIN u USING (number_key) GROUP BY ALL""")
def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Numbers resolve to one document, none or several."""
    number = F.when(F.col("p_partkey") % 10 == 0, F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_brand"))
    p = _t(spark, d, "part").withColumn("number", number)
    docs = p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("number").alias("document_number"))
    x = _t(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(T.graph_number("number"), F.when(F.col("l_linenumber") == 7, "?").otherwise("")).alias("number_key"))
    return graph.with_targets(x, graph.number_index(docs)).groupBy("resolution_status", "target").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_L}, f AS (SELECT source, target, relationship, l_orderkey AS e, min((l_orderkey, l_linenumber)) AS o FROM l GROUP BY ALL)
SELECT source, target, relationship, any_value(n)::BIGINT AS reference_count, any_value(scopes) AS scopes, array_to_string((list(e::VARCHAR ORDER BY o))[1:10], ',') AS evidence
FROM f JOIN (SELECT source, target, relationship, count(*) AS n, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS scopes FROM l GROUP BY ALL) USING (source, target, relationship) GROUP BY source, target, relationship""")
def edge_aggregate_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Links gathered by ends and relationship, with counts, scopes and first evidence."""
    rows = _links(spark, d).select("source", "target", "relationship", F.col("l_linestatus").alias("scope"), F.concat(F.col("l_orderkey").cast("string")).alias("evidence"), F.lit("internal").alias("resolution_status"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("link_pos"))
    e = graph.link_edges(rows)
    return e.select("source", "target", "relationship", "reference_count", F.array_join("scopes", ",").alias("scopes"), F.array_join("evidence", ",").alias("evidence"))


@query(f"WITH {_H}, {_L}, e AS (SELECT source, target FROM h UNION ALL SELECT source, target FROM l), ids AS (SELECT 'region:' || r_regionkey AS node_id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'customer:' || c_custkey FROM customer) SELECT 'dangling_end' AS problem, node_id AS id FROM (SELECT source AS node_id FROM e UNION SELECT target FROM e) ANTI JOIN ids USING (node_id)")
def graph_validation(spark: SparkSession, d: str) -> DataFrame:
    """Parts aren't among the nodes, so all of them are dangling."""
    name = lambda t, p, c: _t(spark, d, t).select(F.concat(F.lit(p + ":"), F.col(c).cast("string")).alias("node_id"))
    nodes = name("region", "region", "r_regionkey").union(name("nation", "nation", "n_nationkey")).union(name("supplier", "supplier", "s_suppkey")).union(name("customer", "customer", "c_custkey"))
    edges = _hierarchy(spark, d).select("source", "target").union(_links(spark, d).select("source", "target"))
    return graph.validate(nodes, edges)


@query(f"WITH {_L} SELECT relationship, count(*)::BIGINT AS n FROM l GROUP BY relationship ORDER BY n DESC, relationship LIMIT 15")
def edge_relation_topn(spark: SparkSession, d: str) -> DataFrame:
    """G13, V3."""
    return expand.top_relations(_links(spark, d))


@query(f"WITH {_L} SELECT source, target, count(*)::BIGINT AS duplicate_count, array_to_string(list_sort(list(DISTINCT relationship)), ',') AS relationships FROM l GROUP BY ALL")
def merge_parallel_edges(spark: SparkSession, d: str) -> DataFrame:
    """V2."""
    return expand.merge_parallel(_links(spark, d)).withColumn("relationships", F.array_join("relationships", ","))


@query(f"WITH {_H}, e AS (SELECT source AS node FROM h UNION ALL SELECT target FROM h) SELECT node, count(*)::BIGINT AS degree FROM e GROUP BY node")
def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    """V5."""
    return expand.degrees(_hierarchy(spark, d))


@query(f"WITH {_L}, m AS (SELECT source, target, count(*) AS c FROM l GROUP BY ALL), dg AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM m UNION ALL SELECT target FROM m) GROUP BY node) SELECT source, target, (a.degree + b.degree)::BIGINT AS weight, c::BIGINT AS duplicate_count FROM m JOIN dg a ON a.node = source JOIN dg b ON b.node = target ORDER BY weight DESC, duplicate_count DESC, source, target LIMIT 1800")
def cap_edges(spark: SparkSession, d: str) -> DataFrame:
    """V7: a top-N report."""
    return expand.cap_edges(expand.merge_parallel(_links(spark, d))).select("source", "target", "weight", "duplicate_count")


@query("SELECT 'part:' || p_partkey AS node_id FROM part SEMI JOIN lineitem ON p_partkey = l_partkey")
def nodes_with_edges(spark: SparkSession, d: str) -> DataFrame:
    """V8."""
    return expand.with_edges(_t(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node_id")), _links(spark, d))


@query(f"WITH {_L}, n AS (SELECT 'part:' || p_partkey AS node_id FROM part), e AS (SELECT source AS node_id FROM l UNION SELECT target FROM l) SELECT (SELECT count(*) FROM n)::BIGINT AS n_nodes, (SELECT count(*) FROM e)::BIGINT AS n_ends, (SELECT count(*) FROM n SEMI JOIN e USING (node_id))::BIGINT AS n_both, (SELECT count(*) FROM n ANTI JOIN e USING (node_id))::BIGINT AS n_isolated, (SELECT count(*) FROM e ANTI JOIN n USING (node_id))::BIGINT AS n_dangling")
def id_consistency(spark: SparkSession, d: str) -> DataFrame:
    """V1."""
    return expand.id_report(_t(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node_id")), _links(spark, d))


@query(f"WITH RECURSIVE {_H}, e AS (SELECT source AS a, target AS b FROM h UNION SELECT target, source FROM h), w(node, label) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, w.label FROM w JOIN e ON e.a = w.node WHERE w.label < e.b) SELECT node, min(label) AS label FROM w GROUP BY node")
def wcc_labels(spark: SparkSession, d: str) -> DataFrame:
    """V4."""
    return expand.component_labels(_hierarchy(spark, d))


@query(f"WITH {_H}, d AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM h UNION ALL SELECT target FROM h) GROUP BY node) SELECT node, round(least(42, greatest(12, 11 + 3 * sqrt(degree))), 6) AS size FROM d")
def view_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes for drawing."""
    return expand.view_attributes(_hierarchy(spark, d), _hierarchy(spark, d))[0]


@query(f"WITH {_L}, e AS (SELECT source AS node_id FROM l UNION SELECT target FROM l), n AS (SELECT 'part:' || p_partkey AS node_id FROM part) SELECT node_id, false AS missing_metadata FROM n UNION ALL SELECT node_id, true FROM e ANTI JOIN n USING (node_id)")
def nodes_completed(spark: SparkSession, d: str) -> DataFrame:
    """V2: ends of edges that are no nodes become nodes without attributes."""
    return expand.all_nodes(_t(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node_id")), _links(spark, d))


@query(f"WITH {_H}, g AS (SELECT h.*, coalesce(n.n_regionkey, CASE WHEN starts_with(source, 'region:') THEN substr(source, 8)::INT END) AS region FROM h LEFT JOIN nation n ON source = 'nation:' || n_nationkey), b AS (SELECT region FROM g GROUP BY region ORDER BY count(*) DESC, least(min(source), min(target)) LIMIT 1) SELECT source, target, relationship FROM g SEMI JOIN b USING (region)")
def largest_component(spark: SparkSession, d: str) -> DataFrame:
    """V4: the component with most edges."""
    return expand.largest_component(_hierarchy(spark, d))


@query(f"WITH {_H}, e AS (SELECT source AS node FROM h UNION ALL SELECT target FROM h) SELECT node, count(*)::BIGINT AS degree FROM e GROUP BY node ORDER BY degree DESC, node LIMIT 1")
def view_seed(spark: SparkSession, d: str) -> DataFrame:
    """V5: the node of greatest degree."""
    return expand.seed_node(_hierarchy(spark, d))


@query(f"""WITH RECURSIVE {_H}, u AS (SELECT source AS a, target AS b FROM h UNION SELECT target, source FROM h), g AS (SELECT a AS node, count(*) AS degree FROM (SELECT source AS a FROM h UNION ALL SELECT target FROM h) GROUP BY a),
w(node, level) AS (SELECT 'nation:0', 0 UNION SELECT u.b, w.level + 1 FROM w JOIN u ON u.a = w.node WHERE w.level < 4), f AS (SELECT node, min(level) AS level FROM w GROUP BY node)
SELECT node, level::INT AS level FROM f JOIN g USING (node) ORDER BY level, degree DESC, node LIMIT 120""")
def view_selection(spark: SparkSession, d: str) -> DataFrame:
    """V6: the 120 nodes around a start, level by level."""
    return expand.select_around(_hierarchy(spark, d), "nation:0", 120)


@query(f"WITH {_L} SELECT source, target, round(least(8, 1.8::DOUBLE + log2(count(*))), 6) AS width FROM l GROUP BY ALL")
def view_widths(spark: SparkSession, d: str) -> DataFrame:
    """Widths for drawing."""
    return expand.view_attributes(_hierarchy(spark, d), _links(spark, d))[1]


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds, chunks of nodes, edges). Seeds: customers, one query a market segment, by balance; chunks stand behind customers and suppliers."""
    h = _hierarchy(spark, d).distinct()
    edges = graph.with_positions(h.withColumn("k", T.stable_id("edge", "source", "target")), ["relationship", "source", "target"], "edge_pos", "k").withColumn("reference_count", F.lit(1))
    nodes = h.select(F.col("target").alias("node_id")).where("node_id like 'customer:%' or node_id like 'supplier:%'").withColumns({"source_chunk_ids": F.array(F.concat(F.lit("chunk-"), F.col("node_id"))), "node_pos": F.lit(0).cast("long")})
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    seeds = _t(spark, d, "customer").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select(F.col("c_mktsegment").alias("query_id"), F.concat(F.lit("chunk-customer:"), F.col("c_custkey").cast("string")).alias("chunk_id"), (1.0 / F.col("rank")).alias("score"), "rank")
    return seeds, expand.chunk_nodes(nodes), edges


def _expansion(spark: SparkSession, d: str, direction: str) -> DataFrame:
    seeds, mapping, edges = _parts(spark, d)
    return expand.expand(seeds, mapping, expand.adjacency(edges, direction), 2, 0.65).select("query_id", "chunk_id", "score")


_SEEDS = "s AS (SELECT c_mktsegment AS query_id, c_custkey, c_nationkey, 1.0::DOUBLE / row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS score FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 5)"


@query(f"WITH {_SEEDS}, x AS (SELECT query_id, 'chunk-customer:' || c_custkey AS chunk_id, score FROM s UNION ALL SELECT query_id, 'chunk-customer:' || c.c_custkey, score * 0.65::DOUBLE * 0.65::DOUBLE FROM s JOIN customer c ON c.c_nationkey = s.c_nationkey AND c.c_custkey <> s.c_custkey UNION ALL SELECT query_id, 'chunk-supplier:' || s_suppkey, score * 0.65::DOUBLE * 0.65::DOUBLE FROM s JOIN supplier ON s_nationkey = s.c_nationkey) SELECT query_id, chunk_id, round(max(score), 9) AS score FROM x GROUP BY ALL")
def graph_expand_2hop(spark: SparkSession, d: str) -> DataFrame:
    """Two hops reach the siblings."""
    return _expansion(spark, d, "both")


@query(f"WITH {_SEEDS}, x AS (SELECT query_id, c.c_custkey::VARCHAR AS id FROM s JOIN customer c USING (c_nationkey) UNION SELECT query_id, 's' || s_suppkey FROM s JOIN supplier ON s_nationkey = s.c_nationkey), n AS (SELECT query_id, count(*) AS n FROM x GROUP BY query_id) SELECT query_id, 6::BIGINT AS n_seeds, 5::BIGINT AS n_mapped, n::BIGINT AS n_results, false AS mapped_zero, false AS graph_result_zero FROM n UNION ALL SELECT 'none', 1, 0, 0, true, true")
def expansion_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What of the seeds is in the graph; each query has a seed that isn't, and one has no other."""
    seeds, mapping, edges = _parts(spark, d)
    asked = seeds.select("query_id").distinct().union(spark.createDataFrame([("none",)], "query_id string"))
    seeds = seeds.unionByName(asked.select("query_id", F.lit("nowhere").alias("chunk_id"), F.lit(0.1).alias("score"), F.lit(9).cast("long").alias("rank")))
    return fusion.expansion_diagnostics(seeds, mapping, expand.expand(seeds, mapping, expand.adjacency(edges), 2, 0.65))


@query(f"WITH {_SEEDS} SELECT query_id, 'chunk-customer:' || c_custkey AS chunk_id, round(score, 9) AS score FROM s")
def graph_expand_out(spark: SparkSession, d: str) -> DataFrame:
    """Outward, leaves reach nothing."""
    return _expansion(spark, d, "out")
