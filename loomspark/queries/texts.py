"""Queries of text functions, line windows, chunking and evidence."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import patterns as P
from loomspark.functions import text as T
from loomspark.operators import chunker, citations, evidence, graph, lexical
from loomspark.plans.tables import materialise
from loomspark.sources.io import read_table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, f"{d}/documents.parquet")


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ([,.;:!?])', '\1', 'g')) AS flat FROM documents")
def text_flatten(spark: SparkSession, d: str) -> DataFrame:
    """T2."""
    return _docs(spark, d).select("doc_id", T.flatten("text").alias("flat"))


@query(r"SELECT doc_id, trim(regexp_replace(array_to_string([trim(regexp_replace(x, '[ \t]+', ' ', 'g')) FOR x IN string_split(coalesce(text, ''), chr(10))], chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS norm FROM documents")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    """T1."""
    return _docs(spark, d).select("doc_id", T.normalize_text("text").alias("norm"))


@query(r"""WITH l AS (SELECT doc_id, [trim(x) FOR x IN string_split(coalesce(text, ''), chr(10)) IF trim(x) <> ''] AS ls FROM documents),
r AS (SELECT doc_id, [CASE WHEN contains(x, '|') THEN array_to_string([trim(c) FOR c IN regexp_split_to_array(x, '\|+') IF trim(c) <> '' AND NOT regexp_full_match(trim(c), '[-:\s]+')], '; ') ELSE trim(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), ' ([,.;:!?])', '\1', 'g')) END FOR x IN ls] AS rs FROM l)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string([x FOR x IN rs IF x <> ''], '. '), '\s+', ' ', 'g'), '(?:;\s*){2,}', '; ', 'g'), '\s+([,.;:!?])', '\1', 'g'), '\.{2,}', '.', 'g'), ' .') AS cleaned FROM r""")
def table_clean(spark: SparkSession, d: str) -> DataFrame:
    """T3."""
    return _docs(spark, d).select("doc_id", T.clean_table("text").alias("cleaned"))


@query(r"SELECT p_partkey, lower(trim(regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS safe FROM part")
def safe_ids(spark: SparkSession, d: str) -> DataFrame:
    """T9."""
    return read_table(spark, f"{d}/part.parquet").select("p_partkey", T.safe_id(F.concat("p_name", F.lit(" "), "p_brand")).alias("safe"))


@query(r"SELECT p_partkey, nullif(regexp_replace(replace(upper(p_brand || ' / 20 – ' || p_type), '–', '-'), '\s', '', 'g'), '') AS chunk_number, regexp_replace(upper(p_brand || ' / 20 – ' || p_type), '\s', '', 'g') AS graph_number FROM part")
def document_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The two normal forms differ in dashes."""
    raw = F.concat("p_brand", F.lit(" / 20 – "), "p_type")
    return read_table(spark, f"{d}/part.parquet").select("p_partkey", T.document_number(raw).alias("chunk_number"), T.graph_number(raw).alias("graph_number"))


@query(r"SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (length(x) <= 250 AND len(regexp_extract_all(x, '\p{L}')) > 0 AND len(regexp_extract_all(x, '\p{Lu}')) >= 0.7::DOUBLE * len(regexp_extract_all(x, '\p{L}')))::BIGINT AS n_titles FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents) GROUP BY doc_id")
def title_lines(spark: SparkSession, d: str) -> DataFrame:
    """T10."""
    x = _docs(spark, d).select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("x"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(T.looks_like_title("x")).alias("n_titles"))


@query("SELECT c_custkey, lower(trim(c_mktsegment)) AS sector, contains(lower(trim(c_mktsegment)), 'build') AS matches FROM customer")
def sector_match(spark: SparkSession, d: str) -> DataFrame:
    """T6, T7, C1."""
    return read_table(spark, f"{d}/customer.parquet").select("c_custkey", T.normalize_sector("c_mktsegment").alias("sector"), T.sector_matches(F.array("c_mktsegment"), " Build ").alias("matches"))


@query(r"SELECT conv_id, turn, upper(role) AS x, coalesce(nullif(trim(regexp_replace(upper(role || ' / ' || conv_id), '[^A-Z0-9_]+', '_', 'g'), '_'), ''), 'REFERS_TO') AS relation, 'turn:' || substr(sha1(conv_id || chr(31) || turn || chr(31) || role), 1, 20) AS id FROM conversations")
def relation_names(spark: SparkSession, d: str) -> DataFrame:
    """T18, T19."""
    c = read_table(spark, f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", F.upper("role").alias("x"), T.relation(F.concat("role", F.lit(" / "), F.col("conv_id").cast("string"))).alias("relation"), T.stable_id("turn", "conv_id", "turn", "role").alias("id"))


@query(r"SELECT c_custkey, concat_ws(chr(10), 'Region: ' || r_name, 'Nation: ' || n_name, CASE WHEN trim(c_mktsegment) <> '' THEN 'Segment: ' || trim(c_mktsegment) END, 'Nội dung:' || chr(10) || c_name) AS context FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def contextual_text(spark: SparkSession, d: str) -> DataFrame:
    """T23-T25."""
    t = lambda n: read_table(spark, f"{d}/{n}.parquet")
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select("c_custkey", T.contextual_text({"r_name": "Region", "n_name": "Nation", "c_mktsegment": "Segment"}, "c_name").alias("context"))


@query("SELECT page_id, CASE WHEN length(coalesce(url, '')) > 30 THEN substr(url, 1, 27) || '...' ELSE coalesce(url, '') END AS label, replace(replace(replace(replace(replace(coalesce(url, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    """T31."""
    return read_table(spark, f"{d}/pages.parquet").select("page_id", T.short_label("url", 30).alias("label"), T.html_escape("url").alias("escaped"))


@query(r"""WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, CASE WHEN length(x) - length(replace(x, '|', '')) >= 2 THEN 'table' ELSE 'text' END AS kind FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) WHERE trim(x) <> ''),
c AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS change FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, sum(change) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM c)
SELECT doc_id, block::BIGINT AS block, kind, count(*)::BIGINT AS n_lines FROM b GROUP BY ALL""")
def line_blocks_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of table lines and of text lines."""
    x = _docs(spark, d).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "x")).where("trim(x) <> ''")
    return chunker.islands(x.withColumn("kind", chunker.line_kind("x")), ["doc_id"], "i", "kind").groupBy("doc_id", "block", "kind").agg(F.count(F.lit(1)).alias("n_lines"))


@query(r"""WITH l AS (SELECT doc_id, i, x, regexp_matches(x, '^[EIO]') AS head FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents) WHERE trim(x) <> ''),
c AS (SELECT doc_id, i, sum(head::INT) OVER w AS no, last_value(CASE WHEN head THEN i END IGNORE NULLS) OVER w AS head_at FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, no::BIGINT AS no, head_at::BIGINT AS head_at, count(*)::BIGINT AS n_lines FROM c GROUP BY ALL""")
def heading_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """A heading is in force until the next; here lines that begin with E, I or O."""
    x = _docs(spark, d).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "x")).where("trim(x) <> ''")
    x = chunker.carried(x, ["doc_id"], "i", F.col("x").rlike("^[EIO]"), F.col("i").cast("long"))
    return x.groupBy("doc_id", "no", F.col("head_value").alias("head_at")).agg(F.count(F.lit(1)).alias("n_lines"))


def legal_documents(spark: SparkSession, d: str) -> DataFrame:
    """A legal document around each document's lines: header, two articles, signatures and an appendix with a table."""
    n = F.col("doc_id").cast("string")
    flat = T.flatten("text")
    number = F.concat(n, F.lit("/2025/NĐ-CP"))
    text = F.concat(F.lit("NGHỊ ĐỊNH\nCăn cứ Luật số "), (F.col("doc_id") + 1).cast("string"), F.lit("/2019/QH14;\nCHƯƠNG I\nQUY ĐỊNH CHUNG\nĐiều 1. Phạm vi điều chỉnh\nNghị định này quy định theo khoản 2 Điều 3 và Nghị định số "), (F.col("doc_id") + 1).cast("string"), F.lit("/2025/NĐ-CP. "), flat, F.lit("\nĐiều 2. Hiệu lực thi hành\nNghị định số "), (F.col("doc_id") + 2).cast("string"), F.lit("/2025/NĐ-CP hết hiệu lực kể từ ngày Nghị định này có hiệu lực thi hành.\nNơi nhận: - Như trên;\nPHỤ LỤC I\nBiểu mức\n| Cấp | Mức |\n| Một | "), n, F.lit(" |"))
    return _docs(spark, d).select(F.col("doc_id").alias("document_id"), number.alias("document_number"), F.col("source").alias("title"), text.alias("content"))


@query(r"SELECT doc_id AS document_id, 4::BIGINT AS n_chunks, doc_id || '_dieu_1_0001' AS first_id, 4::BIGINT AS n_links FROM documents")
def chunk_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles, an appendix text and a table from generated legal text, with their links."""
    c = chunker.chunk(legal_documents(spark, d))
    return c.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.min_by("id", "chunk_ord").alias("first_id"), F.sum(F.size("link_to")).alias("n_links"))


@query(r"""SELECT doc_id AS document_id, 'REFERS_TO' AS relationship, (doc_id + 1) || '/2025/NĐ-CP' AS document_number, NULL AS article, NULL AS clause, 'article' AS scope FROM documents
UNION ALL SELECT doc_id, 'REFERS_TO', doc_id || '/2025/NĐ-CP', '3', '2', 'article' FROM documents
UNION ALL SELECT doc_id, 'REPEALS', (doc_id + 2) || '/2025/NĐ-CP', NULL, NULL, 'article' FROM documents
UNION ALL SELECT doc_id, 'BASED_ON', (doc_id + 1) || '/2019/QH14', NULL, NULL, 'document_header' FROM documents""")
def citation_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of generated legal text."""
    links = chunker.chunk(legal_documents(spark, d)).select("document_id", F.explode("link_to").alias("x"))
    return links.select("document_id", "x.relationship", "x.document_number", "x.article", "x.clause", "x.scope")


def legal_chunks(spark: SparkSession, d: str) -> DataFrame:
    return materialise(chunker.chunk(legal_documents(spark, d)), "chunks")


_CHAPTER = "CHƯƠNG I: QUY ĐỊNH CHUNG"
_SHA = "substr(sha1(array_to_string([{}], chr(31))), 1, 20)"
_PATHS = {"part": "d::VARCHAR, '__NO_PART__'", "chapter": f"d::VARCHAR, '__NO_PART__', '{_CHAPTER}'", "section": f"d::VARCHAR, '__NO_PART__', '{_CHAPTER}', '__NO_SECTION__'"}
_PATHS |= {f"article{i}": f"{_PATHS['section']}, '{i}'" for i in (1, 2)}
_ID = {k: f"'{k.rstrip('12')}:' || {_SHA.format(v)}" for k, v in _PATHS.items()}
#: The graph of ``legal_documents``: nodes and edges.
LEGAL = f"""
ds AS (SELECT doc_id AS d, doc_id || '/2025/NĐ-CP' AS number, trim(regexp_replace(source, '\\s+', ' ', 'g')) AS title FROM documents),
ls AS (SELECT d, (d + 1) || '/2019/QH14' AS number, 'BASED_ON' AS relationship FROM ds UNION ALL SELECT d, (d + 1) || '/2025/NĐ-CP', 'REFERS_TO' FROM ds UNION ALL SELECT d, (d + 2) || '/2025/NĐ-CP', 'REPEALS' FROM ds),
rs AS (SELECT ls.d, ls.number, ls.relationship, CASE WHEN ds.d IS NULL THEN 'not_found' ELSE 'internal' END AS resolution_status, CASE WHEN ds.d IS NULL THEN 'external_doc:' || substr(sha1(ls.number), 1, 20) ELSE 'doc:' || ds.d END AS target FROM ls LEFT JOIN ds USING (number)),
nodes AS (SELECT 'doc:' || d AS node_id, 'document' AS node_type, title AS label, d AS document_id, number AS document_number, '' AS parent_node_id, false AS is_virtual, 'internal' AS resolution_status FROM ds
UNION ALL SELECT {_ID['part']}, 'part', 'Không có Phần', d, number, 'doc:' || d, true, 'internal' FROM ds
UNION ALL SELECT {_ID['chapter']}, 'chapter', '{_CHAPTER}', d, number, {_ID['part']}, false, 'internal' FROM ds
UNION ALL SELECT {_ID['section']}, 'section', 'Không có Mục', d, number, {_ID['chapter']}, true, 'internal' FROM ds
UNION ALL SELECT {_ID['article1']}, 'article', 'Điều 1. Phạm vi điều chỉnh', d, number, {_ID['section']}, false, 'internal' FROM ds
UNION ALL SELECT {_ID['article2']}, 'article', 'Điều 2. Hiệu lực thi hành', d, number, {_ID['section']}, false, 'internal' FROM ds
UNION ALL SELECT DISTINCT target, 'external_document', number, NULL, number, '', false, resolution_status FROM rs WHERE resolution_status <> 'internal'),
es AS (SELECT 'doc:' || d AS source, {_ID['part']} AS target, 'HIERARCHY' AS edge_type, 'CONTAINS_PART' AS relationship, 1::BIGINT AS reference_count, 'internal' AS resolution_status, '' AS scopes FROM ds
UNION ALL SELECT {_ID['part']}, {_ID['chapter']}, 'HIERARCHY', 'CONTAINS_CHAPTER', 1, 'internal', '' FROM ds
UNION ALL SELECT {_ID['chapter']}, {_ID['section']}, 'HIERARCHY', 'CONTAINS_SECTION', 1, 'internal', '' FROM ds
UNION ALL SELECT {_ID['section']}, {_ID['article1']}, 'HIERARCHY', 'CONTAINS_ARTICLE', 1, 'internal', '' FROM ds
UNION ALL SELECT {_ID['section']}, {_ID['article2']}, 'HIERARCHY', 'CONTAINS_ARTICLE', 1, 'internal', '' FROM ds
UNION ALL SELECT 'doc:' || d, target, 'DOCUMENT_LINK', relationship, 1, resolution_status, CASE WHEN relationship = 'BASED_ON' THEN 'document_header' ELSE 'article' END FROM rs),
edges AS (SELECT 'edge:' || substr(sha1(source || chr(31) || target || chr(31) || relationship), 1, 20) AS edge_id, * FROM es)"""


@query(f"WITH {LEGAL} SELECT *, row_number() OVER (ORDER BY node_type, document_id NULLS LAST, node_id) - 1 AS node_pos FROM nodes")
def legal_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """G1-G5, G7, G8, G10 on generated legal text."""
    return graph.build_nodes(legal_chunks(spark, d)).select("node_id", "node_type", "label", "document_id", "document_number", "parent_node_id", "is_virtual", "resolution_status", F.col("node_pos").cast("long").alias("node_pos"))


@query(f"WITH {LEGAL} SELECT *, row_number() OVER (ORDER BY edge_type, relationship, source, target) - 1 AS edge_pos FROM edges")
def legal_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """G6, G8, G9, G11, T22 on generated legal text."""
    e = graph.build_edges(legal_chunks(spark, d))
    return e.select("edge_id", "source", "target", "edge_type", "relationship", "reference_count", "resolution_status", F.array_join("scopes", ",").alias("scopes"), F.col("edge_pos").cast("long").alias("edge_pos"))


@query("SELECT doc_id AS document_id, 'REPEALS' AS relationship, (doc_id + 2) || '/2025/NĐ-CP' AS document_number FROM documents")
def document_relationships(spark: SparkSession, d: str) -> DataFrame:
    """T13."""
    return citations.document_relationships(legal_documents(spark, d))


_BODY = "Nội dung của điều này dài hơn năm mươi ký tự để được giữ lại "


def structured_documents(spark: SparkSession, d: str) -> DataFrame:
    """A legal document for each customer: two parts, chapters with titles on the line below, a section, a short article, and two appendices."""
    n = F.col("c_custkey").cast("string")
    t = lambda x: F.lit(x)
    text = F.concat(t("PHẦN THỨ NHẤT\nNHỮNG QUY ĐỊNH CHUNG\nCHƯƠNG I\nPHẠM VI\nMỤC 1. Áp dụng\nĐiều 1. Một\n" + _BODY), n, t(".\nCHƯƠNG II\nHAI LÀ\nĐiều 2a. Hai\n" + _BODY), n, t("; xem điểm b khoản 1 và khoản 3 Điều 1.\nPHẦN THỨ HAI. Phần sau\nĐiều 3\n| Cột | "), n, t(" |\n|---|---|\n| " + _BODY + "| hai |\nĐiều 4. Ngắn\nNơi nhận: - Như trên;\nPHỤ LỤC I\nBiểu một\n| A | "), n, t(" |\n| B | C |\nPHỤ LỤC II\nHai dòng chữ\nthường"))
    # Few bytes, but much work a byte: keys are spread over all cores, which the size of the file alone would not ask for.
    keys = read_table(spark, f"{d}/customer.parquet").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism)
    return keys.select(F.col("c_custkey").alias("document_id"), F.concat(n, F.lit("/2024/TT-BTC")).alias("document_number"), text.alias("content"))


@query(f"""WITH c AS (SELECT c_custkey AS d, c_custkey::VARCHAR AS n FROM customer), one AS (SELECT 'PHẦN THỨ NHẤT: NHỮNG QUY ĐỊNH CHUNG' AS p1, 'PHẦN THỨ HAI. Phần sau' AS p2),
r AS (SELECT d, n || '_dieu_1_0001' AS id, p1 AS part, 'CHƯƠNG I: PHẠM VI' AS chapter, 'MỤC 1. Áp dụng' AS section, 'Điều 1. Một' AS articles, 'Điều 1. Một {_BODY}' || n || '.' AS content, '' AS links FROM c, one
UNION ALL SELECT d, n || '_dieu_2a_0002', p1, 'CHƯƠNG II: HAI LÀ', NULL, 'Điều 2a. Hai', 'Điều 2a. Hai {_BODY}' || n || '; xem điểm b khoản 1 và khoản 3 Điều 1.', '1/1/b;1/3/b' FROM c, one
UNION ALL SELECT d, n || '_dieu_3_0003', p2, NULL, NULL, 'Điều 3', 'Điều 3. Cột; ' || n || '. {_BODY.strip()}; hai', '' FROM c, one
UNION ALL SELECT d, n || '_phu_luc_0001_01', p2, NULL, NULL, 'PHỤ LỤC - Nội dung phụ lục 1', 'PHỤ LỤC I Biểu một', '' FROM c, one
UNION ALL SELECT d, n || '_bang_0001_01', p2, NULL, NULL, 'PHỤ LỤC - Bảng 1', 'A; ' || n || '. B; C', '' FROM c, one
UNION ALL SELECT d, n || '_phu_luc_0002_01', p2, NULL, NULL, 'PHỤ LỤC II - Nội dung phụ lục 2', 'PHỤ LỤC II Hai dòng chữ thường', '' FROM c, one)
SELECT d AS document_id, id, part, chapter, section, articles, content, links FROM r""")
def chunk_structure(spark: SparkSession, d: str) -> DataFrame:
    """Headings reset each other, titles come from the line below, short articles go, appendices are counted across the document."""
    c = chunker.chunk(structured_documents(spark, d))
    links = F.array_join(F.transform("link_to", lambda x: F.concat_ws("/", x["article"], x["clause"], x["point"])), ";")
    return c.select("document_id", "id", "part", "chapter", "section", "articles", "content", links.alias("links"))


@query("SELECT count(*)::BIGINT AS n_chunks, min(length(text))::INT AS min_chars, max(length(text))::INT AS max_chars, round(avg(length(text)), 2) AS avg_chars, count(DISTINCT source)::BIGINT AS n_documents FROM documents")
def chunk_statistics(spark: SparkSession, d: str) -> DataFrame:
    """S22."""
    c = _docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.col("source").alias("document_id"))
    return chunker.chunk_statistics(c).select("n_chunks", "min_chars", "max_chars", "avg_chars", "n_documents")


@query(r"""WITH RECURSIVE f AS (SELECT doc_id, nfc_normalize(trim(regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ([,.;:!?])', '\1', 'g'))) AS t FROM documents),
s0 AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM (SELECT doc_id, string_split(regexp_replace(t, '([.;!?])\s+', '\1' || chr(10), 'g'), chr(10)) AS p FROM f WHERE length(t) > 300)),
k(doc_id, i, j, piece, rest, fresh) AS (SELECT doc_id, i, 0, NULL::VARCHAR, trim(x), length(trim(x)) > 300 FROM s0 WHERE trim(x) <> ''
  UNION ALL SELECT doc_id, i, j + 1, CASE WHEN length(rest) <= 300 THEN rest ELSE trim(left(rest, cut)) END, CASE WHEN length(rest) <= 300 THEN NULL ELSE trim(substr(rest, cut + 1)) END, fresh
  FROM (SELECT *, CASE WHEN strpos(reverse(left(rest, 301)), ' ') BETWEEN 1 AND 300 THEN 301 - strpos(reverse(left(rest, 301)), ' ') ELSE 300 END AS cut FROM k WHERE rest IS NOT NULL)),
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n, piece, fresh FROM k WHERE piece IS NOT NULL),
g(doc_id, n, held, done) AS (SELECT doc_id, 0::BIGINT, ''::VARCHAR, NULL::VARCHAR FROM (SELECT DISTINCT doc_id FROM s)
  UNION ALL SELECT s.doc_id, s.n, CASE WHEN ok THEN held || ' ' || piece ELSE piece END, CASE WHEN ok OR held = '' THEN NULL ELSE held END
  FROM (SELECT s.doc_id, s.n, s.piece, g.held, g.held <> '' AND NOT s.fresh AND length(g.held) + 1 + length(s.piece) <= 300 AS ok FROM g JOIN s ON s.doc_id = g.doc_id AND s.n = g.n + 1) s),
o AS (SELECT doc_id, n, done AS piece FROM g WHERE done IS NOT NULL UNION ALL SELECT doc_id, n + 1, held FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r FROM g) WHERE r = 1 AND held <> '' UNION ALL SELECT doc_id, 0, t FROM f WHERE length(t) <= 300 AND t <> '')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS i, piece FROM o""")
def split_long_text_pieces(spark: SparkSession, d: str) -> DataFrame:
    """T4, with pieces of at most 300 characters."""
    return _docs(spark, d).select("doc_id", F.posexplode(T.split_long("text", 300)).alias("i", "piece"))


@query(r"SELECT doc_id, lang || ' ' || 'é ộ' AS flat, nfc_normalize(trim(regexp_replace(array_to_string([trim(regexp_replace(x, '[ \t]+', ' ', 'g')) FOR x IN string_split(coalesce(text, ''), chr(10))], chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS norm FROM documents")
def text_composed(spark: SparkSession, d: str) -> DataFrame:
    """Decomposed text is composed first."""
    apart = F.col("text")
    for x in "éèêçàùộ":
        apart = F.replace(apart, F.lit(x), F.lit(unicodedata.normalize("NFD", x)))
    return _docs(spark, d).select("doc_id", T.flatten(F.concat("lang", F.lit(" \n" + unicodedata.normalize("NFD", "é ộ")))).alias("flat"), T.normalize_text(apart).alias("norm"))


@query(r"SELECT doc_id, lower(trim(regexp_replace(strip_accents(left(coalesce(text, ''), 60)), '[^A-Za-z0-9]+', '_', 'g'), '_')) AS safe FROM documents")
def safe_ids_accents(spark: SparkSession, d: str) -> DataFrame:
    """T9 beyond ASCII."""
    return _docs(spark, d).select("doc_id", T.safe_id(F.substring("text", 1, 60)).alias("safe"))


@query("SELECT l_orderkey, l_linenumber, (l_linenumber * 10 < 25 AND l_linenumber * 10 + l_quantity > 15) OR (l_linenumber * 10 < 60 AND l_linenumber * 10 + l_quantity > 55) AS meets FROM lineitem")
def spans_met(spark: SparkSession, d: str) -> DataFrame:
    """Half-open spans against a list of spans."""
    spans = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in ((15, 25), (55, 60))])
    start = F.col("l_linenumber") * 10
    return read_table(spark, f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", T.spans_overlap(start, start + F.col("l_quantity"), spans).alias("meets"))


@query("SELECT p_partkey, p_size || ',' || (p_size + 1) || 'a' AS clauses, CASE WHEN p_size % 2 = 0 THEN 'Chương ' || p_size || ': ' || p_name ELSE '' END AS heading, '[\"' || p_brand || '\",\"' || p_name || '\"]' AS listed, CASE WHEN p_size % 3 = 0 THEN '[EMPTY LEGAL CHUNK]' ELSE p_name END AS text FROM part")
def part_texts(spark: SparkSession, d: str) -> DataFrame:
    """T12, T20, T21, T23, T24."""
    n = F.col("p_size").cast("string")
    clauses = F.array_join(T.clause_numbers(F.concat(F.lit("theo khoản "), n, F.lit(", Khoản "), (F.col("p_size") + 1).cast("string"), F.lit("A Điều 4"))), ",")
    heading = T.heading_if(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" Chương  "), n, F.lit(": "), F.col("p_name"))).otherwise(F.col("p_name")), P.NODE_CHAPTER)
    listed = T.json_list(F.array("p_brand", F.lit(" "), "p_name", F.lit(None), F.concat(F.lit(" "), F.col("p_brand"))))
    blank = F.when(F.col("p_size") % 3 == 0, F.element_at(F.array(F.lit("None"), F.lit(" nan "), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int"))).otherwise(F.col("p_name"))
    return read_table(spark, f"{d}/part.parquet").select("p_partkey", clauses.alias("clauses"), heading.alias("heading"), listed.alias("listed"), T.text_or_placeholder(blank).alias("text"))


@query("""SELECT p_partkey, p_size::VARCHAR AS identifier, CASE WHEN p_size % 4 = 3 THEN p_size::DOUBLE ELSE 1.0 END AS weight, 'a' || p_size || ',b' AS ids, CASE WHEN p_size % 3 = 2 THEN p_size || '.5' ELSE p_size::VARCHAR END AS viewer,
CASE WHEN p_size % 3 = 0 THEN 'a|b,c' WHEN p_size % 3 = 1 THEN 'x|y' ELSE 'one' END AS relevant, CASE WHEN p_size % 3 = 2 THEN 'q 1' ELSE 'a|b' END AS quoted, p_brand || ',' || p_name AS distinct_ids FROM part""")
def id_parsing(spark: SparkSession, d: str) -> DataFrame:
    """Ids and weights in the forms that tables hold them in."""
    n, p = F.col("p_size").cast("string"), read_table(spark, f"{d}/part.parquet")
    pick = lambda k, *forms: F.element_at(F.array(*forms), (F.col("p_size") % k + 1).cast("int"))
    c = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    weight = pick(4, F.lit("nan"), F.lit("x"), F.lit("inf"), n)
    ids = pick(4, c('["a', n, '","b"]'), c("['a", n, "', 'b']"), c("a", n, ", b"), c("[a", n, ", 'b']"))
    viewer = pick(3, c(n, ".0"), c(" ", n, " "), c(n, ".5"))
    relevant = pick(3, F.lit("a|b,c"), F.lit("['x','y']"), F.lit(" 'one' "))
    quoted = pick(3, F.lit('["a","b"]'), F.lit("array(['a'  'b'])"), F.lit("('q 1')"))
    joined = lambda x, by: F.array_join(x, by)
    return p.select("p_partkey", T.identifier(c("  ", n, " ")).alias("identifier"), T.weight(weight).alias("weight"), joined(T.id_list(ids), ",").alias("ids"), T.viewer_id(viewer).alias("viewer"), joined(T.relevant_ids(relevant), "|").alias("relevant"), joined(T.quoted_ids(quoted), "|").alias("quoted"), joined(T.distinct_ids(F.array("p_brand", F.lit(None), "p_name", "p_brand")), ",").alias("distinct_ids"))


@query("""SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","bad":null,"none":null}' AS row_json, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS first FROM customer""")
def row_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON without numbers that aren't finite, and the first value that isn't blank."""
    c = read_table(spark, f"{d}/customer.parquet").withColumns({"bad": F.lit(float("inf")), "none": F.lit(None).cast("string"), "maybe": F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("  ")})
    return c.select("c_custkey", T.json_safe(c, "c_custkey", "c_name", "bad", "none").alias("row_json"), T.first_value("none", "maybe", "c_mktsegment").alias("first"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'build')")
def sector_filter(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a sector."""
    c = read_table(spark, f"{d}/customer.parquet").select("c_custkey", F.array(F.lit("x"), F.col("c_mktsegment")).alias("legal_sectors"))
    return chunker.filter_sector(c, " BUILD ").select("c_custkey")


_TERMS = "list_distinct([t FOR t IN regexp_extract_all(lower({0}), '[0-9A-Za-zÀ-ỹĐđ]+') IF length(t) > 1 AND t NOT IN (" + ", ".join(f"'{w}'" for w in P.STOPWORDS) + ")])"


@query(f"SELECT item_id, array_to_string(list_sort({_TERMS.format('text')}), ' ') AS terms FROM benchmark")
def evidence_terms(spark: SparkSession, d: str) -> DataFrame:
    """D3."""
    return read_table(spark, f"{d}/benchmark.parquet").select("item_id", F.array_join(F.array_sort(T.query_terms("text")), " ").alias("terms"))


@query("SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, length(text)::BIGINT AS n_chars, sum(length(text)) OVER w AS s, row_number() OVER w AS i FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE s <= 13000 OR i = 1")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a source in order until the budget is passed."""
    r = _docs(spark, d).select(F.col("source").alias("query_id"), F.col("doc_id").alias("source_id"), "text")
    return evidence.within_budget(r, "text", 13000).select(F.col("query_id").alias("source"), F.col("source_id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"))


@query("WITH x AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t, [lower(trim(regexp_replace(l, '\\s+', ' ', 'g'))) FOR l IN string_split(text, chr(10)) IF trim(l) <> ''] AS ls, regexp_extract_all(lower(text), '[0-9A-Za-zÀ-ỹĐđ]+') AS w FROM conversations) SELECT conv_id, turn, " + " OR ".join(f"contains(t, '{p}')" for p in P.REFUSALS) + " AS refusal, len(ls) = 0 OR len([l FOR l IN list_distinct(ls) IF len([m FOR m IN ls IF m = l]) >= 3]) > 0 OR (len(w) >= 40 AND len(list_distinct(w)) / len(w) < 0.23) AS degenerate FROM x")
def answer_flags(spark: SparkSession, d: str) -> DataFrame:
    """D9, D15."""
    return read_table(spark, f"{d}/conversations.parquet").select("conv_id", "turn", T.contains_refusal("text").alias("refusal"), T.degenerate("text").alias("degenerate"))


@query("SELECT DISTINCT a.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.ts < b.ts + INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE > b.ts")
def span_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """T11 as a join: events whose ten minutes meet another of the user's. Spans of one length: only neighbours in time need to be compared."""
    e = read_table(spark, f"{d}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = lambda other: F.coalesce(F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col(other).cast("timestamp"))) < 600_000_000, F.lit(False))
    return e.withColumns({"_p": F.lag("ts").over(w), "_n": F.lead("ts").over(w)}).where(near("_p") | near("_n")).select("event_id")


@query(r"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}'))::BIGINT AS n_tokens FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """R1."""
    return _docs(spark, d).select("doc_id", F.size(lexical.tokens("text")).cast("long").alias("n_tokens"))

