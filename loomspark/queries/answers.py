"""Queries of evidence and answers. The questions are the benchmark's passages, the results their ten best documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import patterns as P
from loomspark.operators import evidence, fusion
from loomspark.plans.tables import materialise
from loomspark.queries import retrieval
from loomspark.queries.texts import _TERMS, _docs
from loomspark.sources.io import read_table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _results(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of each passage, hydrated: texts, titles (their sources) and numbers."""
    hit = retrieval.bm25_topk(spark, d).select("query_id", F.col("doc_id").alias("chunk_id"), F.col("rank").alias("source_id"))
    items = read_table(spark, f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    chunks = _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("doc_id").cast("string"), F.lit("/2024"))).alias("document_number"), F.lit("Điều 1").alias("articles"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("http://x/"), F.col("doc_id").cast("string"))).alias("url"))
    return materialise(fusion.hydrate(hit, chunks).join(items, "query_id"), "results")


_C = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_LIST = r"regexp_replace({0}, '(?i)\s+((?:\d{{1,3}}[.)]|[a-zđ][.)]|[-–•])\s+)', chr(10) || '\1', 'g')"
_SIGNAL = r"(^|[^\p{L}\p{N}_])(?:điều|khoản|điểm|đối tượng|điều kiện|mức|thời hạn|thủ tục|hồ sơ|khoảng cách|trường hợp|quy định)([^\p{L}\p{N}_]|$)"
_WORDS = "[t FOR t IN regexp_extract_all(lower({0}), '[0-9A-Za-zÀ-ỹĐđ]+') IF length(t) > 1 AND t NOT IN (" + ", ".join(f"'{w}'" for w in P.STOPWORDS) + ")]"
_RES = "res AS (SELECT query_id, doc_id, rank AS source_id, b.text AS query, coalesce(d.text, '') AS text, coalesce(d.source, '') AS title, CASE WHEN doc_id % 2 = 0 THEN doc_id || '/2024' END AS document_number, CASE WHEN doc_id % 3 = 0 THEN 'http://x/' || doc_id END AS url FROM r JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id) WHERE rank <= 10)"
_SEGMENTS = rf"""
qw AS (SELECT query_id, any_value({_WORDS.format('query')}) AS w FROM res GROUP BY query_id),
qp AS (SELECT query_id, list_distinct(w) AS terms, list_distinct(list_concat([array_to_string(w[i:i + 1], ' ') FOR i IN range(1, len(w))], [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)], [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)])) AS phrases FROM qw),
cut AS (SELECT query_id, source_id, {_C.format('text')} AS flat, [y FOR y IN [{_C.format("trim(z, ' -–•')")} FOR z IN string_split(regexp_replace({_LIST.format(_LIST.format(_C.format('text')))}, '([.!?;:])\s+([A-ZÀ-ỸĐ0-9])', '\1' || chr(10) || '\2', 'g'), chr(10))] IF length(y) >= 18] AS s FROM res),
seg0 AS (SELECT query_id, source_id, CASE WHEN len(s) > 0 THEN s WHEN flat <> '' THEN [left(flat, 600)] ELSE [] END AS s FROM cut),
seg AS (SELECT query_id, source_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS segment FROM seg0),
sc0 AS (SELECT seg.*, lower({_C.format('segment')}) AS plain, title, terms, phrases, {_TERMS.format('segment')} AS st, {_TERMS.format('title')} AS tt FROM seg JOIN qp USING (query_id) JOIN res USING (query_id, source_id)),
sc1 AS (SELECT *, 0.52::DOUBLE * (len(list_intersect(terms, st)) / greatest(len(terms), 1)) AS a, 0.14::DOUBLE * least(len([p FOR p IN phrases IF contains(plain, p)]) / 3.0::DOUBLE, 1.0::DOUBLE) AS c,
  0.08::DOUBLE * regexp_matches(plain, '{_SIGNAL}')::INT AS s, 0.04::DOUBLE * (least(length(segment), 320) / 320.0::DOUBLE) AS l FROM sc0 WHERE plain <> ''),
sc AS (SELECT *, round(a + 0.16::DOUBLE * (len(list_intersect(terms, tt)) / greatest(len(terms), 1)) + c + s + 0.06::DOUBLE / source_id + l, 6) AS score, round(a + c + s + 0.06::DOUBLE + l, 6) AS alone FROM sc1),
best1 AS (SELECT query_id, source_id, segment FROM sc QUALIFY row_number() OVER (PARTITION BY query_id, source_id ORDER BY alone DESC, pos) = 1),
shortest AS (SELECT query_id, source_id, CASE WHEN length(segment) > 360 THEN rtrim(left(segment, 357)) || '...' ELSE segment END AS sentence FROM best1)"""


def _fold(name: str, limit: int) -> str:
    """CTE ``name``: (query_id, rank, source_id, segment, score), the ordered fold of segments."""
    return f"""
{name}c AS (SELECT query_id, source_id, plain, segment, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id, pos) AS n FROM sc),
{name}f(query_id, n, texts, srcs, ns) AS (SELECT query_id, 0::BIGINT, []::VARCHAR[], []::BIGINT[], []::BIGINT[] FROM (SELECT DISTINCT query_id FROM sc)
  UNION ALL SELECT query_id, n, CASE WHEN ok THEN list_append(texts, plain) ELSE texts END, CASE WHEN ok THEN list_append(srcs, source_id) ELSE srcs END, CASE WHEN ok THEN list_append(ns, n) ELSE ns END
  FROM (SELECT c.query_id, c.n, c.plain, c.source_id, f.texts, f.srcs, f.ns, NOT list_contains(f.texts, c.plain) AND len([x FOR x IN f.srcs IF x = c.source_id]) < 3 AS ok FROM {name}f f JOIN {name}c c ON c.query_id = f.query_id AND c.n = f.n + 1 WHERE len(f.texts) < {limit})),
{name}l AS (SELECT query_id, unnest(ns) AS n, generate_subscripts(ns, 1)::BIGINT AS rank FROM (SELECT * FROM {name}f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC) = 1)),
{name} AS (SELECT query_id, rank, source_id, segment, score FROM {name}l JOIN {name}c USING (query_id, n))"""


def _sql(limit: int, *more: str) -> str:
    return f"WITH RECURSIVE {retrieval._BM25}, {_RES}, {_SEGMENTS}, {_fold('ev', limit)}" + "".join(", " + m for m in more)


@query(f"{_sql(8)} SELECT * FROM ev")
def evidence_rank(spark: SparkSession, d: str) -> DataFrame:
    """The eight best segments for each passage."""
    return evidence.ranked_evidence(_results(spark, d))


@query(f"{_sql(1)} SELECT query_id, score >= 0.16 AS has_evidence, CASE WHEN length(segment) > 360 THEN rtrim(left(segment, 357)) || '...' ELSE segment END AS sentence FROM ev")
def evidence_best(spark: SparkSession, d: str) -> DataFrame:
    """Whether there is evidence, and the best sentence."""
    r = _results(spark, d)
    return evidence.has_evidence(evidence.ranked_evidence(r, 1)).join(evidence.best_sentence(r), "query_id")


_SECTIONS = """
grp AS (SELECT query_id, source_id, list(segment ORDER BY rank)[1:3] AS own FROM ev GROUP BY ALL),
sec AS (SELECT query_id, source_id, '<SOURCE id="' || source_id || '">' || chr(10) || 'Số hiệu: ' || coalesce(document_number, 'Không rõ số hiệu') || chr(10) || 'Tiêu đề: ' || coalesce(nullif(trim(title), ''), 'Không rõ tiêu đề') || chr(10) || 'Điều/Mục: Điều 1' || chr(10)
  || array_to_string([('Đoạn ' || i || ': ' || left(e[i], 900)) FOR i IN range(1, len(e) + 1)], chr(10)) || chr(10) || '</SOURCE>' AS x
  FROM (SELECT res.*, coalesce(own, [sentence]) AS e FROM res LEFT JOIN grp USING (query_id, source_id) LEFT JOIN shortest USING (query_id, source_id) WHERE coalesce(own, [sentence]) IS NOT NULL AND (own IS NOT NULL OR sentence IS NOT NULL))),
fit AS (SELECT *, sum(length(x)) OVER w AS total, row_number() OVER w AS i FROM sec WINDOW w AS (PARTITION BY query_id ORDER BY source_id ROWS UNBOUNDED PRECEDING))"""


@query(f"{_sql(10, _SECTIONS)} SELECT query_id, string_agg(x, chr(10) || chr(10) ORDER BY source_id) AS context FROM fit WHERE total <= 3000 OR i = 1 GROUP BY query_id")
def evidence_context(spark: SparkSession, d: str) -> DataFrame:
    """D11, with a budget of 3000 characters."""
    return evidence.context(_results(spark, d), 3000)


_ATTRIBUTED = f"""
att AS (SELECT query_id, source_id, round(0.85::DOUBLE * (len(list_intersect(aterms, own)) / greatest(len(aterms), 1)) + 0.15::DOUBLE / source_id, 6) AS score FROM (SELECT query_id, source_id, {_TERMS.format('answer')} AS aterms, {_TERMS.format("concat_ws(' ', title, articles, text)")} AS own FROM (SELECT res.*, {{articles}} AS articles, {{answer}} AS answer FROM res {{join}}))),
top3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id DESC) AS rank FROM att QUALIFY rank <= 3)"""


@query(f"WITH {retrieval._BM25}, {_RES}, {_ATTRIBUTED.format(articles=repr(''), answer='query', join='')} SELECT query_id, source_id, score, rank FROM top3")
def source_attribution(spark: SparkSession, d: str) -> DataFrame:
    """The passage itself as answer."""
    r = _results(spark, d)
    return evidence.attributed_sources(r.select("query_id", F.col("query").alias("answer")).distinct(), r.select("query_id", "source_id", "title", F.lit("").alias("articles"), "text"))


_EXTRACTED = r"""
told AS (SELECT query_id, list(rtrim(CASE WHEN length(segment) > 360 THEN rtrim(left(segment, 357)) || '...' ELSE segment END, '.') || '.' ORDER BY rank)[1:4] AS s FROM (SELECT query_id, rank, trim(regexp_replace(segment, '\s+', ' ', 'g')) AS segment FROM ev) GROUP BY query_id),
ans AS (SELECT query_id, 'Kết luận:' || chr(10) || 'Dựa trên tài liệu được truy xuất, ' || s[1] || chr(10) || chr(10) || 'Thông tin chính:' || chr(10) || CASE WHEN len(s) > 1 THEN array_to_string(['- ' || x FOR x IN s[2:]], chr(10)) ELSE '- Phạm vi áp dụng cần được đối chiếu với số hiệu, địa phương và thời kỳ của văn bản trong phần nguồn trích dẫn.' END AS answer FROM told)"""


@query(f"{_sql(7, _EXTRACTED)} SELECT query_id, answer FROM ans")
def extractive_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers by extraction."""
    return evidence.extractive_answer(_results(spark, d))


_GENERATED = "Theo quy định hiện hành thì người nộp đơn gửi hồ sơ tới cơ quan có thẩm quyền trong thời hạn ba mươi ngày kể từ ngày nhận được kết quả."


@query(f"""{_sql(7, _EXTRACTED, f"chosen AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN '{_GENERATED}' ELSE answer END AS answer FROM ans)", _ATTRIBUTED.format(articles="'Điều 1'", answer='chosen.answer', join='JOIN chosen USING (query_id)'))},
src AS (SELECT query_id, string_agg('- [Nguồn ' || source_id || '] ' || coalesce(document_number, 'Không rõ số hiệu') || ' — Điều 1.' || chr(10) || '  Trích đoạn: “' || sentence || '”' || chr(10) || '  Văn bản: ' || coalesce(nullif(trim(title), ''), 'Không rõ tiêu đề') || coalesce(chr(10) || '  URL: ' || url, ''), chr(10) ORDER BY rank) AS x
  FROM top3 JOIN res USING (query_id, source_id) JOIN shortest USING (query_id, source_id) GROUP BY query_id)
SELECT query_id, answer || chr(10) || chr(10) || 'Nguồn trích dẫn:' || chr(10) || x AS answer FROM chosen JOIN src USING (query_id)""")
def answer_flow(spark: SparkSession, d: str) -> DataFrame:
    """A given answer where it is valid (for even queries; the others' is too short), else an extracted one; with sources."""
    r = _results(spark, d)
    given = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("<think>x</think>[1]. "), F.lit(_GENERATED), F.lit("\n\n### Nguồn\n- một"))).otherwise("Quá ngắn.")
    return evidence.answers(r, r.select("query_id", given.alias("generated")).distinct())


@query(f"SELECT conv_id, turn, 'Câu ' || conv_id || ' một.' || chr(10) || chr(10) || 'Câu hai.' AS cleaned, conv_id % 4 = 0 AS valid, CASE WHEN conv_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ratio, '{_GENERATED}' AS without FROM conversations")
def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    """Generated answers cleaned and judged."""
    n = F.col("conv_id").cast("string")
    raw = F.concat(F.lit("<think>nghĩ\nkỹ</think>\n[n]: Câu "), n, F.lit(" một.\nCÂU "), n, F.lit(" MỘT.\n\n\n\nCâu hai.\n\nCâu  hai.\n\nsau"))
    answer = F.element_at(F.array(F.lit(_GENERATED), F.lit("Không tìm thấy thông tin " + _GENERATED), F.lit("Điều 5 " + _GENERATED), F.lit("Ngắn.")), (F.col("conv_id") % 4 + 1).cast("int"))
    c = read_table(spark, f"{d}/conversations.parquet").select("conv_id", "turn", raw.alias("raw"), answer.alias("answer"), F.array(F.lit("một văn bản khác hẳn")).alias("texts"), F.lit(True).alias("has_evidence"), F.when(F.col("conv_id") % 2 == 0, "abc").otherwise("xyz").alias("a"), F.array(F.lit("ABC "), F.lit("")).alias("b"))
    return c.select("conv_id", "turn", evidence.clean_answer("raw").alias("cleaned"), evidence.answer_is_valid("answer", "texts", "has_evidence").alias("valid"), evidence.copy_ratio("a", "b").alias("ratio"), evidence.without_source_section(F.lit(_GENERATED + "\n\nTài liệu tham khảo:\n- a\n- b")).alias("without"))
