"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import chat, license, mixing, packing, quality, simhash, substring, topk, urlfilter, warc
from loomspark.llm.common import read_table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read_table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(read_table(spark, sf_dir, "conversations"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.licence_scan(read_table(spark, sf_dir, "documents"))


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.evaluate(urlfilter.page_captures(read_table(spark, sf_dir, "pages")), urlfilter.default_list(spark))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measures(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_packing, op4_warc, op5_substring, op6_topk, op7_chat, op8_license, op9_urlfilter, op10_quality)}

_WORDS = r"[^\x20\x09-\x0D]+"
_MARKS = ", ".join("'" + m.replace("'", "''") + "'" for m in quality.END_MARKS)

ORACLES = {
    "op2_mixing": rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sidx FROM s),
c AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(sidx % 3 + 1)::INT] AS w, source_size::DOUBLE * 2 AS cap, (SELECT sum(source_size) FROM s)::DOUBLE * 1.5 AS total FROM w),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY cap / w, sidx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER (ORDER BY cap / w, sidx) AS pos FROM c),
k AS (SELECT *, (total - before) * w >= cap * rest AS capped FROM r),
l AS (SELECT arg_min((total - before) / rest, pos) AS level FROM k WHERE NOT capped),
t AS (SELECT source, sidx, source_size, CASE WHEN capped OR level IS NULL THEN cap ELSE least(level * w, cap) END AS target FROM k, l),
o AS (SELECT row_number() OVER () AS r, d.doc_id, d.size, t.sidx, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS words,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, 'null') || ':17'), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT sidx, ceil(floor(target + 0.5) / 4096)::BIGINT AS n, (sum(ceil(floor(target + 0.5) / 4096)) OVER (ORDER BY sidx) - ceil(floor(target + 0.5) / 4096))::BIGINT AS lo FROM t),
b AS (SELECT sum(n)::BIGINT AS total, ceil(log2(greatest(sum(n), 1)))::INT AS bits FROM n),
p AS (SELECT sidx, list_sum([((i >> j) & 1) << (bits - 1 - j) FOR j IN range(bits)] || [0])::BIGINT AS slot FROM b, range((SELECT total FROM b)) x(i) JOIN n ON i >= lo AND i < lo + n),
q AS (SELECT sidx, slot, row_number() OVER (PARTITION BY sidx ORDER BY slot) - 1 AS block FROM p),
u AS (SELECT r, sidx, greatest(a, 0) AS s, least(a + size, words) AS e FROM (SELECT r, sidx, size, words, start + k * source_size AS a FROM o, (VALUES (0), (1)) x(k))),
m AS (SELECT r, sum(least(e, (block + 1) * 4096) - greatest(s, block * 4096))::BIGINT AS taken, min(slot) AS first_slot, max(slot) AS last_slot FROM u JOIN q USING (sidx) WHERE e > s AND block BETWEEN s // 4096 AND (e - 1) // 4096 GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, last_slot FROM o LEFT JOIN m USING (r)""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f""",
    "op6_topk": """
WITH e AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding) AND len([x FOR x IN embedding IF isfinite(x)]) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op7_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length('<|im_start|>') + length('<|im_end|>') + 2 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
    "op9_urlfilter": rf"""
WITH l(pattern, kind, category, action, day) AS (VALUES {", ".join(f"('{p}', '{k}', '{c}', '{a}', DATE '{d}')" for p, k, c, a, d in urlfilter.ENTRIES)}),
i AS (SELECT pattern, kind, category, action, day AS valid_from, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS valid_to FROM l),
p AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS fetched,
  regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.$', ''), '^www\.', '') AS host,
  trim(regexp_replace(lower(regexp_extract(url, '^[^:]*://[^/?#]*/([^?#]*)', 1)), '/+', '/', 'g'), '/') AS path FROM pages),
h AS (SELECT page_id, url, fetched, arg_max(pattern, (length(pattern), pattern)) AS pattern, arg_max(category, (length(pattern), pattern)) AS category
  FROM p JOIN i ON action = 'add' AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)
  AND (kind = 'host' AND (host = pattern OR ends_with(host, '.' || pattern)) OR kind = 'prefix' AND starts_with(host || '/' || path || '/', pattern || '/')) GROUP BY ALL)
SELECT p.page_id, nullif(p.host, '') AS host, p.fetched, h.pattern IS NOT NULL AS blocked, h.category, h.pattern FROM p LEFT JOIN h USING (page_id, url, fetched)""",
    "op10_quality": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
l AS (SELECT r, line, own, len(own) AS n, coalesce(list_sum([length(x) FOR x IN own]), 0) AS chars, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS marks
  FROM (SELECT r, line, regexp_extract_all(line, '{_WORDS}') AS own FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)) WHERE len(own) > 0),
v AS (SELECT *, marks > 0.2::DOUBLE * n OR (length(line) - length(replace(line, '!!', ''))) / 2 > 0.5::DOUBLE * n
  OR (n >= 5 AND NOT regexp_matches(line, '\p{{Ll}}') AND regexp_matches(line, '\p{{Lu}}'))
  OR (n <= 25 AND regexp_matches(line, '(?i){"|".join(quality.BOILERPLATE)}'))
  OR (n < 4 AND right(own[-1], 1) NOT IN ({_MARKS})) AS fails FROM l),
k AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines, coalesce(sum(chars) FILTER (NOT fails), 0) AS kept_chars FROM v GROUP BY r),
g AS (SELECT r, i, array_to_string(w[i:i + 4], chr(32)) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
p AS (SELECT r, count(DISTINCT word_at)::BIGINT AS n FROM (SELECT r, unnest(range(i, i + 5)) AS word_at FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars FROM d LEFT JOIN k USING (r) LEFT JOIN p USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_chars >= 0.5::DOUBLE * word_chars AS kept FROM m""",
}
