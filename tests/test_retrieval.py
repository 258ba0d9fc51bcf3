import pytest
from pyspark.sql import functions as F

from loomspark.operators import evaluate, evidence, fusion, lexical, vector
from loomspark.queries import retrieval as queries

PER_QUERY = evaluate.per_query


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "quyền học"), (2, "học phí học"), (3, "thuế"), (4, None)], "doc_id long, text string").where("doc_id < 4")
    q = spark.createDataFrame([("q", "học phí")], "query_id string, query string")
    got = {r.doc_id: r.score for r in lexical.bm25_top_k(docs, q).collect()}
    assert got == {1: pytest.approx(0.188001, abs=1e-6), 2: pytest.approx(0.551657, abs=1e-6)}


def test_rrf(spark):
    rank = lambda ids: spark.createDataFrame([("q", x, i) for i, x in enumerate(ids, 1)], "query_id string, chunk_id string, rank int")
    lists = [fusion.ranked_list(rank("abc"), "vector", 0), fusion.ranked_list(rank("bd"), "bm25", 1)]
    rows = fusion.rrf(lists).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in rows] == [("b", 0.032522), ("a", 0.016393), ("d", 0.016129), ("c", 0.015873)]
    assert rows[0].source == "bm25+vector"
    rows = fusion.rrf(lists, [0.5, 1.5], 30).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in rows] == [("b", 0.064012), ("d", 0.046875), ("a", 0.016129), ("c", 0.015152)]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", x, i) for i, x in enumerate("xayb", 1)], "query_id string, chunk_id string, rank int")
    rel = spark.createDataFrame([("q", x) for x in "abc"], "query_id string, chunk_id string")
    m = evaluate.per_query(ranked, rel, [1, 2, 4])
    r = m.first()
    assert (r.recall_1, r.precision_1, r.hit_1, r.mrr_1) == (0, 0, 0, 0)
    assert (r.recall_2, r.precision_2, r.hit_2, r.mrr_2) == (pytest.approx(1 / 3), 0.5, 1, 0.5)
    assert (r.recall_4, r.precision_4, r.hit_4, r.mrr_4) == (pytest.approx(2 / 3), 0.5, 1, 0.5)
    assert evaluate.summary(m, [1, 2]).first().objective == pytest.approx(0.208333)
    assert evaluate.per_query(ranked, rel.where("false"), [1]).first().recall_1 == 0


def test_split_is_seeded():
    a, b = evaluate.shuffled_split(10, 6, 4)
    assert sorted(a + b) == list(range(10)) and (a, b) == evaluate.shuffled_split(10, 6, 4)
    with pytest.raises(ValueError):
        evaluate.shuffled_split(3, 3, 1)


def test_evidence_caps_each_source(spark):
    s = " ".join(f"Mức học phí của trường số {i} là quy định." for i in range(6))
    rows = spark.createDataFrame([("q", "mức học phí", 1, "học phí", s), ("q", "mức học phí", 2, "", s), ("q", "mức học phí", 3, "", "")], "query_id string, query string, source_id long, title string, text string")
    got = evidence.ranked_evidence(rows).orderBy("rank").collect()
    assert [r.source_id for r in got] == [1, 1, 1, 2, 2, 2] and len({r.segment for r in got}) == 6


def test_approximate_search_makes_no_rows_of_pairs(spark):
    """Near vectors share buckets, so pairs as rows grow with queries times vectors; blocks of both meet instead. Buckets still decide."""
    rows = [(i, [float(i % 7), float(i // 7)]) for i in range(70)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    wide, narrow = (vector.approximate_top_k(v, q, 5, bucket_length=b, tables=1) for b in (1e6, 1e-3))
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
    assert wide.count() >= 15 > narrow.count()
    assert {(r.query_id, r.vec_id, r.score) for r in narrow.collect()} == {(i, i, 0.0) for i in range(3)}


@pytest.mark.parametrize("block, query_block", [(4096, 256), (3, 2)])
def test_bm25_in_blocks(spark, block, query_block):
    """Blocks find what scores of all pairs give: with repeated ids and texts, a null id, repeated words and ties at the last place."""
    words = "học phí quyền thuế luật".split()
    rows = [(i // 2 if i % 5 == 0 else i, " ".join(words[(i * j) % 5] for j in range(1, 2 + i % 7))) for i in range(40)] + [(None, "học học"), (50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = lexical.query_terms(spark.createDataFrame([(f"q{i}", " ".join(words[i:] + words[:1])) for i in range(5)] + [("none", "vắng")], "query_id string, query string"))
    index = lexical.build_index(docs)
    want = lexical.top_k(lexical.index_scores(index, asked).where("score > 0"), 4)
    got = lexical.index_top_k(index, asked, 4, block=block, query_block=query_block)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 20


def test_grid_relevance_makes_no_row_for_each_pair(spark, monkeypatch):
    """Vectors of one label are all relevant to each other: only pairs that a list holds are made, and the others are counted."""
    seen = []
    monkeypatch.setattr(evaluate, "per_query", lambda ranked, relevant, *a, **k: seen.append(relevant.count()) or PER_QUERY(ranked, relevant, *a, **k))
    assert queries.grid_search_best(spark, "/root/testdata/sf0.001").count() == 1
    assert seen and seen[0] <= 25 * 40


def test_first_characters_stay_as_they_are_cut(spark):
    """A text without a sentence of 18 characters gives its first 600; where these end in a blank, as here, the blank is part of them (SQL: left)."""
    text = "ABC!! DEFG! " * 60
    assert text[599] == " "
    r = spark.createDataFrame([("q", "abc", 1, "", text)], "query_id string, query string, source_id int, title string, text string")
    assert evidence.ranked_evidence(r).first().segment == text[:600]
    assert evidence.extractive_answer(r).count() == 1
