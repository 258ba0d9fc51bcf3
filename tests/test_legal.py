import hashlib
import unicodedata

import pyarrow as pa
import pytest

from loomspark.operators import chunker, expand, graph
from loomspark.plans import tables
from loomspark.queries import texts

DOCUMENT = """NGHỊ ĐỊNH
Căn cứ Luật số 43/2019/QH14;
CHƯƠNG I
QUY ĐỊNH CHUNG
Điều 1. Phạm vi điều chỉnh
Nghị định này quy định mức học phí theo khoản 2 Điều 3 và Nghị định số 81/2021/NĐ-CP.
Điều 2. Ngắn
Ít chữ.
Điều 3. Hiệu lực thi hành
Nghị định số 81/2021/NĐ-CP hết hiệu lực kể từ ngày Nghị định này có hiệu lực thi hành.
Nơi nhận: - Như trên;
PHỤ LỤC I
Biểu mức học phí
| Cấp | Mức |
| Tiểu học | 100 |"""


def chunks(spark):
    rows = [(1, "12/2025/NĐ-CP", DOCUMENT), (2, "13/2025/NĐ-CP", ""), (3, None, None)]
    return chunker.chunk(spark.createDataFrame(rows, "document_id long, document_number string, content string"))


def test_chunks_links_and_graph(spark):
    c = chunks(spark).cache()
    got = {r["id"]: r for r in c.collect()}
    assert set(got) == {"1_dieu_1_0001", "1_dieu_3_0003", "1_phu_luc_0001_01", "1_bang_0001_01"}
    a, b = got["1_dieu_1_0001"], got["1_dieu_3_0003"]
    assert a.chapter == b.chapter == "CHƯƠNG I: QUY ĐỊNH CHUNG"
    assert a.articles == "Điều 1. Phạm vi điều chỉnh" and a.part is None and a.section is None
    link = lambda r: [(x.relationship, x.document_number, x.article, x.clause, x.scope) for x in r.link_to]
    assert link(a) == [("BASED_ON", "43/2019/QH14", None, None, "document_header"), ("REFERS_TO", "81/2021/NĐ-CP", None, None, "article"), ("REFERS_TO", "12/2025/NĐ-CP", "3", "2", "article")]
    assert link(b) == [("REPEALS", "81/2021/NĐ-CP", None, None, "article")]
    assert got["1_phu_luc_0001_01"].articles == "PHỤ LỤC - Nội dung phụ lục 1"
    assert got["1_phu_luc_0001_01"].content == "PHỤ LỤC I Biểu mức học phí"
    assert got["1_bang_0001_01"].content == "Cấp; Mức. Tiểu học; 100" and got["1_bang_0001_01"].articles == "PHỤ LỤC - Bảng 1"
    nodes, edges = graph.build_nodes(c).cache(), graph.build_edges(c).cache()
    kinds = {r["node_type"]: r["count"] for r in nodes.groupBy("node_type").count().collect()}
    assert kinds == {"document": 1, "part": 1, "chapter": 1, "section": 1, "article": 2, "external_document": 2}
    assert edges.where("edge_type = 'HIERARCHY'").count() == 5 and edges.where("edge_type = 'DOCUMENT_LINK'").count() == 3
    assert graph.validate(nodes, edges).isEmpty()
    assert sorted(r.edge_pos for r in edges.collect()) == list(range(8))


def test_decomposed_text_and_node_attributes(spark):
    """Decomposed text gives the same chunks; virtual levels, external numbers and attributes are as they are told to be."""
    apart = unicodedata.normalize("NFD", DOCUMENT)
    c = chunker.chunk(spark.createDataFrame([(1, "12/2025/NĐ-CP", apart, "Tiêu đề")], "document_id long, document_number string, content string, title string")).cache()
    assert {r.id for r in c.collect()} == {r.id for r in chunks(spark).collect()}
    nodes = {(r.node_type, r.label): r for r in graph.build_nodes(c).collect()}
    assert {k for k in nodes if k[0] in ("document", "part", "section", "external_document")} == {("document", "Tiêu đề"), ("part", "Không có Phần"), ("section", "Không có Mục"), ("external_document", "43/2019/QH14"), ("external_document", "81/2021/NĐ-CP")}
    assert nodes["external_document", "43/2019/QH14"].node_id == "external_doc:" + hashlib.sha1(b"43/2019/QH14").hexdigest()[:20]
    assert all(r.document_number == "12/2025/NĐ-CP" and r.resolution_status == "internal" for k, r in nodes.items() if k[0] != "external_document")
    assert nodes["article", "Điều 1. Phạm vi điều chỉnh"].source_chunk_ids == ["1_dieu_1_0001"]
    with pytest.raises(ValueError):
        chunker.chunk(c, limit=0)


def test_selection_goes_as_far_as_it_must(spark):
    e = spark.createDataFrame([(f"{i:02}", f"{i + 1:02}") for i in range(20)], "source string, target string")
    assert expand.select_around(e, "00", 100).agg({"level": "max"}).first()[0] == 20


def test_bfs_first_visit_wins(spark):
    edges = spark.createDataFrame([("S", "A", 2, 0), ("S", "B", 1, 1), ("A", "C", 1, 2), ("B", "C", 5, 3)], "source string, target string, weight int, edge_pos long")
    nodes = spark.createDataFrame([(x, [x.lower()], i) for i, x in enumerate("SABC")], "node_id string, source_chunk_ids array<string>, node_pos long")
    seeds = spark.createDataFrame([("q", "s", 1.0, 1)], "query_id string, chunk_id string, score double, rank int")
    got = {r.chunk_id: r.score for r in expand.expand(seeds, expand.chunk_nodes(nodes), expand.adjacency(edges), 2, 0.5).collect()}
    assert got == {"s": 1.0, "a": 1.0, "b": 0.5, "c": 0.5}


def test_components(spark):
    e = spark.createDataFrame([(str(i), str(i + 1), "r") for i in range(100, 140)] + [("x", "y", "r")], "source string, target string, relationship string")
    labels = {r.node: r.label for r in expand.component_labels(e).collect()}
    assert set(labels.values()) == {"100", "x"} and len(labels) == 43
    assert expand.largest_component(e).count() == 40


def test_chunks_take_one_pass(spark):
    """Documents are read once and where they lie: as windows over lines they were read three times and shuffled."""
    rows = [(1, "12/2025/NĐ-CP", DOCUMENT)]
    plan = chunker.chunk(spark.createDataFrame(rows, "document_id long, document_number string, content string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan ExistingRDD") == 1


AWKWARD = """Điều 1. Trước mọi chương, ſ và ı
nội dung một | hai dài hơn năm mươi ký tự để được giữ lại ở đây | ba
CHƯƠNG I
MỤC 1
TÊN MỤC
Điều 2a
Sửa đổi điểm b khoản 1, khoản 2 và khoản 3 Điều 7 Thông tư 12/2019/TT-BTC. Bãi bỏ Luật số 5/2020/QH14; xem Mục II Phụ lục III.
PHẦN II
chữ sau đề mục không thuộc điều nào
Chủ tịch ký; KÈM Nơi nhận: - Như trên; DANH MỤC kèm theo
Phụ lục I. Mẫu
| a | b |
"""


def test_awkward_document(spark):
    """Titles on the line below, text that a heading cuts off, an appendix that begins inside a line, and links of each kind."""
    got = {r["id"]: r for r in chunker.chunk(spark.createDataFrame([(7, "1/2/A", AWKWARD)], "document_id long, document_number string, content string"), 20).collect()}
    assert set(got) == {"7_dieu_1_0001", "7_dieu_2a_0002", "7_phu_luc_0001_01", "7_phu_luc_0002_01", "7_bang_0001_01"}
    assert got["7_dieu_1_0001"].content == "Điều 1. Trước mọi chương, ſ và ı. nội dung một; hai dài hơn năm mươi ký tự để được giữ lại ở đây; ba"
    second = got["7_dieu_2a_0002"]
    assert (second.part, second.chapter, second.section, second.articles) == (None, "CHƯƠNG I", "MỤC 1: TÊN MỤC", "Điều 2a")
    assert [(x.relationship, x.document_number, x.article, x.clause, x.point, x.appendix, x.section) for x in second.link_to] == [("AMENDS", "12/2019/TT-BTC", "7", c, "b", None, None) for c in "123"] + [("REPEALS", "5/2020/QH14", None, None, None, None, None), ("REFERS_TO", "1/2/A", None, None, None, "III", "II")]
    first = got["7_phu_luc_0001_01"]
    assert (first.part, first.chapter, first.articles, first.content) == ("PHẦN II", None, "DANH MỤC - Nội dung phụ lục 1", "DANH MỤC kèm theo")
    assert got["7_bang_0001_01"].articles == "Phụ lục I. Mẫu - Bảng 1"


def test_few_bytes_are_spread_over_cores(spark):
    """Sixty times the customers are a file of some megabytes: one task would parse all their documents."""
    assert texts.structured_documents(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_python_sees_few_rows_at_once():
    batch = pa.RecordBatch.from_pydict({"x": list(range(10_000))})
    parts = list(tables.slices(iter([batch])))
    assert max(p.num_rows for p in parts) <= 256 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_edges_are_written_before_they_are_numbered(spark, monkeypatch):
    names = []
    monkeypatch.setattr(graph, "materialise", lambda df, name: names.append(name) or tables.materialise(df, name))
    assert graph.build_edges(tables.materialise(chunks(spark), "chunks")).count() == 8 and names == ["edges", "positions"]
