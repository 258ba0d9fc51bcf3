import json

import pytest

from loomspark.functions import text as T
from loomspark.operators import evaluate, vector
from loomspark.plans import tables
from loomspark.sources import io


def test_console_and_latex_tables():
    rows = [{"method": "bm25", "recall_5": 0.5}, {"method": "hybrid", "recall_5": 0.25}]
    assert io.console_table(rows, ["method", "recall_5"]).split("\n") == ["method  recall_5", "------  --------", "bm25    0.5000", "hybrid  0.2500"]
    latex = io.latex_table(rows, ["method", "recall_5"])
    assert r"method & recall\_5 \\" in latex and r"bm25 & 0.5000 \\" in latex


def test_config_and_manifest(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": {"b": 3}, "paths": {"data": "in/x", "abs": "/y"}}))
    c = io.Config.load(str(tmp_path / "c.json"))
    assert c.get("a.b") == 3 and c.get("a.c", 7) == 7 and c.get("a.b.d") is None and c.section("a") == {"b": 3}
    assert c.path("data") == str(tmp_path / "in/x") and c.path("abs") == "/y"
    io.manifest(str(tmp_path / "m.json"), n=2, what="ộ")
    assert json.loads((tmp_path / "m.json").read_text()) == {"n": 2, "what": "ộ"}


def test_errors(spark, tmp_path):
    one, two = spark.range(3).withColumnRenamed("id", "row"), spark.range(2).withColumnRenamed("id", "row")
    with pytest.raises(ValueError):
        io.zip_by_position(one, two)
    with pytest.raises(ValueError):
        io.write_table(one.where("false"), str(tmp_path / "t"))
    with pytest.raises(KeyError):
        io.read_split(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        io.read_items(spark, "x.txt")
    assert not io.has_rows(spark, str(tmp_path / "none"))
    encode = lambda df: df
    assert io.resume_embedding(one, str(tmp_path / "s"), encode, "a", "row") == 3
    with pytest.raises(ValueError, match="begun with"):
        io.resume_embedding(one, str(tmp_path / "s"), encode, "b", "row")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    vector.write_index(v, str(tmp_path / "v"))
    with pytest.raises(ValueError, match="2 vectors"):
        vector.read_index(spark, str(tmp_path / "v"), v.limit(1))
    bad = spark.createDataFrame([("a", "", "x")], "source string, target string, relationship string").selectExpr("source", "source as target", "relationship", "'HIERARCHY' as edge_type", "'internal' as resolution_status")
    with pytest.raises(ValueError, match="self_loop"):
        io.write_graph(spark.createDataFrame([("a", "x")], "node_id string, node_type string"), bad, str(tmp_path / "g"))


def test_written_tables_can_be_removed(spark):
    t = tables.materialise(spark.range(5), "five")
    assert t.count() == 5
    tables.discard(t)
    assert not io.has_rows(spark, t.loom_path)


def test_items_with_ids_and_blank_queries(spark):
    items = spark.createDataFrame([("q1", "hỏi", "a;b"), ("q2", " ", "")], "id string, question string, answers string")
    got = evaluate.parse_items(items.limit(1)).first()
    assert (got.query_id, got.query, got.relevant_chunk_ids) == ("q1", "hỏi", ["a", "b"])
    with pytest.raises(Exception, match="blank"):
        evaluate.parse_items(items).collect()


def test_composition(spark):
    rows = spark.createDataFrame([("e\u0301 a\u0323\u0302",), ("é",), ("\u212b",), (None,)], "x string")
    assert [r.y for r in rows.select(T.composed("x").alias("y")).collect()] == ["é ậ", "é", "\u00c5", None]
