import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()["y"]


CASES = [
    (T.document_number, " 66 / 2025 / nđ – cp ", "66/2025/NĐ-CP"),
    (T.graph_number, " 66 / 2025 / nđ – cp ", "66/2025/NĐ–CP"),
    (T.document_number, "  ", None),
    (T.safe_id, "Điều 12a", "ieu_12a"),
    (T.ascii_id, "a b-1", "a_b_1"),
    (T.looks_like_title, "QUY ĐỊNH CHUNG", True),
    (T.looks_like_title, "Quy định chung", False),
    (T.looks_like_title, "", False),
    (T.flatten, "a ,b\nc", "a,b c"),
    (T.flatten, None, ""),
    (T.clean_table, "| A |  B |\n|---|:-:|\n| 1 | 2 |", "A; B. 1; 2"),
    (lambda c: T.split_long(c, 8), "aaa. bbb. ccc", ["aaa.", "bbb. ccc"]),
    (lambda c: T.split_long(c, 5), "abcdefgh ij", ["abcde", "fgh", "ij"]),
    (T.relation, "amends / repeal", "AMENDS_REPEAL"),
    (T.relation, "", "REFERS_TO"),
    (T.weight, "nan", 1.0),
    (T.weight, "x", 1.0),
    (T.weight, "2", 2.0),
    (T.id_list, '["a","b"]', ["a", "b"]),
    (T.id_list, "['a', 'b']", ["a", "b"]),
    (T.id_list, "a, b", ["a", "b"]),
    (T.id_list, "5", ["5"]),
    (T.relevant_ids, "a|b,c", ["a", "b,c"]),
    (T.viewer_id, "123.0", "123"),
    (T.viewer_id, "-5.0", "-5"),
    (T.viewer_id, "1.5", "1.5"),
    (T.viewer_id, "", None),
    (T.normalize_text, "a \r\n\r\n\r\n\r\n b\t c ", "a\n\nb c"),
    (T.clause_numbers, "khoản 2, Khoản 3A Điều 4", ["2", "3a"]),
    (T.query_phrases, "học phí", ["học phí"]),
    (T.query_phrases, "học", []),
    (T.contains_refusal, "Tôi KHÔNG  thể trả lời.", True),
    (T.degenerate, "a\nA\n a ", True),
    (T.degenerate, "", True),
    (T.degenerate, "a\nb\na", False),
    (T.text_or_placeholder, " NaN ", "[EMPTY LEGAL CHUNK]"),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_values(spark, case):
    f, value, want = CASES[case]
    assert one(spark, value, f) == want


def test_stable_id_and_sectors(spark):
    row = spark.createDataFrame([(1, "__NO_PART__", [" Thuế ", "Giáo  dục"])], "d long, p string, s array<string>")
    assert row.select(T.stable_id("part", "d", "p")).first()[0] == "part:c428bf2b0cbe74ce7c56"
    assert row.select(T.sector_matches("s", "GIÁO DỤC"), T.sector_matches("s", " ")).first()[:] == (True, False)
    assert row.select(T.json_list(F.array(F.lit("b"), F.lit(""), F.lit("a"), F.lit("b")))).first()[0] == '["b","a"]'
