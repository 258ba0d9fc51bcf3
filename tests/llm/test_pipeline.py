from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipe
from loomspark.llm import packing, quality, queries
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_substring import brute
from tests.test_entry import SF, duck, shape  # noqa: F401


def test_stages_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts())], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {i: t for i, t in enumerate(texts()) if quality.measure(t, quality.LineRules())[-1]}
    now = pipe.quality_rules(spark, docs, "").cache()
    assert {r.doc_id: r.text for r in now.collect()} == kept and now.columns == docs.columns
    ids = sorted(kept)
    comp = brute_components([brute_fingerprint(kept[i]) for i in ids])
    first = {i: kept[i] for k, i in enumerate(ids) if comp[k] == k}
    now = pipe.near_duplicates(spark, now, "").cache()
    assert {r.doc_id: r.text for r in now.collect()} == first and now.columns == docs.columns
    removed = dict(zip(first, brute([t.encode() for t in first.values()], 200)))
    now = pipe.repeated_passages(spark, now, "").cache()
    got = {r.doc_id: r for r in now.collect()}
    assert now.columns == docs.columns and set(got) == set(first)
    assert all(len(got[i].text.encode()) == n - cut for i, (n, cut, _, _) in removed.items())
    assert any(cut for _, cut, _, _ in removed.values()) and all(len(r.text) == r.n_chars for r in got.values())
    mixed = pipe.source_mix(spark, now, "").cache()
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
        assert len(r.text) == r.n_chars
    size = defaultdict(int)
    for r in got.values():
        size[r.source] += len(r.text.split())
    assert sum(words.values()) == pytest.approx(1.5 * sum(size.values()), abs=3)
    assert all(words[s] <= 2 * size[s] for s in size)
    packed = pipe.packed_sequences(spark, mixed, "").collect()
    e = packing.WordEncoder(queries.tokenizer_path())
    assert sum(r.length for r in packed) == sum(len(x) // 4 + 1 for x in e.raw([r.text for r in mixed.collect()]))


def texts():
    import random

    r = random.Random(8)
    words = ["".join(r.choice("aeiourstlm") for _ in range(r.randint(2, 8))) for _ in range(900)]
    line = lambda: " ".join(r.choice(words) for _ in range(12)).capitalize() + "."
    shared = " ".join(line() for _ in range(5))
    out = []
    for i in range(60):
        t = "\n".join(line() for _ in range(8))
        out += [t, t.upper()] if i % 10 == 0 else [t + "\n" + shared] if i % 7 == 0 else [t]
    return [*out, out[3], "", "too short", "A | B | C | D " * 20]


def test_failing_lines_of_kept_documents_are_taken_out(spark):
    good = ["The cat sat on the mat near the door.", "Then it slept for a long while, as cats do.", ""]
    bad = ["Home | About | Contact us", "All rights reserved.", "Wow!! Now!!", "READ THIS NOW OR ELSE DEAR", "Menu"]
    rows = ["\n".join(x) for x in (good, [bad[0], *good, bad[1]], [good[0], bad[2], good[1], bad[3]], [good[0], bad[4], "", good[1]], bad)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int")
    got = pipe.quality_rules(spark, docs, "")
    want = {i: "\n".join(x for x in t.split("\n") if x not in bad) for i, t in enumerate(rows[:4])}
    assert got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType and got.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {i: (t, len(t)) for i, t in want.items()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, duck: duckdb.DuckDBPyConnection, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    r = duck.execute(queries.ORACLES[name])
    assert shape(df.columns, [tuple(x) for x in df.collect()]) == shape([x[0] for x in r.description], r.fetchall())


def test_entry_has_all():
    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names and len([n for n in names if n.startswith("op")]) == 10


def test_run_on_awkward_tables(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, columns with names of intermediate ones; then no rows at all."""
    long = ["\n".join(x.split("\n")[:4]) for x in texts()[3:9]]
    rows = [(i, t, "en", "s" if i % 2 else None, len(t), "x", 1) for i, t in enumerate(long)]
    rows += [rows[1], rows[1], (None, long[2] + " And more.", None, None, None, None, None), (None, None, None, None, None, None, None), (99, "", "en", "s", 0, "x", 1), (98, "short", "en", None, 5, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, slot string, size int")
    for name, table in (("some", df), ("none", df.where("false"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = pipe.run(spark, f"{tmp_path}/{name}").collect()
        if name == "none":
            assert not got
            continue
        assert {r.doc_id for r in got} <= {*range(len(long)), None} and len({r.doc_id for r in got}) >= len(long) // 2
        by = defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        for own in by.values():
            own.sort()
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 2048
