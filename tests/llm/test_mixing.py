from collections import defaultdict

from loomspark.llm import mixing as m


def rows(spark):
    data = [(i, "w " * (i % 50), ["a", "b", "c", None, "hot"][i % 5 if i % 3 else 4], 1) for i in range(300)]
    data += [(7, "x y z", "a", 1)] * 2 + [(None, "q r", "tiny", 1), (1000, "word " * 30_000, "c", 1), (1001, None, "b", 1)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, target int")


def test_taken(spark):
    df = rows(spark)
    got = m.mix(df, block=64).collect()
    assert len(got) == df.count()
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by[r.source_size, r.target].append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1
    for (size, target), own in by.items():
        assert sum(r["size"] for r in own) == size
        assert abs(sum(r.taken for r in own) - target) <= 1 and target <= 2 * size
    assert sorted(map(str, got)) == sorted(map(str, m.mix(df.repartition(3), block=64).collect()))
    assert m.mix(df.where("false")).count() == 0


def test_schedule_keeps_shares_at_all_times(spark):
    sources = spark.createDataFrame([(0, 5000), (1, 2500), (2, 1300)], "sidx long, words long")
    slots = sorted((r.slot, r.sidx, r.block, r.n_words) for r in m.schedule(sources, 10).collect())
    assert len({x[0] for x in slots}) == len(slots) == 880
    for i, words in ((0, 5000), (1, 2500), (2, 1300)):
        own = [x for x in slots if x[1] == i]
        assert [x[2] for x in own] == list(range(len(own))) and sum(x[3] for x in own) == words
        seen = 0
        for at, x in enumerate(slots, 1):
            seen += x[1] == i
            assert abs(seen - at * words / 8800) < 12


def test_mixed_documents(spark):
    df = rows(spark)
    out = m.mixed_documents(df, block=64)
    assert out.columns == df.columns
    taken = defaultdict(int)
    for r in m.mix(df, block=64).collect():
        taken[r.doc_id] += r.taken
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += len((r.text or "").split())
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_the_mix_is_in_order(spark):
    """What the rows of the mix are sorted by: any beginning of it holds each source's share, and slots agree with mix."""
    data = [(i, "w " * (5 + i % 40), "abc"[i % 3], len("w " * (5 + i % 40))) for i in range(1500)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars int")
    out = m.mixed_documents(df, block=64).collect()
    targets = {r.source: r.words for r in m.targets(df.select("source", m.word_count("text").alias("size"))).collect()}
    total, seen, so_far = sum(targets.values()), defaultdict(int), 0
    for r in out:
        seen[r.source] += len(r.text.split())
        so_far += len(r.text.split())
        assert r.n_chars == len(r.text)
        for s, t in targets.items():
            assert abs(seen[s] - so_far * t / total) < 64 * 12
    assert so_far == total
    first = {r.doc_id: r.first_slot for r in m.mix(df, block=64).collect()}
    met = []
    for r in out:
        if r.doc_id not in met:
            met.append(r.doc_id)
    assert [first[d] for d in met] == sorted(first[d] for d in met)
