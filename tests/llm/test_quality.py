import random
import tracemalloc
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import quality as q


def brute_repeats(words, size=5):
    at = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    hit = {j for i, w in enumerate(at) if at.count(w) > 1 for j in range(i, i + size)}
    return len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words(words):
    assert q.repeated_words(words) == brute_repeats(words)


def test_measures(spark):
    good = "The cat sat on the mat near the door.\nThen it slept for a long while, as cats do."
    rows = [(1, good), (2, None), (3, ""), (4, "HELLO!! NOW!! " * 30), (5, " | ".join("abcdefghijklmnop")), (6, "a b\na b\n\n \nx"), (7, "word " * 100_000), (None, good), (1, good)]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc_id long, text string, n_words string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_dup_lines, r.base_failed, r.kept) for r in q.measures(df).collect()))
    assert [x for x in got if x[0] == 1] == [(1, 19, 0, False, True)] * 2
    assert [x[4] for x in got if x[0] in (2, 3, 4, 5, 7)] == [False] * 5
    assert [x[1:4] for x in got if x[0] == 6] == [(5, 1, True)]
    assert q.measures(df.where("false")).count() == 0
    kept = q.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 3


def test_lines():
    rules = q.LineRules()
    fails = lambda s: q.line_fails(s, len(s.split()), rules)
    assert fails("Home | About | Contact us") and fails("All rights reserved.") and fails("READ THIS NOW OR ELSE DEAR") and fails("Menu")
    assert not fails("A sentence that ends well.") and not fails("a long line of many words without an end mark")
    assert q.clean_text("Menu\nA good line here.") == "A good line here."


def test_repeated_words_of_long_and_awkward_texts():
    def brute(words, size=5):
        windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        counts = Counter(windows)
        return len({j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + size)})

    r = random.Random(8)
    for _ in range(500):
        words = [r.choice("abcd"[: r.randint(1, 4)]) if r.random() < 0.8 else str(r.random()) for _ in range(r.randint(0, 60))]
        assert q.repeated_words(words) == brute(words)
    words = [f"w{r.randrange(10**6)}" for _ in range(300_000)]
    tracemalloc.start()
    assert q.repeated_words(words + words[:5]) == 10
    assert tracemalloc.get_traced_memory()[1] < 60 * len(words) + (80 << 20)
    tracemalloc.stop()
    assert q.repeated_words(["x"] * 200_000) == 200_000
