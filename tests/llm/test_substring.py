import hashlib
import random
from collections import Counter

from loomspark.llm import substring as s


def brute(texts, length):
    c = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if c[t[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        kept = bytes(a for a, x in zip(t, mark) if not x)
        out.append((len(t), sum(mark), sum(1 for i, x in enumerate(mark) if x and (i == 0 or not mark[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    r = random.Random(5)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 5))) for _ in range(300)]
    base = [" ".join(r.choice(words) for _ in range(300)) for _ in range(5)]
    noise = lambda n: "".join(r.choice("abcdef ") for _ in range(n))
    texts = [None, "", "a" * 1000, "ab" * 150, "x" * 199, "x" * 200, "x" * 201]
    for i in range(70):
        t = r.choice(base)
        a = r.randint(0, 600)
        texts.append([t, t[:a] + "Z" + t[a + 1 :], noise(r.randint(0, 400)) + t[a : a + r.randint(180, 420)] + noise(r.randint(0, 400)), noise(r.randint(100, 1400))][i % 4])
    return texts


def test_against_brute_force(spark, monkeypatch):
    texts = corpus()
    want = brute([(t or "").encode() for t in texts], 200)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, doc string")
    for part in (s.PART, 700):
        monkeypatch.setattr(s, "PART", part)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.remove_repeats(df).collect()}
        assert got == dict(enumerate(want))


def test_repeated_rows_nulls_and_cleaning(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(400))
    df = spark.createDataFrame([(1, long), (1, long), (None, long + "!"), (None, "short"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed) for r in s.remove_repeats(df).collect()))
    assert got == [(0, 5, 0), (0, 401, 400), (1, 400, 400), (1, 400, 400), (2, 0, 0)]
    assert sorted(str(r.text) for r in s.without_repeats(df).collect()) == ["", "", "!", "None", "short"]
    assert s.remove_repeats(df.where("false")).count() == 0


def test_a_long_text_of_one_letter(spark):
    """Every window is repeated: one removed run, gathered as one."""
    n = 3_000_000
    df = spark.createDataFrame([(1, "a" * n), (2, "unlike")], "doc_id long, text string")
    spans = s.repeated_spans(s.texts_of(df), 200).collect()
    assert [[(x.start, x.end) for x in r.spans] for r in spans] == [[(0, n)]]
