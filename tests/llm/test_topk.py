import math
import random

import numpy as np
import pytest

from loomspark.llm import topk as t


def brute(rows, k, every):
    ok = [(i, v, [math.floor(256 * x) for x in e]) for i, (v, e) in enumerate(rows) if e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, q in ok:
        if v is None or v % every:
            continue
        best = sorted((-sum(a * b for a, b in zip(q, c)), w if w is not None else 1 << 62) for j, w, c in ok if j != i and len(c) == len(q))
        out += [(v, r, w if w < 1 << 62 else None, -s) for r, (s, w) in enumerate(best[:k], 1)]
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(6)]) for i in range(400)]
    rows += [(400, [0.5, float("nan")] * 3), (450, None), (500, []), (550, [0.0] * 6), (600, [1.0, -2.0]), (601, [0.5, 0.5]), (None, [0.1] * 6), (50, [0.2] * 6), (50, [0.2] * 6), (700, [None] * 6)]
    rows += [(1000 + i, [0.25] * 6) for i in range(60)]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id long, embedding array<float>, rank int")
    f32 = [(r_.vec_id, r_.embedding) for r_ in df.collect()]
    monkeypatch.setattr(t, "BLOCK", 16)
    monkeypatch.setattr(t, "TILE", 3)
    got = [(x.query_id, x["rank"], x.vec_id, x.score) for x in t.top_k(df, strip=64, query_block=4).collect()]
    assert sorted(got, key=str) == brute(f32, 5, 50)
    assert t.top_k(df.where("false")).count() == 0


def test_bounds_close_and_hold():
    """Reading stops early on long lists, and no candidate of the k best is lost; carried bounds leave blocks unread."""
    r = np.random.default_rng(1)
    v = np.floor(256 * r.normal(0, 0.125, (4 * t.BLOCK, 64))).astype(np.int64)
    q, _, row, score = t.strip_top(np.arange(0, len(v), 64), v[::64], np.arange(len(v)), np.arange(len(v)), v, 5)
    s = v[::64] @ v.T
    s[np.arange(len(s)), np.arange(0, len(v), 64)] = np.iinfo(np.int64).min
    assert (score.reshape(-1, 5) == np.sort(s, axis=1)[:, ::-1][:, :5]).all()
    lists = t.SortedLists(v[: t.BLOCK])
    own = np.full(len(s), -1)
    at, _ = lists.in_question(v[::64].astype(float), 5, score.reshape(-1, 5)[:, 4].astype(float), own)
    assert len(at) < 0.1 * len(s) * t.BLOCK
    assert not len(lists.in_question(v[::64].astype(float), 5, np.full(len(s), 1e9), own)[0])


def test_a_score_beyond_a_long_is_an_error():
    big = np.full((2, 4), 1 << 40)
    with pytest.raises(ValueError):
        t.strip_top(np.arange(2), big, np.arange(2), np.arange(2), big, 5)
