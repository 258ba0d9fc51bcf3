import random

import numpy as np
import xxhash

from loomspark.llm import simhash as s


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    arr = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_masks_cover_every_pair():
    masks = s.covering_masks(2, list(range(64)))
    assert len(masks) == 7
    for a in range(64):
        for b in range(64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_documents(spark):
    base = " ".join(f"w{i % 37}" for i in range(200))
    rows = [(9, base), (4, base.upper()), (7, base + " x"), (3, None), (2, ""), (1, "one"), (None, base), (5, "one two"), (5, "one two"), (6, "Éa É b c")]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, fp int")
    got = s.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    want = sorted((d if d is not None else -1, f"{f:016x}", min(rows[j][0] for j in range(len(rows)) if comp[j] == c and rows[j][0] is not None)) for (d, _), f, c in zip(rows, fps, comp))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in got) == want
    assert s.near_duplicates(df.where("false")).count() == 0
    kept = s.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want})


def test_hot_bucket_is_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(s, "LOCAL", 8)
    r = random.Random(1)
    base, fps = r.getrandbits(64), {0}
    while len(fps) < 1500:
        x = base
        for _ in range(r.randint(0, 9)):
            x ^= 1 << r.randrange(64)
        fps |= {x, r.getrandbits(64)} if r.random() < 0.3 else {x}
    fps = sorted(fps)
    got = {x.fp: x.label for x in s.grouped(spark.createDataFrame([(s._signed(x),) for x in fps], "fp long")).collect()}
    groups = lambda labels: sorted(sorted(f for f, v in zip(fps, labels) if v == one) for one in set(labels))
    assert groups(brute_components(fps)) == groups([got[s._signed(f)] for f in fps])
