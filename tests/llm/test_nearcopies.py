import random

import corpus_pipeline as pipe
from loomspark.llm import nearcopies as n
from loomspark.llm.simhash import fingerprint


def grams(t):
    w = (t or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(texts, percent=80):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def edited():
    r = random.Random(4)
    words = ["".join(r.choice("aeiourstlm") for _ in range(5)) for _ in range(3000)]
    some = lambda k: [r.choice(words) for _ in range(k)]
    shared, out = some(40), []
    for i in range(25):
        base = some(r.randint(30, 200)) + (shared if i % 3 else [])
        out.append(" ".join(base))
        for _ in range(i % 5):
            t = list(base)
            for _ in range(r.randint(1, 6)):
                t[r.randrange(len(t))] = r.choice(words)
            if r.random() < 0.4:
                at = r.randrange(len(t))
                t[at:at] = some(r.randint(3, 25))
            out.append(" ".join(t))
    return [*out, out[0], out[1].upper(), None, "", "one two", "one two", "one three"]


def test_edited_copies_against_brute_force(spark):
    texts = edited()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipe.near_duplicates(spark, docs, "")
    want = sorted(set(brute(texts)))
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want
    assert len(want) < len({grams(t) for t in texts}) - 5  # more than equal sets
    assert n.one_of_each(docs.where("false")).count() == 0
    again = n.one_of_each(docs.union(docs.where("doc_id < 9")))
    assert sorted(r.doc_id for r in again.collect()) == want


def test_order_of_common_shingles_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(n, "OFTEN", 2)
    texts = edited()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    src = docs.selectExpr("doc_id _loom_d", "0L _loom_h", "cast(text as binary) _t")
    assert len(n.common_shingles(src, 5)) > 30
    assert sorted(r.doc_id for r in n.one_of_each(docs).collect()) == sorted(set(brute(texts)))


def test_sketches_lose_no_link():
    r = random.Random(6)
    for size in (1, 2, 5, 40, 300, 30000):
        whole = n.np.unique(n.np.array([r.getrandbits(64) - (1 << 63) for _ in range(size)], dtype=n.np.int64))
        for share in (0.0, 0.05, 0.3, 1.0):
            other = n.np.unique(n.np.array([r.getrandbits(64) - (1 << 63) if r.random() < share else int(x) for x in whole if r.random() > share / 3] or [1], dtype=n.np.int64))
            apart = len(n.np.setxor1d(whole, other))
            assert n.unlike(n.sketch(whole), n.sketch(other)) == n.unlike(n.sketch(other), n.sketch(whole)) <= apart
            assert share or not apart
    far = [n.np.unique(n.np.array([r.getrandbits(64) - (1 << 63) for _ in range(300)], dtype=n.np.int64)) for _ in range(2)]
    assert 180 * n.unlike(*map(n.sketch, far)) > 20 * 600 and len(n.sketch(far[0])) == 128


def test_texts_go_to_few_pairs(spark, monkeypatch):
    """A set is dealt to one pair, not to one in each of its buckets; what is written are texts, not sets."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeiourstlm") for _ in range(5))
    base = [word() for _ in range(200)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(3):
            t[r.randrange(200)] = word()
        texts.append(" ".join(t))
    assert len(set(texts)) == 60
    real, rows = n.materialise, {}

    def told(df, name):
        out = real(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(n, "materialise", told)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in n.one_of_each(docs).collect()) == sorted(set(brute(texts)))
    assert sum(rows["pairs"]) <= 3 * 60


def test_links_of_fingerprints_come_first(spark, monkeypatch):
    """Operator 1's fingerprints and masks propose links; the pairs that they miss come from prefixes."""
    texts = [t for t in dict.fromkeys(edited()) if t]
    for t in [t for t in texts if len(t.split()) > 120][:9]:
        texts += [f"{t} one", f"{t} one two"]
    src = spark.createDataFrame([(i, 0, t.encode()) for i, t in enumerate(texts)], "_loom_d long, _loom_h long, _t binary")
    every = n.set_keys(src, 5)
    rows = every.collect()
    assert all(x.fp % (1 << 64) == fingerprint(texts[x._loom_d].encode(), 5) for x in rows)
    best = n.materialise(every.groupBy("key").agg(n.F.min(n.F.struct("_loom_d", "_loom_h", "n", "fp", "sk")).alias("m")), "best")
    pairs = [(x.a, x.b) for x in n.near_fingerprints(best).collect()]
    fps = {x.key: x.fp % (1 << 64) for x in rows}
    keys = sorted(fps)

    def joined(links):
        root = {k: k for k in keys}
        for a, b in links:
            old, new = root[b], root[a]
            root = {k: new if v == old else v for k, v in root.items()}
        return {frozenset(k for k in keys if root[k] == v) for v in root.values()}

    near = [(a, b) for a in keys for b in keys if a < b and (fps[a] ^ fps[b]).bit_count() <= n.RADIUS]
    assert near and joined(pairs) == joined(near)
    asked = []
    real = n.verified
    monkeypatch.setattr(n, "verified", lambda p, *a: asked.append({frozenset((x.a, x.b)) for x in p.collect()}) or real(p, *a))
    n.labelled(src, best, 5, 80).count()
    assert asked[0] and asked[0] <= {frozenset(p) for p in pairs} and asked[1]


def test_rows_of_buckets_are_dealt_before_they_are_gathered(spark):
    """No task gathers its own rows first, and equal sets of one task are told once; the buckets are those of plain Python."""
    texts = [t or "" for t in edited()]
    src = spark.createDataFrame([(t.encode(),) for t in texts * 3], "_t binary").coalesce(1)
    none = n.np.zeros(0, n.np.int64)
    sets = {n.key_of(s): s for s in (n.shingles(t.encode()) for t in texts)}
    want: dict[int, set[int]] = {}
    for key, s in sets.items():
        for b in n.prefix(s, none, none, 80):
            want.setdefault(int(b), set()).add(key)
    assert n.prefix_rows(src, 5, none, 80).count() == sum(map(len, want.values()))
    buckets = n.buckets_of(src, 5, none, 80)
    plan = buckets._jdf.queryExecution().sparkPlan().toString().split("\n")
    deals = next(i for i, line in enumerate(plan) if "RepartitionByExpression" in line or "Exchange" in line)
    assert sum("Aggregate" in line for line in plan[:deals]) == 2 and not any("Aggregate" in line for line in plan[deals:])
    got = {r.bucket: {x.key for x in r.m} for r in buckets.collect()}
    assert got == {b: m for b, m in want.items() if len(m) > 1} and got
