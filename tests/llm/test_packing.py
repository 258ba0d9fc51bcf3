import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from loomspark.llm import packing as p
from loomspark.llm.queries import tokenizer_path

ODD = ["  a b", "a\n\nb", "a \n b", "x\ty", "", " ", "don't we'll 's a's", " lead", "tail ", "a b c", "　z q", "<|endoftext|> a b", "a  b", "\n", "é è\nö ü", "a\0b c", "a\x85b c", "\nx", "x\n", "héllo, wörld!? (x) [y]\n\"z\""]


def ids_of(texts):
    """Little-endian ids by a fresh tokenizer with its own settings, text by text."""
    fresh = Tokenizer.from_file(tokenizer_path())
    return [np.array(fresh.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_encoder_equals_the_tokenizer(monkeypatch):
    e = p.WordEncoder(tokenizer_path())
    assert e.encode(ODD) == ids_of(ODD) and e.encode(ODD) == ids_of(ODD)
    assert np.frombuffer(e.encode(["a <|endoftext|> b"])[0], "<u4").tolist() == [64, 220, 50256, 275]
    monkeypatch.setattr(p, "CACHE", 3000)
    monkeypatch.setattr(p, "AT_ONCE", 40)
    many = [f"w{i} x{i} " + "long" * (i % 20) for i in range(200)]
    e = p.WordEncoder(tokenizer_path())
    assert e.encode(many) == ids_of(many) and e.size < 6000 and all(len(w) <= p.LONGEST for w in e.cache)


def test_sum_index():
    """The index against sums made anew, while items are consumed."""
    r = random.Random(5)
    capacity = 40
    index = p.SumIndex({n: r.randint(1, 4) for n in r.sample(range(1, capacity), 20)}, capacity)
    while index.left.any():
        have = [n for n in range(1, capacity + 1) if index.left[n]]
        pairs = Counter(a + b for a, b in itertools.combinations_with_replacement(have, 2) if a != b or index.left[a] > 1)
        triples = Counter()
        for a in have:
            for s, c in pairs.items():
                triples[a + s] += c
        assert index.pairs.tolist() == [pairs[s] for s in range(capacity + 1)]
        assert index.triples.tolist() == [triples[s] for s in range(capacity + 1)]
        held = (r.choice(have),)
        free = Counter({n: int(index.left[n]) for n in have}) - Counter(held)
        for gap in range(1, capacity + 1):
            found = index.complement(gap, held)
            any_is = any(sum(x) == gap and not Counter(x) - free for k in (1, 2, 3) for x in itertools.combinations_with_replacement(have, k))
            assert bool(found) == any_is and (not found or sum(found) == gap and not Counter(found) - free)
        n = r.choice(have)
        index.consume(n, r.randint(1, int(index.left[n])))


def test_plan_fills_exactly():
    r = random.Random(2)
    counts = Counter(min(100, int(r.expovariate(1 / 25)) + 1) for _ in range(5000))
    plan = p.plan_patterns(dict(counts), 100)
    used = Counter()
    for times, lengths in plan:
        assert sum(lengths) <= 100 and times > 0
        for n in lengths:
            used[n] += times
    assert used == counts
    bound = -(-sum(n * c for n, c in counts.items()) // 100)
    assert sum(t for t, _ in plan) <= max(bound * 1.01 + 1, sum(c for n, c in counts.items() if n > 50))


def test_documents(spark):
    texts = [*ODD, None, "long " * 7000, *["same text"] * 40, *[" ".join(["ab"] * i) for i in range(1, 300)]]
    ids = [i if i % 9 else None for i in range(len(texts))]
    df = spark.createDataFrame([(a, b, "clash") for a, b in zip(ids, texts)], "doc_id long, text string, piece string")
    got = p.pack_documents(df, tokenizer_path()).collect()
    want = Counter()
    for d, raw in zip(ids, ids_of([t or "" for t in texts])):
        raw += bytes(4)
        n = len(raw) // 4
        pieces = [(0, n)] if n <= 2048 else [(0, n % 2048 or 2048)] + [(s, 2048) for s in range(n % 2048 or 2048, n, 2048)]
        want.update((d, i, s, k, zlib.crc32(raw[4 * s : 4 * (s + k)])) for i, (s, k) in enumerate(pieces))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    rows = defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    for own in rows.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    assert len(rows) <= np.ceil(sum(r.length for r in got) / 2048) + 1
    assert p.pack_documents(df.where("false"), tokenizer_path()).count() == 0
