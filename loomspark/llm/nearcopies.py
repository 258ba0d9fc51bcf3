"""Near copies by SimHash and covering masks, each link verified on shingle sets, and an exact way for the pairs beyond the masks' radius.

A text is the set of its word shingles (64-bit XXH64 hashes, seed 42); two texts link if the Jaccard similarity of their sets is at least
``percent``. Components of links are groups.

First comes operator 1's method: SimHash fingerprints of the shingles, covering masks for ``RADIUS`` differing bits, a star in each connected group
of a bucket. At 0.8, fingerprints differ in about 10 of 64 bits, too many for covering masks, so the rest comes from prefixes: under any one
order of all shingles, two sets that similar share a shingle among the first n - ceil(percent of n) + 1 of each. No pair is missed.

Every link is verified on the whole sets. Before texts are dealt, pairs that can't link are told by sketches: the parity of the number of a
set's shingles in each of about 2n cells. Cells that differ are no more than shingles that differ, so no link is lost.

The order has common shingles last: each task counts its own shingles in chunks, the ``COMMON`` most frequent sums (a fixed number) go to
the driver, and the others come before them by hash. Counts may be partial; the order is one order all the same.

Equal sets are one. Each bucket (sets with a shingle in their prefixes) proposes its smallest to its members; a set is compared with the smallest
that its sketch allows, which joins large groups without their pairs. Then all pairs of one bucket that are still in different components are compared.

Defined results: as in ``simhash``: lower-casing covers A-Z only, a text with fewer than ``words`` words has one shingle, and null, empty
or blank texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import discard, materialise, utf8
from loomspark.llm.simhash import _LOWER, components, star_links

COMMON, CHUNK, OFTEN = 1 << 18, 1 << 21, 16
#: Differing bits that the masks cover, the most cells of a sketch, and parts that the pairs of one set are dealt into.
RADIUS, CELLS, PARTS = 3, 1 << 15, 16


def hashes(data: bytes | None, words: int = 5) -> np.ndarray:
    """The hashes of a UTF-8 text's shingles, in the text's order, unsigned; null is empty."""
    own = (data or b"").translate(_LOWER).split()
    joined, n = b" ".join(own), len(own) - words + 1
    h = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([h(joined, 42)], dtype=np.uint64)
    ends = list(accumulate(map(len, own), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)][:n]
    return np.array([h(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :], strict=True)], dtype=np.uint64)


def shingles(data: bytes | None, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles."""
    return np.unique(hashes(data, words).view(np.int64))


def majority(h: np.ndarray) -> int:
    """The SimHash fingerprint of a text's shingle hashes, as a signed long."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        counts += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def sketch(s: np.ndarray) -> bytes:
    """A bit for each of at least 64 and at most ``CELLS`` cells: 1 if an odd number of the set's shingles is in it."""
    cells = min(CELLS, max(64, 1 << (2 * len(s) - 1).bit_length()))
    return np.packbits(np.bincount(s & (cells - 1), minlength=cells) & 1, bitorder="little").tobytes()


def unlike(x: bytes, y: bytes) -> int:
    """In how many cells two sketches differ, the larger folded to the smaller: at most the number of shingles in one set only."""
    small, large = (np.frombuffer(k, dtype=np.uint64) for k in sorted((x, y), key=len))
    return int(np.bitwise_count(small ^ np.bitwise_xor.reduce(large.reshape(-1, len(small)), axis=0)).sum())


def set_keys(src: DataFrame, words: int) -> DataFrame:
    """src: (_loom_d, _loom_h, _t), texts as bytes. Rows (_loom_d, _loom_h, key, n, fp, sk): key names the text's set of n shingles; its fingerprint and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = []
                for x in b.column(2):
                    h = hashes(x.as_py(), words)
                    s = np.unique(h.view(np.int64))
                    rows.append((key_of(s), len(s), majority(h), sketch(s)))
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["_loom_d", "_loom_h", "key", "n", "fp", "sk"])

    return src.mapInArrow(run, f"_loom_d {src.schema[0].dataType.simpleString()}, _loom_h long, key long, n int, fp long, sk binary")


def key_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 7)).view(np.int64))


def common_shingles(src: DataFrame, words: int) -> np.ndarray:
    """At most ``COMMON`` frequent shingles, the most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[c > 1]), pa.array(c[c > 1].astype(np.int64))], ["h", "c"])

        for b in batches:
            for text in b.column(0):
                held.append(shingles(text.as_py(), words))
                size += len(held[-1])
                if size > CHUNK:
                    yield counted()
                    held, size = [], 0
        yield counted()

    counts = src.select("_t").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(f"c >= {OFTEN}")
    rows = counts.orderBy(F.col("c").desc(), "h").limit(COMMON).toPandas()
    return rows["h"].to_numpy(dtype=np.int64)[::-1].copy()


def prefix(s: np.ndarray, names: np.ndarray, places: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of the sorted set s that come first; names: sorted common shingles, places: their places among the common."""
    n = len(s)
    take = n - (percent * n + 99) // 100 + 1
    if not len(names):
        return s[:take]
    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
    place = np.where(names[at] == s, places[at] + 1, 0)
    return s[np.lexsort((s, place))[:take]]


def prefix_rows(src: DataFrame, words: int, common: np.ndarray, percent: int) -> DataFrame:
    """Rows (bucket, key, n): a row for each shingle in the prefix of the set (key, n); equal sets of one task are told once."""
    order = np.argsort(common)
    names = common[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                got, keys, sizes = [np.zeros(0, np.int64)], [0], [0]
                for x in whole.column(0).slice(at, 256):
                    s = shingles(x.as_py(), words)
                    key = key_of(s)
                    if key not in told:
                        told.add(key)
                        got.append(prefix(s, names, order, percent))
                        keys.append(key)
                        sizes.append(len(s))
                each = np.array([len(g) for g in got], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got)), pa.array(np.repeat(np.array(keys, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int32), each))], ["bucket", "key", "n"])

    return src.select("_t").mapInArrow(run, "bucket long, key long, n int")


def buckets_of(src: DataFrame, words: int, common: np.ndarray, percent: int) -> DataFrame:
    """Rows (bucket, m): the sets (key, n) that have the shingle ``bucket`` in their prefixes, each once, two or more.

    Nearly all buckets of a task are its own: gathered before they are dealt, they would take a task's rows as objects and sorted pages for nothing.
    """
    rows = prefix_rows(src, words, common, percent).repartition("bucket")
    return rows.groupBy("bucket").agg(F.collect_set(F.struct("key", "n")).alias("m")).where(F.size("m") > 1)


def near_fingerprints(best: DataFrame) -> DataFrame:
    """Rows (a, b): keys of sets whose fingerprints are equal, or linked by a star of operator 1's buckets."""
    roots = materialise(best.groupBy(F.col("m.fp").alias("fp")).agg(F.min("key").alias("root")), "roots")
    of = lambda c: roots.select(F.col("fp").alias(c), F.col("root").alias(f"root_{c}"))
    stars = star_links(roots.select("fp"), RADIUS).join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    same = best.select("key", F.col("m.fp").alias("fp")).join(roots, "fp").where("key <> root").select(F.col("root").alias("a"), F.col("key").alias("b"))
    return stars.union(same)


def possible(pairs: DataFrame, best: DataFrame, percent: int) -> DataFrame:
    """pairs: (a, b). Those whose sizes and sketches allow a link."""
    of = lambda c: best.select(F.col("key").alias(c), F.col("m.n").alias(f"n{c}"), F.col("m.sk").alias(f"k{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb")).select("a", "b", "na", "nb", "ka", "kb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column(2)).astype(np.int64) + np.asarray(batch.column(3))
            apart_by = np.array([unlike(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array((100 + percent) * apart_by <= (100 - percent) * n))

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, src: DataFrame, best: DataFrame, words: int, percent: int) -> DataFrame:
    """pairs: (a, b). Those whose sets are similar enough; sets are made anew from the text that stands for each key in ``best``.

    Texts are dealt, not sets, which are larger: b's to each pair, a's once to each part of its pairs.
    """
    pairs = materialise(pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS))), "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    stands = best.join(named, "key", "left_semi").select("key", F.col("m._loom_d").alias("_d"), F.col("m._loom_h").alias("_h"))
    texts = src.join(stands, src["_loom_d"].eqNullSafe(stands["_d"]) & (src["_loom_h"] == stands["_h"])).select("key", "_t")
    wanted = materialise(texts.dropDuplicates(["key"]), "wanted")
    one = lambda k: wanted.select(F.col("key").alias(k), F.col("_t").alias(f"t{k}"))
    hubs = pairs.select("a", "part").distinct().join(one("a"), "a")
    both = pairs.join(one("b"), "b").join(hubs, ["a", "part"]).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.int64)
        for batch in batches:
            alike = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, own = a, shingles(ta.as_py(), words)
                other = shingles(tb.as_py(), words)
                i = len(np.intersect1d(own, other, assume_unique=True))
                alike.append(100 * i >= percent * (len(own) + len(other) - i))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    out = materialise(both.mapInArrow(run, "a long, b long"), "links")
    discard(pairs, wanted)
    return out


def apart(members: DataFrame, percent: int) -> DataFrame:
    """members: (m), lists of (key, n, label) of one bucket. Rows (a, b): pairs of different labels whose sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            fields, offsets = column.values, np.asarray(column.offsets)
            key, n, label = (np.asarray(fields.field(i)) for i in range(3))
            for s, e in zip(offsets[:-1], offsets[1:], strict=True):
                names, own, sizes = np.unique(label[s:e], return_inverse=True, return_counts=True)
                rank = np.empty(len(names), np.int64)
                rank[np.argsort(-sizes)] = np.arange(len(names))
                r, k, c = rank[own], key[s:e], n[s:e].astype(np.int64)
                for i in np.flatnonzero(r > 0):  # each member outside of the largest group, with those of groups before its own
                    fit = (r < r[i]) & (100 * np.minimum(c, c[i]) >= percent * np.maximum(c, c[i]))
                    if fit.any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(k[fit], k[i])), pa.array(np.maximum(k[fit], k[i]))], ["a", "b"])

    return members.mapInArrow(run, "a long, b long").distinct()


def labelled(src: DataFrame, best: DataFrame, words: int, percent: int) -> DataFrame:
    """src: (_loom_d, _loom_h, _t); best: (key, m), the text that stands for each set. Rows (key, label): sets with a link, and their component."""
    links = verified(possible(near_fingerprints(best), best, percent), src, best, words, percent)
    labels = materialise(components(links), "labels")
    buckets = materialise(buckets_of(src, words, common_shingles(src, words), percent), "buckets")
    least = F.array_min("m")
    stars = buckets.select(least.alias("l"), F.explode("m").alias("x")).where("x.key <> l.key").where(F.least("x.n", "l.n") * 100 >= percent * F.greatest("x.n", "l.n"))
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    stars = stars.select(F.col("l.key").alias("a"), F.col("x.key").alias("b")).distinct().join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(_a, a) <> coalesce(_b, b)")
    first = possible(stars.select("a", "b"), best, percent).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = links.union(verified(first, src, best, words, percent))
    labels = components(links)
    members = buckets.select("bucket", F.explode("m").alias("x")).select("bucket", "x.*").join(labels.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", "n", F.coalesce("label", "key").alias("label"))
    mixed = members.repartition("bucket").groupBy("bucket").agg(F.collect_list(F.struct("key", "n", "label")).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("m")
    more = verified(possible(apart(mixed, percent), best, percent), src, best, words, percent)
    discard(buckets)
    if not more.isEmpty():
        labels = components(links.union(more))
    return labels.withColumnRenamed("node", "key")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """The document with the smallest doc_id of each group (nulls last, then by text hash); of equal rows one. Columns stay.

    Shingle sets are as large as the texts: they are made from the texts in each pass that needs them, and only texts of candidates are written.
    """
    marks = ["_loom_d", "_loom_h"]
    keyed = docs.withColumns({"_loom_d": F.col("doc_id"), "_loom_h": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    src = keyed.select(*marks, utf8(text).alias("_t"))
    every = materialise(set_keys(src, words), "every-key")
    first = F.min(F.struct(F.col("_loom_d").isNull().alias("none"), "_loom_d", "_loom_h", "n", "fp", "sk")).alias("m")
    best = materialise(every.groupBy("key").agg(first), "set-keys")
    labels = labelled(src, best, words, percent)
    chosen = best.select("key", F.struct("m.none", "m._loom_d", "m._loom_h").alias("m")).join(labels, "key", "left").groupBy(F.coalesce("label", "key").alias("label")).agg(F.min("m").alias("m")).select(F.col("m._loom_d").alias("_d"), F.col("m._loom_h").alias("_h"))
    kept = keyed.join(chosen, keyed["_loom_d"].eqNullSafe(chosen["_d"]) & (keyed["_loom_h"] == chosen["_h"]), "left_semi")
    if not every.groupBy(*marks).count().where("count > 1").isEmpty():  # equal rows
        kept = kept.dropDuplicates(marks)
    return kept.drop(*marks)
