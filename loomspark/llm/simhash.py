"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits: bit i is 1 if it is set in over half of the XXH64 values (seed 42) of a text's word shingles.
Fingerprints at ``radius`` or fewer differing bits are linked. Each bit gets one of 2^(radius+1)-1 non-zero classes c(i);
table v keeps the bits with odd parity of v & c(i). The classes of at most ``radius`` differing bits span too few
dimensions to fill the space, so some v is orthogonal to all of them: in that table the differing bits are all cleared
and the pair collides. No pair within the radius is missed, and every collision is verified.

Work follows distinct fingerprints. A bucket of more than ``LOCAL`` of them is dealt again by the same construction over
the bits that its table clears, which leaves at most 2^12 distinct fingerprints a bucket by counting alone (radius 2): no
cap is needed. Inside a bucket only a star per connected group is emitted, never all pairs. Components come from
alternating large-star and small-star steps, each written to the shared folder.

Defined results: lower-casing covers A-Z only. A text with fewer than ``words`` words has one shingle, the whole sequence;
null, empty or blank texts have fingerprint zero and link like any other. component_id is the smallest doc_id
reachable, null doc_ids passed over (null if there is no other). Repeated rows and ids give a row each; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import materialise, utf8

LOCAL = 1024
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(data: bytes, words: int = 3) -> int:
    """The fingerprint of a UTF-8 text, unsigned. bytes.split() splits at exactly the ASCII white space."""
    own = data.translate(_LOWER).split()
    if not own:
        return 0
    joined, n = b" ".join(own), len(own) - words + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = list(accumulate(map(len, own), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)][:n]
    h = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        hashes = np.array([h(joined[s:e], 42) for s, e in zip(starts[at : at + 65536], ends[at + words - 1 : at + words - 1 + 65536], strict=False)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", words: int = 3) -> DataFrame:
    """``keep`` columns and fp, the fingerprint as a signed long."""
    src = docs.select(*keep, utf8(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), words) for x in b.column(b.num_columns - 1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], [*b.schema.names[:-1], "fp"])

    return src.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", fp long")


def covering_masks(radius: int, bits: list[int]) -> list[int]:
    """2^(radius+1)-1 masks over ``bits`` such that any ``radius`` of them are cleared together by some mask."""
    top = 2 ** (radius + 1)
    return [sum(1 << b for i, b in enumerate(bits) if (v & (1 + i % (top - 1))).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of the connected groups among distinct fingerprints."""
    n = len(members)
    near = np.empty((n, n), dtype=bool)
    for at in range(0, n, 512):
        near[at : at + 512] = np.bitwise_count(members[at : at + 512, None] ^ members[None, :]) <= radius
    label = np.arange(n)
    if near.sum() == n:
        return members[:0], members[:0]
    rows, cols = np.nonzero(np.triu(near, 1))
    while True:
        low = np.minimum(label[rows], label[cols])
        new = label.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, cols, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(n)
    return members[moved], members[label[moved]]


def star_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """fps: distinct fp. Rows (a, b): edges that connect exactly what links within ``radius`` connect."""
    first = covering_masks(radius, list(range(64)))
    second = [covering_masks(radius, [b for b in range(64) if not m >> b & 1]) for m in first]
    lit = lambda masks: F.array(*[F.lit(_signed(m)) for m in masks])
    tables = fps.select("fp", F.posexplode(lit(first)).alias("t", "_m")).select("t", F.col("fp").bitwiseAND(F.col("_m")).alias("k"), "fp")
    sizes = tables.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = F.element_at(F.array(*[lit(m) for m in second]), F.col("t") + 1)
    sub = F.when(F.col("n") > LOCAL, again).otherwise(F.array(F.lit(0).cast("long")))
    buckets = (
        tables.join(sizes, ["t", "k"])
        .select("t", "k", "fp", F.posexplode(sub).alias("t2", "_m"))
        .groupBy("t", "k", "t2", F.col("fp").bitwiseAND(F.col("_m")).alias("k2"))
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple[np.ndarray, np.ndarray]] = []
            column = batch.column(0)
            values, offsets = np.asarray(column.values).view(np.uint64), np.asarray(column.offsets)
            for s, e in zip(offsets[:-1], offsets[1:], strict=True):
                own = values[s:e]
                if e - s == 2:
                    if int(own[0] ^ own[1]).bit_count() <= radius:
                        got.append((own[1:], own[:1]))
                else:
                    got.append(_stars(np.sort(own), radius))
            a, b = (np.concatenate([g[i] for g in got] or [np.zeros(0, np.uint64)]).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label): the smallest node of each connected component; nodes without an edge are absent."""
    norm = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = materialise(norm(edges), "edges")
    was = state(now)
    while was[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = norm(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = materialise(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = norm(large.join(low, "a").select("b", "m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))))
        now = materialise(small, "small-star")
        is_ = state(now)
        if is_ == was:
            break
        was = is_
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def grouped(fps: DataFrame, radius: int = 2) -> DataFrame:
    """fps: rows with fp (a written table). Rows (fp, label): the class of each distinct fingerprint."""
    distinct = fps.select("fp").distinct()
    labels = components(star_links(distinct, radius)).withColumnRenamed("node", "fp")
    return distinct.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each input row."""
    fps = materialise(fingerprints(docs, words=words), "fingerprints")
    labels = grouped(fps, radius)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("_d"))
    lowest = labels.join(least, "fp").groupBy("label").agg(F.min("_d").alias("component_id"))
    of_fp = labels.join(lowest, "label").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 2, text: str = "text") -> DataFrame:
    """The document with the smallest doc_id of each group (nulls last, then by text hash); of equal rows one. Columns stay."""
    marks = ["_loom_d", "_loom_h"]
    keyed = docs.withColumns({"_loom_d": F.col("doc_id"), "_loom_h": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    fps = materialise(fingerprints(keyed, ("_loom_d", "_loom_h"), text, words), "fingerprints")
    best = fps.join(grouped(fps, radius), "fp").groupBy("label").agg(F.min(F.struct(F.col("_loom_d").isNull().alias("n"), "_loom_d", "_loom_h")).alias("m"))
    chosen = best.select(F.col("m._loom_d").alias("_d"), F.col("m._loom_h").alias("_h"))
    kept = keyed.join(chosen, keyed["_loom_d"].eqNullSafe(chosen["_d"]) & (keyed["_loom_h"] == chosen["_h"]), "left_semi")
    if not fps.groupBy(*marks).count().where("count > 1").isEmpty():  # equal rows: only then are texts dealt again
        kept = kept.dropDuplicates(marks)
    return kept.drop(*marks)
