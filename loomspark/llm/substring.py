"""Exact substring removal by names of strings at doubling lengths, thinned by anchors.

This stands in for plain distributed prefix doubling, in which Spark sorts a (rank, rank) pair for every byte at each offset and ranks anew: its
rows alone pass the disk that may be used (the README has figures). Kept from it are the doubling of names, and that a position is settled as
soon as its name is unique, or still shared at the threshold. The name of 2h bytes comes from the pair of names (at p, at p + h). Names are
64-bit hashes in place of ranks, so they need no sort of all positions; equal strings share a name, and strings are taken for equal where two independent
names (128 bits in all) agree. Texts made to collide under the constants below could fool it; chance does not. Three facts thin the rows before Spark groups them:

1. Rank at 32 bytes, sparse. Every window of ``length`` bytes is served by one anchor: the position in it whose 32-byte
   name is least. Equal windows have equal anchors at equal distances, so a window whose anchor's rank is
   unique is unique. Neighbouring windows share an anchor and form a run; one row a run is sorted, about one in 85 bytes.
2. Whole runs. Runs with equal bytes (equal pairs of 128- or 256-byte names) settle all their windows as repeated. One of
   each kind stays, where another kind has the same anchor name, and is cut into pieces of ``PIECE`` windows by distance from the anchor.
   The bytes that all windows of a piece share are its name: a piece with a unique name has unique windows only.
3. Whole pieces, in the same way, and then the windows of the pieces still open, ranked by the pair (128-byte name at p, 128-byte
   name at p + length - 128): groups of two and more are repeated.

Every count is aggregated map-side and joined back, so no group gathers in one task. The result is exact for any input: it
does not depend on where anchors fall.

Defined results: texts are UTF-8 bytes, null is empty; matches never cross documents; overlapping occurrences count, in one
document too. Rows with equal doc_id and text are documents of their own and remove each other. A text of any length is
scanned whole, in overlapping parts. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import discard, materialise, utf8

ANCHOR = 32
PART = 1 << 18
POS_BITS = 22
N_BITS = 14
PIECE = 8
SALTS = 8
U = np.uint64


def _byte_names() -> np.ndarray:
    """Names of single bytes: splitmix64."""
    x = np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_NAMES = _byte_names()


def pair_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a pair of names."""
    x = a * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(32)
    x += b * U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(29)
    x *= U(0x9E3779B97F4A7C15)
    x ^= x >> U(32)
    return x


def doubled(data: np.ndarray, upto: int, keep: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Names of all positions at the lengths in ``keep`` (powers of two), by doubling."""
    names, h, out = BYTE_NAMES[data], 1, {}
    while h < upto and len(names) > h:
        names = pair_name(names[:-h], names[h:])
        h *= 2
        if h in keep:
            out[h] = names
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    h = 1
    while 2 * h <= width:
        x = np.minimum(x[:-h], x[h:])
        h *= 2
    return np.minimum(x[: len(x) - (width - h)], x[width - h :]) if width > h else x


def _parts(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(from, to, windows): byte ranges of about PART bytes with the ranges (first, end, document) of windows that start in them."""
    lo, windows = None, []
    for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if e - s < length:
            continue
        if e - s > 2 * PART:
            for at in range(s, e - length + 1, PART):
                end = min(at + PART, e - length + 1)
                yield at, end + length - 1, [(at, end, i)]
            continue
        if windows and e - lo > PART:
            yield lo, hi, windows
            windows = []
        if not windows:
            lo = s
        windows.append((s, e - length + 1, i))
        hi = e
    if windows:
        yield lo, hi, windows


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, start, anchor name, run name) of every run of windows; start counts from the document's first byte, and the low N_BITS of the anchor's name hold the number of windows."""
    small = 1 << (length.bit_length() - 1)
    got = []
    for lo, hi, windows in _parts(offsets, length):
        x = doubled(data[lo:hi], 2 * small, (ANCHOR, small, 2 * small))
        n = hi - lo
        keyed = (x[ANCHOR] & ~U((1 << POS_BITS) - 1)) | np.arange(len(x[ANCHOR]), dtype=U)
        anchor = (sliding_min(keyed, length - ANCHOR + 1) & U((1 << POS_BITS) - 1)).astype(np.int64)
        owner = np.full(n - length + 1, -1, dtype=np.int64)
        for s, e, i in windows:
            owner[s - lo : e - lo] = i
        anchor[owner < 0] = -1
        cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])) + 1
        starts = np.concatenate([[0], cuts])
        counts = np.diff(np.concatenate([starts, [len(anchor)]]))
        real = anchor[starts] >= 0
        starts, counts = starts[real], counts[real]
        at = anchor[starts]
        text = counts + length - 1
        wide = text >= 2 * small
        one, two = x[small], x.get(2 * small, x[small])
        head = np.where(wide, two[np.minimum(starts, len(two) - 1)], one[starts])
        tail = np.where(wide, two[np.clip(starts + text - 2 * small, 0, len(two) - 1)], one[starts + text - small])
        run = pair_name(pair_name(head, tail), (text.astype(U) << U(20)) + (at - starts).astype(U))
        docs = owner[starts]
        name = (x[ANCHOR][at] & ~U((1 << N_BITS) - 1)) | counts.astype(U)
        got.append((docs, starts + lo - offsets[docs], name.view(np.int64), run.view(np.int64)))
    return tuple(np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in range(4))


def _bytes_of(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def texts_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, th, data, no_id): what tells a row's text from others, and its bytes. Rows with equal doc and th have equal texts, so equal results."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(t)).alias("doc"), F.hash(t).alias("th"), utf8(text).alias("data"), F.col("doc_id").isNull().alias("no_id"))


#: Where a row lies: doc, and th and the first byte in one number.
ROWS = "doc long, pos long, name long, run long, weight int"


def run_rows(texts: DataFrame, length: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                docs, starts, name, run = runs_of(*_bytes_of(part.column(2)), length)
                pos = (np.asarray(part.column(1)).astype(np.int64)[docs] << 32) | starts
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(docs)), pa.array(pos), pa.array(name), pa.array(run)], ["doc", "pos", "name", "run"])

    return texts.select("doc", "th", "data").mapInArrow(scan, "doc long, pos long, name long, run long")


def _slices(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (doc, pos, weight, data): the bytes, where each row's begin, and for all windows their row and place in it."""
    data, offsets = _bytes_of(batch.column(3))
    counts = np.diff(offsets) - length + 1
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], row, place


def piece_rows(open_runs: DataFrame, length: int) -> DataFrame:
    """open_runs: (doc, pos, weight, data). Rows of ROWS for the pieces of each run, and place: how far in the run a piece begins."""
    h = 1 << ((length - PIECE + 1).bit_length() - 1)

    def three(x: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return pair_name(pair_name(x[at], x[at + (size - h) // 2]), x[at + size - h])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                data, base, row, place = _slices(part, length)
                x = doubled(data, max(h, ANCHOR), (ANCHOR, h))
                span = np.arange(length - ANCHOR + 1)
                keyed = (x[ANCHOR][base[:, None] + span] & ~U((1 << POS_BITS) - 1)) | span.astype(U)
                anchor = keyed.argmin(axis=1)
                distance = anchor[row] - place
                group = distance // PIECE
                first = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(group, prepend=-1))
                n = np.diff(np.append(first, len(row)))
                own, at, g = row[first], base[row[first]] + place[first], group[first]
                core = base[own] + anchor[own] - PIECE * g
                name = pair_name(three(x[h], core, length - PIECE + 1), x[ANCHOR][base[own] + anchor[own]] + g.astype(U))
                name = (name & ~U((1 << N_BITS) - 1)) | n.astype(U)
                run = pair_name(three(x[h], at, n + length - 1), (distance[first].astype(U) << U(20)) + n.astype(U))
                take = pa.array(own)
                pos = np.asarray(part.column(1))[own] + place[first]
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), pa.array(pos), pa.array(name.view(np.int64)), pa.array(run.view(np.int64)), part.column(2).take(take), pa.array(place[first].astype(np.int32))], ["doc", "pos", "name", "run", "weight", "place"])

    return open_runs.mapInArrow(scan, ROWS + ", place int")


def window_rows(open_pieces: DataFrame, length: int) -> DataFrame:
    """open_pieces: (doc, pos, weight, data). A row of ROWS for each window: name and run are its pair of names."""
    h = 1 << (length.bit_length() - 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                data, base, row, place = _slices(part, length)
                x, at, take = doubled(data, h, (h,))[h], base[row] + place, pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), pa.array(np.asarray(part.column(1))[row] + place), pa.array(x[at].view(np.int64)), pa.array(x[at + length - h].view(np.int64)), part.column(2).take(take)], ["doc", "pos", "name", "run", "weight"])

    return open_pieces.mapInArrow(scan, ROWS)


def _name(column: str = "name"):
    return F.shiftright(column, N_BITS)


def _windows(column: str = "name"):
    return F.col(column).bitwiseAND((1 << N_BITS) - 1)


def settle(rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: ROWS and ``more`` columns, in a written table. (Rows (doc, pos, n) whose bytes are met again, rows (doc, pos, more, weight, n) still
    open, the written table of classes behind both).

    A class is the rows of equal bytes. A class that weighs two or more is repeated. Of each class that shares its name with others one row stays
    open, unless all of them are settled; it weighs two if its own class is, as then it only serves the others.
    """
    classes = materialise(rows.groupBy("name", "run").agg(F.sum("weight").alias("c"), F.min(F.struct("doc", "pos", *more)).alias("one")), "classes")
    mixed = classes.groupBy(_name().alias("short")).agg(F.count(F.lit(1)).alias("_k"), F.min("c").alias("_least")).where("_k > 1 and _least = 1").select("short")
    still = classes.join(mixed, _name() == F.col("short"), "left_semi").select("one.*", F.when(F.col("c") > 1, 2).otherwise(1).alias("weight"), _windows().alias("n"))
    again = rows.where("weight = 1").join(classes.where("c > 1").select("name", "run"), ["name", "run"], "left_semi").select("doc", "pos", _windows().alias("n"))
    return again, still, classes


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """Rows (doc, th, spans): sorted (start, end) bytes of each text that has any, to be removed. Tables go as soon as they have served."""
    if not PIECE * 4 + ANCHOR <= length < 1 << (N_BITS - 1):
        raise ValueError("length is out of range")
    start = F.col("pos").bitwiseAND((1 << 32) - 1)
    runs = run_rows(texts, length)
    shared = runs.groupBy(_name().alias("short")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    shared = shared.select("short", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    salted = runs.withColumn("_salt", F.pmod(F.xxhash64("doc", "pos"), F.lit(SALTS)))  # a common passage's anchor is no single task
    runs = materialise(salted.join(shared, (_name() == F.col("short")) & (F.col("_salt") == F.col("salt")), "left_semi").drop("_salt").withColumn("weight", F.lit(1)), "runs")
    of_runs, still, classes = settle(runs)
    of_runs = materialise(of_runs, "spans")
    of_text = still.withColumns({"th": F.shiftright("pos", 32).cast("int"), "start": start}).groupBy("doc", "th").agg(F.collect_list(F.struct("pos", "start", "n", "weight")).alias("runs"))
    one_text = texts.select("doc", "th", "data").join(of_text, ["doc", "th"]).select("doc", "data", F.explode("runs").alias("r"))
    cut = F.substring(F.col("data"), (F.col("r.start") + 1).cast("int"), (F.col("r.n") + length - 1).cast("int"))
    open_runs = materialise(one_text.select("doc", "r.pos", "r.weight", cut.alias("data")), "open-runs")
    discard(runs, classes)
    pieces = materialise(piece_rows(open_runs, length), "pieces")
    of_pieces, still, classes = settle(pieces, "place")
    of_pieces = materialise(of_pieces, "spans")
    piece = F.substring(F.col("data"), F.col("place") + 1, (F.col("n") + length - 1).cast("int"))
    at = still.withColumn("run_pos", F.col("pos") - F.col("place"))
    open_pieces = at.join(open_runs.select("doc", F.col("pos").alias("run_pos"), "data"), ["doc", "run_pos"]).select("doc", "pos", "weight", piece.alias("data"))
    windows = materialise(window_rows(open_pieces, length), "windows")
    discard(pieces, classes, open_runs)
    pairs = windows.groupBy("name", "run").agg(F.sum("weight").alias("_c")).where("_c > 1").select("name", "run")
    of_windows = materialise(windows.where("weight = 1").join(pairs, ["name", "run"], "left_semi").select("doc", "pos", F.lit(1).cast("long").alias("n")), "spans")
    discard(windows)
    spans = of_runs.union(of_pieces).union(of_windows)
    spans = spans.select("doc", F.shiftright("pos", 32).cast("int").alias("th"), start.alias("start"), (start + F.col("n") + length - 1).alias("end"))
    # Spans that meet become one before they are gathered: a text gathers its maximal removed runs only.
    w = Window.partitionBy("doc", "th").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = spans.groupBy("doc", "th", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return islands.groupBy("doc", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in () if spans is None else spans:
        if out and x["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["end"]))
        else:
            out.append((x["start"], x["end"]))
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in spans:
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    texts = texts_of(docs)
    spans = repeated_spans(texts, length)
    joined = texts.join(spans, ["doc", "th"], "left").select("doc", "no_id", "data", "spans")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, no_id, data, spans in zip(*batch.columns, strict=True):
                raw, cut = data.as_py(), merged(spans.as_py())
                rows.append((None if no_id.as_py() else doc.as_py(), len(raw), sum(e - s for s, e in cut), len(cut), hashlib.sha256(kept_bytes(raw, cut)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with the repeated bytes taken out of text; a character cut in two goes as a whole. n_chars, where present, follows."""
    spans = repeated_spans(texts_of(docs), length)
    t = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(t)).alias("doc"), F.hash(t).alias("th"), F.struct(*docs.columns).alias("_row"))
    joined = keyed.join(spans, ["doc", "th"], "left")

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else kept_bytes(t.encode(), merged(s)).decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)], dtype=object)

    row = F.col("_row")
    changed = {"text": F.when(F.col("spans").isNull(), row["text"]).otherwise(kept(row["text"], F.col("spans")))}
    out = joined.select("_row", changed["text"].alias("_text"))
    columns = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[columns.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
