"""Packing token sequences by exact-complement hashing, then best fit.

Lengths are integers up to the capacity, so the corpus is packed through its length histogram, at most ``capacity``
counts whatever the corpus. For each length from the longest down, the gap is looked up in an index of the single, pair and triple sums
of the lengths still available (``SumIndex``); a combination that fills it exactly is consumed as often as its counts allow. What has no
exact complement goes best fit, longest first. The plan is a list of patterns with multiplicities; documents
are ranked within their length (two-level, so a hot length is no single task) and look their sequence up in it.

Only documents longer than the capacity are cut: into pieces of the capacity, the first piece taking the rest.

Defined results: a null text is empty and holds just the end id. Repeated rows and ids are packed one by one; equal pieces
are interchangeable. A text of any length is tokenised whole. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import materialise, two_level

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A text is cut at blanks and line ends unless it has other white space, or NUL, which marks the cuts, or white space beside white space.
_OTHER = re.compile("[\\0\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bytes that the cache may take (words, ids and what Python needs beside them), characters of the longest word it keeps, and characters encoded at once.
CACHE, LONGEST, AT_ONCE = 256 << 20, 64, 4 << 20


class WordEncoder:
    """Ids of whole texts, as the tokenizer file gives them with add_special_tokens=False, through a cache of blank-led words.

    The byte-level pre-tokeniser starts a new token at every single blank and on both sides of a single line end, so a text without
    other white space is the concatenation of its words. A text that holds the string of an added token (it becomes that token's id), a word
    of over ``LONGEST`` characters or other white space is encoded in one call. The cache holds at most ``CACHE`` bytes and what one
    text adds, and is emptied when full; it lasts as long as the worker process, which serves many tasks.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.size = 0

    @classmethod
    def of_process(cls, path: str) -> WordEncoder:
        """The process's encoder. It hangs on a module, as functions that come by value have new globals in every task."""
        held = sys.modules.setdefault("_loomspark_encoders", types.ModuleType("_loomspark_encoders"))
        if path not in held.__dict__:
            held.__dict__[path] = cls(path)
        return held.__dict__[path]

    def raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, text: str) -> list[str] | None:
        """The words that may be encoded one by one, or None."""
        if any(t in text for t in self.added):
            return None
        words = split_words(text)
        return words if words is None or max(map(len, words)) <= LONGEST else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        part: list[str] = []
        size = 0
        for text in texts:
            if part and size + len(text) > AT_ONCE:
                out += self._encode(part)
                part, size = [], 0
            part.append(text)
            size += len(text)
        return out + self._encode(part)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.size > CACHE:
            self.cache, self.size = {}, 0
        cut = list(map(self.words, texts))
        new: set[str] = set()
        cache = self.cache
        for words in cut:
            if words is not None:
                new.update(words)
        missing = [w for w in new if w not in cache]
        if missing:
            got = self.raw(missing)
            cache.update(zip(missing, got, strict=True))
            self.size += sum(4 * len(w) + len(ids) + 200 for w, ids in zip(missing, got, strict=True))
        whole = iter(self.raw([t for t, w in zip(texts, cut, strict=True) if w is None]))
        return [next(whole) if w is None else b"".join(map(cache.__getitem__, w)) for w in cut]


def split_words(text: str) -> list[str] | None:
    """The words of an even text, each with its leading blank, line ends apart; None where the text isn't even."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or _OTHER.search(text):
        return None
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first takes what is left over."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Rows of PIECES."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_process(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    rows += [(doc_id, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, PIECES)


class SumIndex:
    """The lengths still available, indexed by the sums of one, two and three of them.

    Singles are the counts themselves. Pairs: how many pairs of available lengths have a sum, and, for each sum asked for, the list of its
    members (the shorter lengths), from which used-up ones are dropped as they are met. Triples: how many (length, pair) combinations have a sum.
    When the last item of a length is consumed, the sums that it took part in are subtracted.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for n, c in counts.items():
            self.left[n] = c
        self.has = (self.left > 0).astype(np.int64)
        self.pairs = np.zeros(capacity + 1, dtype=np.int64)
        for n in np.flatnonzero(self.has):
            self.pairs += self._pairs_with(int(n), from_n_on=True)
        self.triples = self._folded(self.has, self.pairs)
        self.members: dict[int, list[int]] = {}

    def _folded(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = 1 << (2 * self.capacity + 1).bit_length()
        return np.rint(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[: self.capacity + 1]).astype(np.int64)

    def _pairs_with(self, n: int, from_n_on: bool = False) -> np.ndarray:
        """By sum: pairs of available lengths that hold n (and no shorter one)."""
        out = np.zeros(self.capacity + 1, dtype=np.int64)
        low = n if from_n_on else 0
        out[n + low :] = self.has[low : self.capacity + 1 - n]
        if 2 * n <= self.capacity:
            out[2 * n] = int(self.left[n] > 1)
        return out

    def take(self, lengths: list[int]) -> int:
        """Consume the combination as often as the counts allow; how often that is."""
        need = {n: lengths.count(n) for n in lengths}
        times = min(int(self.left[n]) // c for n, c in need.items())
        for n, c in need.items():
            self.consume(n, c * times)
        return times

    def consume(self, n: int, count: int) -> None:
        rest = int(self.left[n]) - count
        gone = np.zeros(self.capacity + 1, dtype=np.int64)
        if rest == 0:
            gone = self._pairs_with(n)
        elif rest == 1 and self.left[n] > 1 and 2 * n <= self.capacity:
            gone[2 * n] = 1
        self.left[n] = rest
        if gone.any():
            self.triples -= self._folded(self.has, gone)
            self.pairs -= gone
        if rest == 0:
            self.triples[n:] -= self.pairs[: self.capacity + 1 - n]
            self.has[n] = 0

    def single(self, total: int, held: tuple[int, ...]) -> list[int] | None:
        return [total] if total > 0 and self.left[total] > held.count(total) else None

    def pair(self, total: int, held: tuple[int, ...]) -> list[int] | None:
        """The pair with the longest member, ``held`` items left aside."""
        if total < 2 or not self.pairs[total]:
            return None
        if total not in self.members:
            lows = np.arange(1, total // 2 + 1)
            self.members[total] = lows[(self.has[lows] > 0) & (self.has[total - lows] > 0)][::-1].tolist()
        own, left = self.members[total], self.left
        at = len(own)
        while at:
            at -= 1
            low, high = own[at], total - own[at]
            if left[low] <= (low == high) or not left[high]:
                del own[at]
            elif left[low] > held.count(low) + (low == high) and left[high] > held.count(high):
                return [high, low]
        return None

    def triple(self, total: int, held: tuple[int, ...]) -> list[int] | None:
        """A triple with the longest member that there is one for."""
        if total < 3 or not self.triples[total]:
            return None
        for n in np.flatnonzero((self.has[1 : total - 1] > 0) & (self.pairs[total - 1 : 1 : -1] > 0))[::-1] + 1:
            n = int(n)
            if self.left[n] > held.count(n) and (found := self.pair(total - n, (*held, n))):
                return [n, *found]
        return None

    def complement(self, gap: int, held: tuple[int, ...]) -> list[int] | None:
        """One, two or three available lengths whose sum is the gap."""
        return self.single(gap, held) or self.pair(gap, held) or self.triple(gap, held)


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(multiplicity, lengths) of the sequences that hold counts[length] items of each length."""
    index = SumIndex(counts, capacity)
    out: list[tuple[int, list[int]]] = []
    if index.left[capacity]:
        out.append((index.take([capacity]), [capacity]))
    rest: list[tuple[int, int]] = []
    for n in range(capacity - 1, 0, -1):
        while count := int(index.left[n]):
            found = index.complement(capacity - n, (n,))
            if found is None:
                rest.append((n, count))
                index.consume(n, count)
            else:
                out.append((index.take([n, *found]), [n, *found]))
    bins: dict[int, list[tuple[int, list[int]]]] = {}
    gaps = np.zeros(capacity + 1, dtype=bool)

    def put(gap: int, times: int, lengths: list[int]) -> None:
        bins.setdefault(gap, []).append((times, lengths))
        gaps[gap] = True

    for n, c in rest:
        while c:
            fits = np.flatnonzero(gaps[n:])
            if len(fits):
                gap = n + int(fits[0])
                times, lengths = bins[gap].pop()
                if not bins[gap]:
                    gaps[gap] = False
                used = min(c, times)
                if times > used:
                    put(gap, times - used, lengths)
                put(gap - n, used, [*lengths, n])
                c -= used
            else:
                each = min(c, capacity // n)
                times = c // each
                put(capacity - each * n, times, [n] * each)
                c -= each * times
    return out + [x for own in bins.values() for x in own]


def plan_table(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Length -> (first rank, first sequence, offset) of its runs of ranks, by first rank."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, lengths in patterns:
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*own, strict=True)) for n, own in runs.items()}


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces: rows of PIECES (a written table). The same rows with sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = plan_table(plan_patterns(counts, capacity))
    buckets = max(1, math.isqrt(sum(counts.values())))
    ranked = two_level(pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))), ["length"], "_b", [F.col("doc_id").asc(), F.col("piece").asc(), F.col("ids_crc32").asc()], "_rank").drop("_b")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (np.asarray(batch.column(i)) for i in (3, 5))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            starts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
            for own in np.split(order, starts[1:]):
                if len(own):
                    first, base, at = table[int(lengths[own[0]])]
                    i = np.searchsorted(first, ranks[own], side="right") - 1
                    sequence[own], offset[own] = base[i] + ranks[own] - first[i], at[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(materialise(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
