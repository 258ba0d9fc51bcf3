"""Exact top-k inner products by no-random-access aggregation (NRA).

A strip of candidates is read in blocks; every block keeps one list a dimension, sorted by component. A query reads its lists from the
end that its own component's sign favours, all in step. What has been read of a candidate bounds its score: a lower bound with each
unread component at its list's worst, an upper bound with it at the list's frontier. Reading goes deeper until few candidates outside
the k best can still qualify: neither over the block's own k-th lower bound nor over the k-th score that the query carries from the blocks
before. The scores of those still in question are then resolved exactly. A block whose lists' heads alone stay under the carried score isn't read.

Both bounds of many queries and candidates at one depth are matrix products: a component that has been read stands for itself, an unread one for
the frontier (upper) or the worst (lower), and that depends on the candidate and the depth only.

Queries and candidates meet as (strip, query block) groups, so a task holds one strip and one block of queries, and returns at most k rows a
query. The best of the strips' rows are then merged by a window over each query. Rows are dealt to strips by number: equal vectors do not gather.

Defined results: components x become floor(256 * x) with x as double. Vectors that are null, hold a null or a non-finite
component, or are empty take no part; only vectors of equal length meet. Ties go to the smaller vec_id. A row is not its own
candidate; another row with the same vec_id is (repeated rows are told apart by their place). Null vec_ids: as candidates
they come last among ties; such a row asks no query. A score that might not fit a long is an error. Empty tables give empty results.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import materialise, two_level

#: Shares of the lists that are read, step by step.
STEPS = (1 / 4, 1 / 2, 3 / 4, 1)
#: Reading stops at this share of candidates still in question: to resolve these costs less than to read on.
FEW = 1 / 16
BLOCK, TILE = 2048, 512
LAST = np.iinfo(np.int64).max


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v: array<long>, dim) of the vectors that take part."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return embeddings.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size("embedding").alias("dim"))


class SortedLists:
    """A block of candidates with its sorted lists."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float64)
        self.values = np.sort(self.vectors, axis=0)
        self.at_depth = cache(self._at_depth)

    def heads(self, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """The greatest score that any candidate may have, for each query."""
        return up @ self.values[-1] + down @ self.values[0]

    def _at_depth(self, depth: int) -> tuple[np.ndarray, ...]:
        """What stands for the components, read from the top and from the bottom, in upper and in lower bounds."""
        v, top, bottom = self.vectors, self.values[-depth], self.values[depth - 1]
        worst, best = self.values[0], self.values[-1]
        return np.maximum(v, top).T, np.minimum(v, bottom).T, np.where(v >= top, v, worst).T, np.where(v <= bottom, v, best).T

    def in_question(self, queries: np.ndarray, k: int, carried: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, candidate) index pairs with all candidates that can be among a query's k best.

        carried: for each query a score that its k-th best reaches at least; own: the candidate that is the query itself, or -1.
        """
        n = len(self.vectors)
        up, down = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
        slack = 1e-12 * (np.abs(queries) @ np.abs(self.vectors).max(axis=0))  # of rounding
        active = np.flatnonzero(self.heads(up, down) + slack >= carried)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for share in STEPS:
            if not len(active):
                break
            high_up, high_down, low_up, low_down = self.at_depth(max(1, int(np.ceil(n * share))))
            upper = up[active] @ high_up + down[active] @ high_down
            lower = up[active] @ low_up + down[active] @ low_down
            at = np.flatnonzero(own[active] >= 0)
            upper[at, own[active[at]]] = lower[at, own[active[at]]] = -np.inf
            kth = np.partition(lower, n - k, axis=1)[:, n - k] if k <= n else np.full(len(active), -np.inf)
            maybe = upper >= (np.maximum(kth, carried[active]) - 2 * slack[active])[:, None]
            maybe[at, own[active[at]]] = False
            done = np.count_nonzero(maybe, axis=1) <= max(4 * k, n * FEW) if share < 1 else np.ones(len(active), bool)
            q, c = np.nonzero(maybe[done])
            found.append((active[done][q], c))
            active = active[~done]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([q for q, _ in found]), np.concatenate([c for _, c in found])


def strip_top(query_rows: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query index, candidate id, candidate row, score) of the k best of a strip for each query; ids: null as the largest long."""
    if len(queries) and len(vectors) and float(np.abs(queries.astype(np.float64)).sum(axis=1).max()) * float(np.abs(vectors.astype(np.float64)).max()) >= 2.0**62:
        raise ValueError("scores may not fit a long")
    best: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, np.int64) for _ in range(4))]
    blocks = [(slice(s, s + BLOCK), SortedLists(vectors[s : s + BLOCK])) for s in range(0, len(vectors), BLOCK)]
    place = {r: i for i, r in enumerate(rows.tolist())}
    itself = np.array([place.get(r, -1) for r in query_rows.tolist()], dtype=np.int64)
    for lo in range(0, len(queries), TILE):
        own = queries[lo : lo + TILE]
        as_double, carried = own.astype(np.float64), np.full(len(own), -np.inf)
        held = best[0]
        for part, lists in blocks:
            here = itself[lo : lo + TILE] - part.start
            q, c = lists.in_question(as_double, k, carried, np.where((here >= 0) & (here < BLOCK), here, -1))
            c = c + part.start
            score = np.concatenate([np.einsum("ij,ij->i", own[q[i : i + 65536]], vectors[c[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.zeros(0, np.int64)])
            q, cid, row, score = (np.concatenate(x) for x in zip(held, (q, ids[c], rows[c], score), strict=True))
            order = np.lexsort((row, cid, -score, q))
            q = q[order]
            place_of = np.arange(len(q)) - np.searchsorted(q, q)
            kept = order[place_of < k]
            held = (q[place_of < k], cid[kept], row[kept], score[kept])
            full = place_of == k - 1
            carried[q[full]] = score[order[full]]
        best.append((held[0] + lo, *held[1:]))
    return tuple(np.concatenate(x) for x in zip(*best, strict=True))


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, strip: int = 4 * BLOCK, query_block: int = 4096) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the rows whose vec_id is divisible by ``every``, against all other rows."""
    v = quantised(embeddings)
    n = v.count()
    ranges = max(1, int(n**0.5))
    keyed = v.withColumn("_b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(ranges)))
    placed = materialise(two_level(keyed, ["dim"], "_b", [F.col("vec_id").asc(), F.xxhash64("v").asc()], "row").drop("_b"), "vectors")
    number = lambda df, by, size: F.floor(F.col(by) / size)
    asking = placed.sparkSession.read.schema(placed.schema).parquet(placed.loom_path).where(F.col("vec_id") % every == 0)  # read anew: a cogroup takes no self-join
    asking = two_level(asking.withColumn("_b", number(asking, "row", strip)), ["dim"], "_b", [F.col("row").asc()], "q").withColumn("qb", number(asking, "q", query_block))
    strips = placed.groupBy("dim").agg(F.max(number(placed, "row", strip)).alias("last"))
    groups = asking.groupBy("dim").agg(F.max("qb").alias("last"))
    up_to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c)))
    queries = asking.join(strips, "dim").select("dim", up_to("last").alias("b"), "qb", "vec_id", "row", "v")
    candidates = placed.join(groups, "dim").select("dim", number(placed, "row", strip).alias("b"), up_to("last").alias("qb"), F.coalesce("vec_id", F.lit(int(LAST))).alias("vec_id"), "row", "v")
    meetings = -(-n // strip) * -(-n // (every * query_block))
    tasks = min(4 * meetings + 1, 1 << 14)
    keys = ("dim", "b", "qb")

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        get = lambda t, name: t[name].combine_chunks().to_numpy(zero_copy_only=False)
        vectors = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        if not asked.num_rows or not there.num_rows:
            q, columns = np.zeros(0, np.int64), (np.zeros(0, np.int64),) * 3
        else:
            q, *columns = strip_top(get(asked, "row"), vectors(asked), get(there, "vec_id"), get(there, "row"), vectors(there), k)
        return pa.table([pa.array(x, pa.int64()) for x in (get(asked, "row")[q], get(asked, "vec_id")[q], *columns)] if asked.num_rows else [pa.array([], pa.int64())] * 5, names=["q_row", "query_id", "vec_id", "row", "score"])

    met = queries.repartition(tasks, *keys).groupBy(*keys).cogroup(candidates.repartition(tasks, *keys).groupBy(*keys))
    found = met.applyInArrow(run, "q_row long, query_id long, vec_id long, row long, score long")
    best = Window.partitionBy("query_id", "q_row").orderBy(F.col("score").desc(), F.col("vec_id").asc(), F.col("row").asc())
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != int(LAST), F.col("vec_id")).alias("vec_id"), "score")
