"""Graph expansion: bounded first-visit search from seed chunks, components, degrees and selections for viewing.

The search is unrolled into joins, one a hop. Within a hop a node keeps the earliest visit: by the parent's place in the
queue, then the edge's. That reproduces a first-in-first-out queue, whose first visit fixes a node's score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark import schema
from loomspark.functions import text as T
from loomspark.plans.tables import discard, materialise


def adjacency(edges: DataFrame, direction: str = "both", weight: str | None = None) -> DataFrame:
    """(node, neighbour, weight, pos) by direction: out, in or both. ``edge_pos`` orders the edges; blank ends are skipped."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"no direction {direction!r}")
    s, t = schema.resolve_column(edges, schema.SOURCE_NAMES), schema.resolve_column(edges, schema.TARGET_NAMES)
    w = schema.resolve_column(edges, schema.WEIGHT_NAMES, weight, needed=False)
    e = edges.select(T.identifier(s).alias("s"), T.identifier(t).alias("t"), (T.weight(w) if w else F.lit(1.0)).alias("weight"), "edge_pos").where("s <> '' and t <> ''")
    out = e.select(F.col("s").alias("node"), F.col("t").alias("neighbour"), "weight", (F.col("edge_pos") * 2).alias("pos"))
    back = e.select(F.col("t").alias("node"), F.col("s").alias("neighbour"), "weight", (F.col("edge_pos") * 2 + 1).alias("pos"))
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def chunk_nodes(nodes: DataFrame) -> DataFrame:
    """(chunk_id, node_id, node_pos, chunk_pos): which chunks stand behind which nodes, each pair once, in order."""
    rows = nodes.select("node_id", "node_pos", F.posexplode("source_chunk_ids").alias("chunk_pos", "chunk_id"))
    return rows.groupBy("chunk_id", "node_id").agg(F.min("node_pos").alias("node_pos"), F.min("chunk_pos").alias("chunk_pos"))


def visits(seeds: DataFrame, mapping: DataFrame, adj: DataFrame, max_hops: int = 2, decay: float = 0.65) -> DataFrame:
    """(query_id, walk, node_id, hop, score, seed_rank, place): the first visit of each node in each walk.

    seeds: (query_id, chunk_id, score, rank). A walk starts at one node of one seed. ``place`` is an array that sorts as the queue did. Each
    hop is a written table, so plans don't grow with hops.
    """
    start = seeds.join(mapping, "chunk_id").select("query_id", F.concat_ws("\x1f", F.col("chunk_id"), F.col("node_id")).alias("walk"), "node_id", F.lit(0).alias("hop"), F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("seed_rank"), "node_pos", F.array(F.lit(0).cast("long")).alias("place"))
    seen = frontier = materialise(start, "hop")
    for hop in range(1, max_hops + 1):
        step = frontier.join(adj, frontier["node_id"] == adj["node"]).select("query_id", "walk", F.col("neighbour").alias("node_id"), F.lit(hop).alias("hop"), (F.col("score") * decay * F.col("weight")).alias("score"), "seed_rank", "node_pos", F.concat("place", F.array(F.col("pos").cast("long"))).alias("place"))
        fresh = step.join(seen.select("query_id", "walk", "node_id"), ["query_id", "walk", "node_id"], "left_anti")
        first = Window.partitionBy("query_id", "walk", "node_id").orderBy("place")
        frontier = materialise(fresh.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r"), "hop")
        seen = seen.unionByName(frontier)
    return seen


def chunk_scores(visited: DataFrame, mapping: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, query_id, chunk_id, score, first_pos): the best score of each chunk met by any walk, at least 0; first_pos is its place of first emission."""
    met = visited.join(mapping.select("chunk_id", "node_id", "chunk_pos"), "node_id")
    order = F.struct("seed_rank", "node_pos", "hop", "place", "chunk_pos")
    best = met.groupBy(*keys, "query_id", "chunk_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"), F.min(order).alias("o"))
    w = Window.partitionBy(*keys, "query_id").orderBy("o", "chunk_id")
    return best.select(*keys, "query_id", "chunk_id", F.round("score", 9).alias("score"), F.row_number().over(w).cast("long").alias("first_pos"))


def expand(seeds: DataFrame, mapping: DataFrame, adj: DataFrame, max_hops: int = 2, decay: float = 0.65) -> DataFrame:
    """(query_id, chunk_id, score, first_pos) of the chunks within ``max_hops`` of the seeds."""
    return chunk_scores(visits(seeds, mapping, adj, max_hops, decay), mapping)


def expand_trials(seeds: DataFrame, mapping: DataFrame, adj: DataFrame, trials: DataFrame, deepest: int) -> DataFrame:
    """(trial, query_id, chunk_id, score, first_pos) for all trials (trial, max_hops, hop_decay), a bounded table, by one search.

    Which visit is first doesn't depend on the decay, so the search runs once, to the deepest trial's hops, and each trial takes its part.
    """
    v = visits(seeds, mapping, adj, deepest, 1.0).crossJoin(trials.select("trial", "max_hops", "hop_decay")).where("hop <= max_hops")
    return chunk_scores(v.withColumn("score", F.col("score") * F.pow("hop_decay", "hop")), mapping, ("trial",))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over both ends."""
    ends = edges.select(F.col("source").alias("node")).unionAll(edges.select(F.col("target").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def merge_parallel(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target): duplicate_count and the distinct relationships."""
    return edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("duplicate_count"), F.array_sort(F.collect_set("relationship")).alias("relationships"))


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, missing_metadata): the nodes, and ends of edges that are none."""
    ends = edges.select(F.col("source").alias("node_id")).union(edges.select(F.col("target").alias("node_id"))).distinct()
    known = nodes.select("node_id").distinct()
    return known.withColumn("missing_metadata", F.lit(False)).unionByName(ends.join(known, "node_id", "left_anti").withColumn("missing_metadata", F.lit(True)))


def id_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: distinct node ids and ends, ids in both, and in one only."""
    n = nodes.select("node_id").distinct().withColumn("n", F.lit(1))
    e = edges.select(F.col("source").alias("node_id")).union(edges.select(F.col("target").alias("node_id"))).distinct().withColumn("e", F.lit(1))
    both = n.join(e, "node_id", "full_outer")
    return both.agg(F.count("n").alias("n_nodes"), F.count("e").alias("n_ends"), F.count_if(F.col("n").isNotNull() & F.col("e").isNotNull()).alias("n_both"), F.count_if(F.col("e").isNull()).alias("n_isolated"), F.count_if(F.col("n").isNull()).alias("n_dangling"))


def top_relations(edges: DataFrame, n: int = 15) -> DataFrame:
    return edges.groupBy("relationship").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "relationship").limit(n)


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each weakly connected component, by alternating star steps.

    Large star: a node's greater neighbours move to its least neighbour. Small star: so do its lesser neighbours. Edges never grow in
    number and end as stars around the least nodes. Both steps take the least neighbour by a map-side aggregate; rounds are written tables.
    """
    norm = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    every = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    now = materialise(norm(every), "edges")
    was = state(now)
    while was[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = materialise(norm(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = materialise(norm(large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))), "small-star")
        discard(now, large)
        now = small
        if (is_ := state(now)) == was:
            break
        was = is_
    ends = every.select(F.col("a").alias("node")).union(every.select("b")).distinct()
    return ends.join(now.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with most edges, then most nodes, then the smallest label."""
    labels = component_labels(edges)
    e = edges.join(labels, edges["source"] == labels["node"]).drop("node")
    size = e.groupBy("label").agg(F.count(F.lit(1)).alias("n_edges")).join(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_nodes")), "label")
    best = size.orderBy(F.col("n_edges").desc(), F.col("n_nodes").desc(), "label").limit(1).select("label")
    return e.join(best, "label", "left_semi").drop("label")


def seed_node(edges: DataFrame) -> DataFrame:
    """The node of greatest degree; the smaller id wins ties."""
    return degrees(edges).orderBy(F.col("degree").desc(), "node").limit(1)


def select_around(edges: DataFrame, start: str, max_nodes: int) -> DataFrame:
    """(node, level): nodes around ``start`` level by level, those of higher degree first, up to ``max_nodes`` or all that can be reached."""
    d = degrees(edges)
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    both = both.union(both.select("b", "a")).distinct()
    seen = d.where(F.col("node") == start).select("node", F.lit(0).alias("level"))
    seen, level = materialise(seen, "seen"), 0
    while True:
        level += 1
        reached = both.join(seen.where(F.col("level") == level - 1), both["a"] == seen["node"]).select(F.col("b").alias("node")).distinct()
        seen = materialise(seen.unionByName(reached.join(seen, "node", "left_anti").withColumn("level", F.lit(level))), "seen")
        if seen.count() >= max_nodes or seen.where(F.col("level") == level).isEmpty():
            break
    return seen.join(d, "node").orderBy("level", F.col("degree").desc(), "node").limit(max_nodes).select("node", "level")


def cap_edges(merged: DataFrame, n: int = 1800) -> DataFrame:
    """The n edges with the greatest sum of degrees, then duplicate_count."""
    d = degrees(merged)
    e = merged.join(d.select(F.col("node").alias("source"), F.col("degree").alias("ds")), "source").join(d.select(F.col("node").alias("target"), F.col("degree").alias("dt")), "target")
    return e.withColumn("weight", F.col("ds") + F.col("dt")).orderBy(F.col("weight").desc(), F.col("duplicate_count").desc(), "source", "target").limit(n).drop("ds", "dt")


def with_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that have an edge."""
    ends = edges.select(F.col("source").alias("node_id")).union(edges.select(F.col("target").alias("node_id"))).distinct()
    return nodes.join(ends, "node_id", "left_semi")


def view_attributes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, size) and (source, target, width) for drawing: sizes from 12 to 42, widths up to 8."""
    size = degrees(edges).select("node", F.round(F.least(F.lit(42.0), F.greatest(F.lit(12.0), 11 + 3 * F.sqrt("degree"))), 6).alias("size"))
    width = merge_parallel(edges).select("source", "target", F.round(F.least(F.lit(8.0), 1.8 + F.log2("duplicate_count")), 6).alias("width"))
    return size, width
