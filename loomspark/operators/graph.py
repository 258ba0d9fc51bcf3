"""The property graph of chunks: hierarchy nodes, document links, validation and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark import schema
from loomspark.functions import patterns as P
from loomspark.functions import text as T
from loomspark.plans.tables import materialise

LEVELS = ("part", "chapter", "section")
#: Labels of levels that a document doesn't have.
VIRTUAL_LABELS = {"part": "Không có Phần", "chapter": "Không có Chương", "section": "Không có Mục"}
ATTRIBUTES = ("url", "legal_type", "legal_sectors", "issuing_authority", "issuance_date", "signers")
LEVEL_PATTERNS = {"part": P.NODE_PART, "chapter": P.NODE_CHAPTER, "section": P.NODE_SECTION}


def first_value(column: str, order: str) -> Column:
    """The first value by order that isn't blank."""
    value = T.clean(column)
    return F.min_by(F.when(value != "", value), F.when(value != "", F.col(order)))


def document_nodes(chunks: DataFrame, attributes: tuple[str, ...] = ("document_number", "title", *ATTRIBUTES)) -> DataFrame:
    """A node for each document: each attribute is its first value that isn't blank, by chunk_ord."""
    have = [a for a in attributes if a in chunks.columns]
    return chunks.groupBy("document_id").agg(*[first_value(a, "chunk_ord").alias(a) for a in have], F.min("chunk_ord").alias("ord")).select(F.concat(F.lit("doc:"), F.col("document_id").cast("string")).alias("node_id"), F.lit("document").alias("node_type"), "document_id", *have, "ord")


def number_index(documents: DataFrame) -> DataFrame:
    """(number_key, n_documents, node_id): how many documents carry a number, and the node where it is one."""
    key = T.graph_number("document_number")
    return documents.select(key.alias("number_key"), "node_id").where("number_key <> ''").groupBy("number_key").agg(F.count(F.lit(1)).alias("n_documents"), F.min("node_id").alias("node_id"))


def article_rows(chunks: DataFrame) -> DataFrame:
    """Chunks of articles, with article_number and, for each level, the heading or a placeholder and the node id."""
    a = chunks.where(F.col("articles").rlike(P.NODE_ARTICLE)).withColumn("article_number", F.upper(F.regexp_extract("articles", P.NODE_ARTICLE, 1)))
    for level in LEVELS:
        heading = T.heading_if(level, LEVEL_PATTERNS[level])
        a = a.withColumns({f"{level}_key": F.when(heading != "", heading).otherwise(f"__NO_{level.upper()}__"), f"{level}_virtual": heading == ""})
    doc = F.col("document_id").cast("string")
    a = a.withColumn("document_node", F.concat(F.lit("doc:"), doc))
    path: list[str] = []
    for level in LEVELS:
        path.append(f"{level}_key")
        a = a.withColumn(f"{level}_node", T.stable_id(level, doc, *path))
    return a.withColumn("article_node", T.stable_id("article", doc, *path, "article_number"))


def level_nodes(articles: DataFrame) -> DataFrame:
    """(node_id, node_type, label, document_id, document_number, parent_node_id, is_virtual) of parts, chapters and sections, each once."""
    parents = {"part": "document_node", "chapter": "part_node", "section": "chapter_node"}
    number = F.col("document_number") if "document_number" in articles.columns else F.lit(None).cast("string")

    def rows(x: str) -> DataFrame:
        label = F.when(F.col(f"{x}_virtual"), VIRTUAL_LABELS[x]).otherwise(F.col(f"{x}_key"))
        return articles.select(F.col(f"{x}_node").alias("node_id"), F.lit(x).alias("node_type"), label.alias("label"), "document_id", number.alias("document_number"), F.col(parents[x]).alias("parent_node_id"), F.col(f"{x}_virtual").alias("is_virtual"), "chunk_ord")

    every = reduce(DataFrame.unionByName, map(rows, LEVELS))
    return every.groupBy("node_id", "node_type", "label", "document_id", "parent_node_id", "is_virtual").agg(first_value("document_number", "chunk_ord").alias("document_number"))


def article_nodes(articles: DataFrame) -> DataFrame:
    """A node for each article: distinct contents joined by empty lines, distinct chunk ids, the first heading as label."""
    number = first_value("document_number", "chunk_ord") if "document_number" in articles.columns else F.lit(None).cast("string")

    def distinct_in_order(column: str) -> Column:
        return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("chunk_ord", T.clean(column).alias("x")))), lambda s: s["x"]))

    g = articles.groupBy("article_node").agg(F.min_by(T.clean("articles"), "chunk_ord").alias("label"), F.min("document_id").alias("document_id"), number.alias("document_number"), F.min("section_node").alias("parent_node_id"), F.min("article_number").alias("article_number"), F.array_join(F.filter(distinct_in_order("content"), lambda c: c != ""), "\n\n").alias("content"), F.filter(distinct_in_order("id"), lambda c: c != "").alias("source_chunk_ids"))
    return g.select(F.col("article_node").alias("node_id"), F.lit("article").alias("node_type"), "label", "document_id", "document_number", "parent_node_id", F.lit(False).alias("is_virtual"), "article_number", "content", "source_chunk_ids")


def hierarchy_edges(articles: DataFrame) -> DataFrame:
    """(source, target, edge_type, relationship, reference_count): CONTAINS edges from documents down to articles, each once."""
    steps = (("document", "part"), ("part", "chapter"), ("chapter", "section"), ("section", "article"))
    rows = [articles.select(F.col(f"{a}_node").alias("source"), F.col(f"{b}_node").alias("target"), F.lit(f"CONTAINS_{b.upper()}").alias("relationship")) for a, b in steps]
    return reduce(DataFrame.unionByName, rows).distinct().select("source", "target", F.lit("HIERARCHY").alias("edge_type"), "relationship", F.lit(1).cast("long").alias("reference_count"))


def resolved_links(chunks: DataFrame, documents: DataFrame, index: DataFrame) -> DataFrame:
    """(source, target, relationship, scope, evidence, resolution_status, number, ord, link_pos) of every link that counts.

    One document of that number: it is the target. None or several: an external node stands for the number. Blank numbers,
    the document's own number and links to itself are passed over. number is the number as the link has it.
    """
    own = documents.select("document_id", T.graph_number("document_number").alias("own_number"))
    rows = chunks.select("document_id", F.col("chunk_ord").alias("ord"), F.posexplode("link_to").alias("link_pos", "link"))
    rows = rows.select("document_id", "ord", "link_pos", T.clean(F.col("link.document_number")).alias("number"), T.graph_number(F.col("link.document_number")).alias("number_key"), T.relation(F.col("link.relationship")).alias("relationship"), T.clean(F.col("link.scope")).alias("scope"), T.clean(F.col("link.raw_text")).alias("evidence")).where("number_key <> ''")
    rows = rows.join(own, "document_id", "left").where("own_number is null or number_key <> own_number")
    rows = with_targets(rows, index)
    return rows.select(F.concat(F.lit("doc:"), F.col("document_id").cast("string")).alias("source"), "target", "relationship", "scope", "evidence", "resolution_status", "number", "ord", "link_pos").where("source <> target")


def with_targets(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows (with number_key) and resolution_status (internal, not_found or ambiguous) and target: the one document of that number, or an external node."""
    rows = rows.join(index.select("number_key", "n_documents", F.col("node_id").alias("_target")), "number_key", "left")
    status = F.when(F.col("n_documents") == 1, "internal").when(F.col("n_documents").isNull(), "not_found").otherwise("ambiguous")
    target = F.when(status == "internal", F.col("_target")).otherwise(T.stable_id("external_doc", F.col("number_key")))
    return rows.withColumns({"resolution_status": status, "target": target}).drop("_target", "n_documents")


def link_edges(links: DataFrame, keep: int = 10) -> DataFrame:
    """Links gathered by (source, target, relationship): how many, their scopes, and the first distinct pieces of evidence.

    Evidence is ranked by where it is first met, and only what is kept of an edge is gathered.
    """
    key = ["source", "target", "relationship"]
    edges = links.groupBy(*key).agg(F.count(F.lit(1)).alias("reference_count"), F.array_sort(F.collect_set(F.when(F.col("scope") != "", F.col("scope")))).alias("scopes"), F.min("resolution_status").alias("resolution_status"))
    met = links.where("evidence <> ''").groupBy(*key, "evidence").agg(F.min(F.struct("ord", "link_pos")).alias("_at"))
    first = met.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("_at"))).where(F.col("_r") <= keep)
    gathered = first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "evidence"))), lambda s: s["evidence"]).alias("evidence"))
    return edges.join(gathered, key, "left").withColumns({"edge_type": F.lit("DOCUMENT_LINK"), "evidence": F.coalesce("evidence", F.array().cast("array<string>"))})


def external_nodes(links: DataFrame) -> DataFrame:
    """A node for each number that isn't one document's, with the number as the first link has it."""
    rows = links.where("resolution_status <> 'internal'").groupBy(F.col("target").alias("node_id")).agg(F.min_by("number", F.struct("ord", "link_pos")).alias("document_number"), F.min("resolution_status").alias("resolution_status"))
    return rows.select("node_id", F.lit("external_document").alias("node_type"), F.col("document_number").alias("label"), "document_number", "resolution_status")


def build_nodes(chunks: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """All nodes with the columns of ``schema.NODES``, ordered by type, document (nulls last) and id, with node_pos. Attributes that a node hasn't are empty."""
    documents, articles = document_nodes(chunks), article_rows(chunks)
    links = resolved_links(chunks, documents, number_index(documents)) if links is None else links
    title = F.col("title") if "title" in documents.columns else F.lit(None).cast("string")
    nodes = documents.withColumns({"label": title}).drop("ord", "title")
    for more in (level_nodes(articles), article_nodes(articles), external_nodes(links)):
        nodes = nodes.unionByName(more, allowMissingColumns=True)
    known = {"source_chunk_ids": F.coalesce("source_chunk_ids", F.array().cast("array<string>")), "is_virtual": F.coalesce("is_virtual", F.lit(False)), "resolution_status": F.coalesce("resolution_status", F.lit("internal"))}
    names = [c.split()[0] for c in schema.NODES.split(", ")]
    text = lambda c: F.coalesce(c, F.lit("")) if c in nodes.columns else F.lit("")
    nodes = nodes.select(*[(F.col(c) if c in ("node_id", "document_id") else known.get(c, text(c))).alias(c) for c in names])
    return with_positions(nodes, ["node_type", "document_id", "node_id"], "node_pos", "node_id")


def build_edges(chunks: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """All edges with ids, ordered by type, relationship and ends, with edge_pos.

    They are written before they are numbered: ranges are sampled, numbered and joined back, and each would make all edges anew.
    """
    documents = document_nodes(chunks)
    links = resolved_links(chunks, documents, number_index(documents)) if links is None else links
    edges = with_edge_ids(hierarchy_edges(article_rows(chunks)).unionByName(link_edges(links), allowMissingColumns=True))
    return with_positions(materialise(edges, "edges"), ["edge_type", "relationship", "source", "target"], "edge_pos", "edge_id")


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """The columns of ``schema.EDGES``; what a hierarchy edge hasn't is empty, and its ends are internal."""
    empty = F.array().cast("array<string>")
    more = {"edge_id": T.stable_id("edge", "source", "target", "relationship")}
    for c, other in (("scopes", empty), ("evidence", empty), ("resolution_status", F.lit("internal"))):
        more[c] = F.coalesce(c, other) if c in edges.columns else other
    return edges.withColumns(more).select(*[c.split()[0] for c in schema.EDGES.split(", ")])


def with_positions(df: DataFrame, order: list[str], name: str, key: str) -> DataFrame:
    """df with a global position from 0 in the given order (nulls last), without a single-partition window.

    Rows are sorted by range partitioning and numbered within their partition; the partitions' sizes give the offsets. The numbers
    are written before they are joined, so that a lost executor can't number anew.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    ranged = df.select(*dict.fromkeys([key, *order])).repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = ranged.select(key, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_m"))
    numbered = materialise(numbered, "positions")
    counts = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_off"))
    return df.join(numbered.join(offsets, "_p").select(key, (F.col("_off") + F.col("_m")).alias(name)), key)


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, id): duplicate node ids, edges with an end that is no node, and self-loops."""
    ids = nodes.select("node_id")
    twice = ids.groupBy("node_id").count().where("count > 1").select(F.lit("duplicate_node").alias("problem"), F.col("node_id").alias("id"))
    ends = edges.select(F.col("source").alias("node_id")).union(edges.select(F.col("target").alias("node_id"))).distinct()
    dangling = ends.join(ids, "node_id", "left_anti").select(F.lit("dangling_end").alias("problem"), F.col("node_id").alias("id"))
    loops = edges.where("source = target").select(F.lit("self_loop").alias("problem"), F.col("source").alias("id"))
    return twice.union(dangling).union(loops)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, n): nodes by type, edges by relationship, links by resolution."""
    part = lambda df, what, column: df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "name", "n")
    return part(nodes, "node_type", "node_type").union(part(edges, "relationship", "relationship")).union(part(edges.where("edge_type = 'DOCUMENT_LINK'"), "resolution", "resolution_status"))


def fill_missing(first: DataFrame, later: DataFrame, key: str = "node_id") -> DataFrame:
    """Upsert: rows of ``first`` stay, and their blank attributes are filled from ``later``; new keys are added."""
    both = first.withColumn("_o", F.lit(0)).unionByName(later.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in (key, "_o")]
    blank = lambda c: F.trim(F.col(c).cast("string")) == ""
    return both.groupBy(key).agg(*[F.min_by(F.when(~blank(c), F.col(c)), F.when(~blank(c), F.col("_o"))).alias(c) for c in others])
