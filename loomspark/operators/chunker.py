"""Structural chunking of legal documents.

A document is read by a line-by-line parser (``structure.py``), each on its own where it lies: nothing is shuffled, and documents are read once.
``islands`` and ``carried`` are the same steps for tables of lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from loomspark.functions import text as T
from loomspark.operators.structure import Chunk, Parser
from loomspark.plans.tables import slices
from loomspark.schema import LINK, METADATA, require_columns


def join_metadata(content: DataFrame, metadata: DataFrame) -> DataFrame:
    """(document_id, content, metadata columns). No document is dropped: what has no metadata has nulls.

    Where both sides carry their stored ordinal ``row``, row i belongs to row i, and the document's id is the content's, else the metadata's,
    else the ordinal. Else rows meet by id.
    """
    require_columns(content, ["content"])
    have = [c for c in METADATA if c in metadata.columns]
    own = lambda df: F.col("id") if "id" in df.columns else F.lit(None).cast("long")
    if "row" in content.columns and "row" in metadata.columns:
        left, right = content.select("row", own(content).alias("_c"), "content"), metadata.select("row", own(metadata).alias("_m"), *have)
        return left.join(right, "row", "left").select(F.coalesce("_c", "_m", "row").alias("document_id"), "content", *have)
    require_columns(content, ["id"])
    return content.select(F.col("id").alias("document_id"), "content").join(metadata.select(F.col("id").alias("document_id"), *have), "document_id", "left")


def islands(rows: DataFrame, by: list[str], order: str, kind: str) -> DataFrame:
    """rows with block: the running number, from 1, of the runs of equal ``kind`` in order within ``by``."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("_change", F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)), 0).otherwise(1))
    return rows.withColumn("block", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def line_kind(line: str) -> Column:
    """A line with two pipes is of a table."""
    return F.when(F.length(line) - F.length(F.replace(F.col(line), F.lit("|"))) >= 2, "table").otherwise("text")


def carried(rows: DataFrame, by: list[str], order: str, head: Column, value: Column) -> DataFrame:
    """rows with no, how many heads there have been, and head_value, the last one's value."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"no": F.sum(head.cast("int")).over(w), "head_value": F.last(F.when(head, value), ignorenulls=True).over(w)})


def filter_sector(docs: DataFrame, sector: str) -> DataFrame:
    """Documents of a sector; none at all is an error."""
    kind = docs.schema["legal_sectors"].dataType.typeName()
    out = docs.where(T.sector_matches("legal_sectors" if kind == "array" else F.array("legal_sectors"), sector))
    if out.isEmpty():
        raise ValueError(f"no document of sector {sector!r}")
    return out


def chunk(docs: DataFrame, least: int = 50, limit: int = 3000, sector: str | None = None) -> DataFrame:
    """docs: (document_id, content, document_number and other metadata). The chunks of all documents, with chunk_ord in document order.

    The links of a document's header go to its first article chunk. Null or blank content has no chunks.
    """
    if least < 0 or limit < 1:
        raise ValueError(f"no chunks of at least {least} and pieces of at most {limit} characters")
    require_columns(docs, ["document_id", "content"])
    if sector is not None:
        docs = filter_sector(docs, sector)
    if "document_number" not in docs.columns:
        docs = docs.withColumn("document_number", F.lit(None).cast("string"))
    have = [c for c in METADATA if c in docs.columns and c != "document_number"]
    docs = docs.select("document_id", T.document_number("document_number").alias("document_number"), *have, T.ascii_id("document_id").alias("_id"), "content")
    links = StructType.fromDDL(f"x array<{LINK}>")["x"].dataType
    kinds = {"link_to": links, "chunk_at": IntegerType(), "sub": IntegerType()}
    out = StructType([*docs.schema.fields[:-1], *(StructField(c, kinds.get(c, StringType())) for c in Chunk._fields)])
    arrow = [to_arrow_type(kinds.get(c, StringType())) for c in Chunk._fields]
    kept = len(docs.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(least, limit)
        for part in slices(batches):
            numbers, contents = part.column(1).to_pylist(), part.column(kept).to_pylist()
            rows = [(i, c) for i, (n, t) in enumerate(zip(numbers, contents, strict=True)) for c in parser.chunks(t, n)]
            at = pa.array([i for i, _ in rows], pa.int64())
            made = [pa.array([c[k] for _, c in rows], kind) for k, kind in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([part.column(k).take(at) for k in range(kept)] + made, names=out.names)

    order = F.struct("document_id", "chunk_at", "sub").alias("chunk_ord")
    return docs.mapInArrow(run, out).select(F.concat("_id", "suffix").alias("id"), "document_id", "document_number", *have, "part", "chapter", "section", "articles", "content", "link_to", order)


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """One row: chunks by kind (from their ids), least, greatest and mean length of content, distinct documents."""
    n = F.length("content")
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("id").contains("_dieu_")).alias("n_articles"), F.count_if(F.col("id").contains("_bang_")).alias("n_tables"), F.count_if(F.col("id").contains("_phu_luc_")).alias("n_appendix_texts"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(n), 2).alias("avg_chars"), F.countDistinct("document_id").alias("n_documents"))
