"""Sources and sinks: tables, evaluation items, reports, manifests and configuration."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from itertools import accumulate
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.chunker import join_metadata
from loomspark.schema import require_columns


def read_table(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """Parquet with required columns; only these are read where given."""
    df = require_columns(spark.read.parquet(path), list(columns))
    return df.select(*columns) if columns else df


def read_split(spark: SparkSession, path: str, split: str = "data") -> DataFrame:
    """A dataset kept in a folder of splits, or as it is."""
    for where in (f"{path}/{split}", path):
        try:
            return spark.read.parquet(where)
        except Exception as e:  # noqa: BLE001  Spark reports a missing path so
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    raise KeyError(f"{path} has no split {split!r}")


def read_corpus(spark: SparkSession, content: str, metadata: str, split: str = "data") -> DataFrame:
    """(document_id, content, metadata columns) of two datasets with as many rows; see ``chunker.join_metadata``. Different counts are an error."""
    left, right = read_split(spark, content, split), read_split(spark, metadata, split)
    same_count(left, right)
    return join_metadata(left, right)


def same_count(left: DataFrame, right: DataFrame) -> None:
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows against {m}")


def zip_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row i of both by their stored ordinal ``row``; different counts are an error."""
    same_count(left, right)
    return left.join(right, "row")


def write_table(df: DataFrame, path: str, overwrite: bool = True, allow_empty: bool = False) -> None:
    """Parquet, committed as a whole. An empty table is an error unless allowed."""
    if not allow_empty and df.isEmpty():
        raise ValueError(f"nothing to write to {path}")
    df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").parquet(path)


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a table is at ``path`` and isn't empty: a finished artifact, which a build may keep."""
    try:
        return not spark.read.parquet(path).isEmpty()
    except Exception as e:  # noqa: BLE001  Spark reports a missing path so
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def clear_derived(spark: SparkSession, folder: str, keep: Sequence[str] = ("chunks",)) -> list[str]:
    """Remove what was derived in ``folder``, all but the names in ``keep``; the names that went, in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(hadoop) if fs.exists(hadoop) else []:
        name = status.getPath().getName()
        if name not in keep:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def with_row_numbers(df: DataFrame, key: str, name: str = "embedding_row") -> DataFrame:
    """df with 0..n-1 in the order of a unique key, numbered by range partitions and their sizes."""
    from loomspark.operators.graph import with_positions

    return with_positions(df, [key], name, key)


def metadata_table(chunks: DataFrame, key: str = "id") -> DataFrame:
    """All columns but the vectors, with embedding_row first."""
    rows = with_row_numbers(chunks.drop("embedding"), key)
    return rows.select("embedding_row", *[c for c in rows.columns if c != "embedding_row"])


def missing_rows(source: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What is still to be embedded: an interrupted run goes on from here."""
    return source.join(done.select(key), key, "left_anti")


def resume_embedding(source: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame], signature: str, key: str = "id") -> int:
    """Encode the rows of ``source`` whose key the store at ``path`` lacks, and append them; how many rows the store has then.

    The store remembers the signature (model, size, prompt) that it was begun with; going on with another is an error.
    """
    spark = source.sparkSession
    if has_rows(spark, f"{path}/signature"):
        was = spark.read.parquet(f"{path}/signature").first()["signature"]
        if was != signature:
            raise ValueError(f"{path} was begun with {was!r}, not {signature!r}")
    else:
        spark.createDataFrame([(signature,)], "signature string").write.parquet(f"{path}/signature")
    new = source.dropDuplicates([key])
    if has_rows(spark, f"{path}/rows"):
        new = missing_rows(new, spark.read.parquet(f"{path}/rows"), key)
    encode(new).write.mode("append").parquet(f"{path}/rows")
    return spark.read.parquet(f"{path}/rows").count()


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """nodes, edges and their statistics, as three tables. A graph that isn't valid is an error."""
    from loomspark.operators.graph import statistics, validate

    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")
    nodes, edges = read_graph(nodes.sparkSession, folder)
    wrong = validate(nodes, edges).limit(5).collect()
    if wrong:
        raise ValueError(f"the graph isn't valid: {', '.join(f'{r.problem} {r.id}' for r in wrong)}")
    statistics(nodes, edges).coalesce(1).write.mode("overwrite").json(f"{folder}/statistics")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items from .jsonl, .json (a list or {"data": [...]}) or .csv, with a running number where they have no id."""
    suffix = Path(path).suffix.lower()
    if suffix == ".jsonl":
        df, first = spark.read.json(path), 1
    elif suffix == ".json":
        df, first = spark.read.option("multiLine", True).json(path), 0
        if df.columns == ["data"]:
            df = df.select(F.explode("data").alias("d")).select("d.*")
    elif suffix == ".csv":
        df, first = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path), 0
    else:
        raise ValueError(f"{suffix!r} is no format of evaluation items")
    if "query_id" in df.columns or "id" in df.columns:
        return df
    # Their order in the file gives the number: a partition is a part of the file, and its rows come after those of the parts before.
    placed = df.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    sizes = {r["_p"]: r["n"] for r in placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    starts = dict(zip(sorted(sizes), accumulate((sizes[p] for p in sorted(sizes)), initial=0), strict=False))
    offsets = spark.createDataFrame(list(starts.items()) or [(0, 0)], "_p int, _off long")
    return placed.join(offsets, "_p").withColumn("query_id", (F.col("_off") + F.col("_m") + first).cast("string")).drop("_p", "_m", "_off")


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A table as CSV with a header or as JSON lines; arrays become JSON text in CSV."""
    if kind != "csv":
        df.write.mode("overwrite").json(path)
        return
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_evaluation(summaries: DataFrame, details: DataFrame, folder: str, **facts) -> None:
    """evaluation_report (JSON, one row: facts and all summaries), method_comparison and query_level_results (CSV)."""
    write_report(summaries, f"{folder}/method_comparison")
    write_report(details, f"{folder}/query_level_results")
    rows = F.array_sort(F.collect_list(F.struct(*summaries.columns)))
    write_report(summaries.agg(*[F.lit(v).alias(k) for k, v in facts.items()], rows.alias("results")), f"{folder}/evaluation_report", "json")


def write_variants(report: DataFrame, metrics: DataFrame, folder: str) -> str:
    """variant_summary and variant_queries (CSV); returns the summary, a row a variant, as a LaTeX table."""
    write_report(report, f"{folder}/variant_summary")
    write_report(metrics, f"{folder}/variant_queries")
    return latex_table([r.asDict() for r in report.orderBy("variant").collect()], report.columns)


def manifest(path: str, **facts) -> None:
    """A small JSON file beside an artifact."""
    Path(path).write_text(json.dumps(facts, ensure_ascii=False, indent=2), encoding="utf-8")


def console_table(rows: Sequence[dict], columns: Sequence[str]) -> str:
    """A fixed-width table with numbers at four decimals."""
    cells = [[f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in rows]
    widths = [max(len(c), *(len(x[i]) for x in cells)) if cells else len(c) for i, c in enumerate(columns)]
    line = lambda xs: "  ".join(x.ljust(w) for x, w in zip(xs, widths, strict=True)).rstrip()
    return "\n".join([line(list(columns)), line(["-" * w for w in widths]), *map(line, cells)])


def latex_table(rows: Sequence[dict], columns: Sequence[str]) -> str:
    body = [" & ".join(f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]).replace("_", r"\_") for c in columns) + r" \\" for r in rows]
    head = " & ".join(c.replace("_", r"\_") for c in columns) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}"])


class Config:
    """Nested settings with dotted names; relative paths count from the settings' folder."""

    def __init__(self, data: dict, root: str = "."):
        self.data, self.root = data, Path(root)

    @classmethod
    def load(cls, path: str) -> Config:
        return cls(json.loads(Path(path).read_text(encoding="utf-8")), str(Path(path).resolve().parent))

    def get(self, name: str, default=None):
        at = self.data
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def section(self, name: str) -> dict:
        return dict(self.get(name, {}))

    def path(self, name: str) -> str:
        where = Path(self.get(f"paths.{name}", name))
        return str(where if where.is_absolute() else self.root / where)
