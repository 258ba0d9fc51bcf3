"""Schemas of the library's tables, and checks of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Names and order of the columns that tables are exchanged with.
_LINK = "relationship string, document_number string, article string, clause string, point string, appendix string, section string, raw_text string, scope string"
LINK = "struct<" + ", ".join(f"{n}: {t}" for n, t in (x.split() for x in _LINK.split(", "))) + ">"
NODES = "node_id string, node_type string, label string, document_id long, document_number string, parent_node_id string, is_virtual boolean, article_number string, content string, source_chunk_ids array<string>, resolution_status string, url string, legal_type string, legal_sectors string, issuing_authority string, issuance_date string, signers string"
EDGES = "edge_id string, source string, target string, edge_type string, relationship string, reference_count long, scopes array<string>, evidence array<string>, resolution_status string"
METADATA = ("document_number", "title", "url", "legal_type", "legal_sectors", "issuing_authority", "issuance_date", "signers")

#: Names under which edge tables may carry their ends and weights, in order of preference.
SOURCE_NAMES = ("source_node_id", "source", "src", "from_node_id", "from_node", "from", "u")
TARGET_NAMES = ("target_node_id", "target", "dst", "to_node_id", "to_node", "to", "v")
WEIGHT_NAMES = ("reference_count", "weight", "edge_weight", "score")


def require_columns(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def resolve_column(df: DataFrame, names: tuple[str, ...], configured: str | None = None, needed: bool = True) -> str | None:
    """The configured column if present, else the first known name that is, else an error or None."""
    for name in (configured, *names):
        if name and name in df.columns:
            return name
    if needed:
        raise ValueError(f"none of the columns {', '.join(names)} is present")
    return None
