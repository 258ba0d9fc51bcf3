"""The queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.queries import answers, graphs, retrieval, storage, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = retrieval.QUERIES | graphs.QUERIES | texts.QUERIES | answers.QUERIES | storage.QUERIES
ORACLES: dict[str, str] = retrieval.ORACLES | graphs.ORACLES | texts.ORACLES | answers.ORACLES | storage.ORACLES
