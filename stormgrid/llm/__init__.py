"""Training-data operators, their queries and their SQL. Nothing else in the library imports this."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES = {
    "op1_bpe": "bpe",
    "op2_line_dedup": "line_dedup",
    "op3_license": "licenses",
    "op4_quality": "quality",
    "op5_neighbours": "neighbours",
    "op6_sharding": "sharding",
    "op7_media": "media",
    "op8_jaccard": "jaccard",
    "op9_url_filters": "url_filters",
    "op10_mixing": "mixing",
    "op11_centroids": "centroids",
    "op12_conversations": "conversations",
    "op13_personal": "personal",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: import_module(f"stormgrid.llm.{m}").query for k, m in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    modules = {k: import_module(f"stormgrid.llm.{m}") for k, m in _QUERIES.items()}
    return {k: m.SQL for k, m in modules.items() if hasattr(m, "SQL")}
