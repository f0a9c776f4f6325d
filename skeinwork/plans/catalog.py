"""All core queries by name, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinwork.plans import changes, conversations, pipelines, recalls, streams, tables

FLAGSHIP = "recall_grouped_topk"

_MODULES = (changes, recalls, conversations, tables, streams, pipelines)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()} | {"stream_change_fold": changes.SQL["p5_found"], "stream_keyed_state": changes.LAST_CHANGE}
