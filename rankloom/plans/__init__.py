"""The registered queries over the driver's tables, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.plans import clicks, links, ranking, texts, values

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for part in (clicks, texts, links, ranking, values):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
