"""The click log's counters over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rankloom.operators.clicklog import ctr_counts, entries


def running_ctr_counts(log: DataFrame, *key: str) -> DataFrame:
    """Clicks and shows by query and URL (or the given keys) of a streaming log, for output mode `update` or `complete`.

    The counters are plain sums, so state is one row a key.
    """
    return ctr_counts(entries(log), *(key or ("query", "url")))
