"""Results that are computed once and outlive lost executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that is broadcast, at most.
SMALL = 200_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared checkpoint folder that the session names; where it names none, in a temporary one on
    a single machine (tests), and on a cluster nowhere: it must be named there."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rankloom-"))
    return df.checkpoint()


def small(df: DataFrame, bound: int = SMALL) -> DataFrame:
    """A table computed once, to be broadcast if it has no more than `bound` rows; else joined by a shuffle."""
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= bound else kept
