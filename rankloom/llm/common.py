"""Shared helpers: Arrow text buffers, word hashing, lineage cuts, table loading."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; bounds numpy temporaries, never what is read.
SLICE_BYTES = 2 << 20
#: Bytes of words that are hashed in one step, a whole word at least: each takes some 40 bytes meanwhile.
HASHED_BYTES = 1 << 17

_ASCII = np.arange(128)
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[:128] = [chr(c).isalnum() for c in _ASCII]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files a core below which a table's rows are dealt out anew.
SMALL = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores if their files are so few and small that the scan would leave most of them idle (one row
    group can't be split); larger tables stay as they are."""
    df, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session's spark.checkpoint.dir. Where that is unset, a temporary one on a single machine
    (tests); on a cluster no folder of one machine would do, so it must be set there."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rankloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage in the shared checkpoint folder (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """n longs that a repartition by them into n partitions puts one into each."""
    found: dict[int, int] = {}
    upto = 0
    while len(found) < n:
        lo, upto = upto, max(2 * upto, 16 * n)
        for p, v in spark.range(lo, upto).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id")).collect():
            found.setdefault(p, v)
    return [found[p] for p in range(n)]


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory that Arrow and the C library keep to the system: a worker lives through many stages, and what it
    keeps of one is lost to the others and to the JVM of its executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def runs(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `limit` together, one entry at least; they cover every entry."""
    end = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + limit, side="right")))
        yield lo, hi
        lo = hi


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes, one row at least; together they cover every row."""
    n = len(texts)
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    yield from runs(size, limit)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n+1 offsets into them. A null counts as an empty text."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    n = len(texts)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, dtype=kind, count=n + 1, offset=texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]]; empty segments give 0."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 4096), 0x9E3779B97F4A7C15 | 1, dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits (any non-ASCII byte is a letter): their text's index, start, end and 64-bit hash."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    inside = WORD_BYTE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True  # a word never runs over the end of its text
    starts = np.flatnonzero(inside & (first[:n] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | np.concatenate((~inside[1:], [True])))) + 1
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    hashed = np.concatenate([_hashes(data, starts[lo:hi], ends[lo:hi]) for lo, hi in runs(ends - starts, HASHED_BYTES)])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return doc, starts, ends, hashed


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    length = ends - starts
    first = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(first, length)
    value = data[within + np.repeat(starts, length)].astype(np.uint64)
    value += np.uint64(1)
    value *= powers(int(length.max()))[within]
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64))
