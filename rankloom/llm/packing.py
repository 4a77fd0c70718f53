"""Packing by optimal length buckets.

Dynamic programming over the whole corpus's length histogram chooses bucket boundaries that minimise padding; batches of
at most `token_budget` padded tokens form inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import cut

BUCKETS = 16
TOKEN_BUDGET = 16384
#: Rows that a task sorts, about.
ROWS_A_TASK = 2_000_000


def token_length(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null and for blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most `buckets` ascending upper bounds (each an occurring length, the last the largest) of least padding.

    Padding of a bucket is sum(count * (bound - length)). The cost obeys the quadrangle inequality, so each layer of the
    dynamic program is filled by divide and conquer: O(buckets * L log L) for L distinct lengths. Among equal costs the
    smallest split point wins. No length: no boundary.
    """
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, dtype=np.int64)[order], np.asarray(counts, dtype=np.int64)[order]
    n = len(x)
    if not n:
        return []
    number = np.concatenate(([0], np.cumsum(c)))
    tokens = np.concatenate(([0], np.cumsum(c * x)))

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        """Padding when the lengths i..j-1 share the bound x[j-1]."""
        return x[j - 1] * (number[j] - number[i]) - (tokens[j] - tokens[i])

    layers = min(buckets, n)
    best = np.array([0] + [int(cost(np.int64(0), j)) for j in range(1, n + 1)], dtype=np.int64)
    choice = [np.zeros(n + 1, dtype=np.int64)]
    for k in range(1, layers):
        now, split = np.full(n + 1, np.iinfo(np.int64).max // 2, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        stack = [(k + 1, n, k, n - 1)]
        while stack:
            lo, hi, from_, to = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(from_, min(mid - 1, to) + 1)
            total = best[i] + cost(i, mid)
            at = int(np.argmin(total))
            now[mid], split[mid] = total[at], i[at]
            stack += [(lo, mid - 1, from_, int(i[at])), (mid + 1, hi, int(i[at]), to)]
        best = now
        choice.append(split)
    bounds, j = [], n
    for k in range(layers - 1, -1, -1):
        bounds.append(int(x[j - 1]))
        j = int(choice[k][j])
    return bounds[::-1]


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, length: Column | None = None) -> DataFrame:
    """One row for each input row: doc_id, n_tokens, bucket, bucket_len, batch_id, slot, padding.

    bucket is the index of the row's length bucket and bucket_len its padded length. Inside a bucket rows stand in order
    of (n_tokens, id, nulls first) and fill batches of max(1, token_budget div bucket_len) rows, so a batch never passes
    the budget unless one single row does. batch_id is 'bucket-index'; slot counts from 0.

    The histogram holds one entry for each distinct length, whatever the number of rows. Rows are sorted by (length, id) over
    all tasks; a row's place in its bucket is its place in that order less the number of rows in shorter buckets, known from
    the histogram. Equal rows are spread too, so no task sees more than its share, however many have one length.

    Null and blank texts have length 0 and are packed like others; repeated rows and ties keep one place each; an empty
    table gives an empty result; other columns, whatever their names, are ignored. Lengths are words unless `length` counts
    otherwise: a text without spaces is one word long.
    """
    spark = docs.sparkSession
    tokens = token_length(F.col(text_col)) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), tokens.alias("n_tokens")))
    hist = rows.groupBy("n_tokens").count().orderBy("n_tokens").collect()  # as many rows as there are distinct lengths
    lengths, counts = np.array([r[0] for r in hist], dtype=np.int64), np.array([r[1] for r in hist], dtype=np.int64)
    bounds = np.array(optimal_boundaries(lengths, counts, buckets), dtype=np.int64)
    shorter = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(lengths, np.concatenate(([-1], bounds[:-1])), side="right")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // ROWS_A_TASK + 1)
    key = [F.col("n_tokens"), F.col("doc_id").asc_nulls_first(), F.col("tie")]
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = cut(tied.repartitionByRange(parts, *key).sortWithinPartitions(*key).select("doc_id", "n_tokens"))
    at = ranged.withColumn("at", F.monotonically_increasing_id())  # task and place in it
    sizes = at.groupBy(F.shiftright("at", 33).alias("task")).count().orderBy("task").collect()  # one row a task
    starts = np.concatenate(([0], np.cumsum([r[1] for r in sizes])))[:-1] if sizes else np.zeros(0, np.int64)
    start = spark.createDataFrame([(int(r[0]), int(x)) for r, x in zip(sizes, starts)], "task bigint, start bigint")
    at = at.withColumn("task", F.shiftright("at", 33)).join(F.broadcast(start), "task").withColumn("order", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1))

    def of_bucket(values: list[int]) -> Column:
        """The value of the row's bucket, its length's."""
        out = F.lit(values[-1] if values else 0).cast("long")
        for bound, value in list(zip(bounds.tolist(), values))[-2::-1]:
            out = F.when(F.col("n_tokens") <= bound, F.lit(value).cast("long")).otherwise(out)
        return out

    known = at.withColumns({
        "bucket": of_bucket(list(range(len(bounds)))), "bucket_len": of_bucket(bounds.tolist()), "place": F.col("order") - of_bucket(shorter.tolist()),
        "capacity": of_bucket([max(1, token_budget // max(1, int(b))) for b in bounds]),
    })
    return known.select(
        "doc_id", "n_tokens", "bucket", "bucket_len",
        F.concat_ws("-", F.col("bucket"), F.expr("place div capacity")).alias("batch_id"),
        (F.col("place") % F.col("capacity")).alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )


SQL = rf"""
with recursive t as (select doc_id, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::bigint as n_tokens from documents),
p as (
  select x, row_number() over (order by x) as j, sum(c) over (order by x)::bigint as number, sum(c * x) over (order by x)::bigint as tokens
  from (select n_tokens as x, count(*) as c from t group by n_tokens)
),
layers as (select least({BUCKETS}, count(*)) as n from p),
dp as (
  select 0::bigint as k, j, x * number - tokens as best, 0::bigint as split from p
  union all
  select k, j, m.v, m.i from (
    select a.k + 1 as k, q.j, min({{'v': a.best + q.x * (q.number - r.number) - (q.tokens - r.tokens), 'i': a.j}}) as m
    from dp a join p r on r.j = a.j join p q on q.j > a.j where a.k + 1 < (select n from layers) and a.j > a.k group by a.k, q.j
  )
),
back as (
  select k, j, split from dp where k = (select n - 1 from layers) and j = (select max(j) from p)
  union all
  select dp.k, dp.j, dp.split from back join dp on dp.k = back.k - 1 and dp.j = back.split
),
b as (select p.x as n_tokens, back.k as bucket, top.x as bucket_len from p join back on p.j > back.split and p.j <= back.j join p top on top.j = back.j),
r as (
  select doc_id, n_tokens, bucket, bucket_len, greatest(1, {TOKEN_BUDGET} // greatest(1, bucket_len)) as capacity,
    row_number() over (partition by bucket order by n_tokens, doc_id nulls first) - 1 as place
  from t join b using (n_tokens)
)
select doc_id, n_tokens, bucket, bucket_len, bucket || '-' || place // capacity as batch_id, place % capacity as slot, bucket_len - n_tokens as padding from r
"""
