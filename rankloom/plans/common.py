"""Rounding and the SQL of the click log that oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql_rounded(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in columns)


BASE = """
base as (
  select l_orderkey as sid, lower(c_mktsegment) || ' ' || lower(o_orderpriority) as query, c_nationkey as geo, 'p' || l_partkey || '.com' as url,
    l_returnflag = 'R' as clk, l_shipdate,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as pos
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
),
sess as (
  select sid, any_value(query) as query, any_value(geo) as geo, list(url order by pos) as shown,
    coalesce(list(url order by l_shipdate, pos) filter (clk), []) as clicked
  from base group by sid
),
qall as (select query, row_number() over (order by query) as query_id from (select distinct query from base)),
qd as (select * from qall),
ud as (select p_partkey as url_id, 'p' || p_partkey || '.com' as url from part),
sh as (select sid, query, unnest(shown) as url, unnest(range(len(shown))) as p from sess),
ck as (select sid, query, unnest(clicked) as url, unnest(range(len(clicked))) as p from sess),
ent as (select sid, query, url, p, 0 as c from sh union all select sid, query, url, p, 1 from ck),
kq as (select * from ent where query in (select query from qd)),
ku as (select * from ent where url in (select url from ud)),
kb as (select * from kq where url in (select url from ud))
"""

#: The same with the dictionaries of the operators whose feature is to keep known entries.
KNOWN = BASE.replace("from qall),", "from qall where query not like '%not specified'),").replace("from part),", "from part where p_type <> 'SMALL'),")

CTR = """
ctr as (select query, url, sum(c) as clicks, sum(1 - c) as shows from kb group by query, url),
f as (
  select sid, query, coalesce(list(url order by p) filter (c = 0), []) as s, coalesce(list(url order by p) filter (c = 1), []) as k
  from kb group by sid, query having sum(c) > 0
),
g as (select *, list_filter(s, lambda u: list_contains(k, u)) as hit from f),
h as (select *, case when len(hit) > 0 then s[1:list_position(s, hit[-1])] else s end as seen from g),
sd as (
  select query, unnest(k) as url, 1 as a_n, 0 as a_d, 0 as s_n, 1 as s_d from h
  union all select query, unnest(seen), 0, 1, 0, 0 from h
  union all select query, k[-1], 0, 0, 1, 0 from h
),
sdbn as (select query, url, sum(a_n) as a_n, sum(a_d) as a_d, sum(s_n) as s_n, sum(s_d) as s_d from sd group by query, url)
"""
