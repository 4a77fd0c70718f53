"""Link-graph queries over the supplier-part graph and the pages' links."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions import text as X
from rankloom.operators import graph as G
from rankloom.plans.common import rounded
from rankloom.sources import adapters as A

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


EDGES = """
e as (
  select distinct case when l_returnflag = 'R' then 's' || l_suppkey else 'p' || l_partkey end as src,
    case when l_returnflag = 'R' then 'p' || l_partkey else 's' || l_suppkey end as dst
  from lineitem where l_returnflag in ('R', 'A')
),
v as (select src as id from e union select dst from e),
dg as (select id, (select count(*) from e where src = id) as n_out, (select count(*) from e where dst = id) as n_in from v),
c as (select count(*) as n from v)
"""


@query("select page_id, coalesce(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\\.', ''), '') as domain from pages")
def url_domain(spark: SparkSession, d: str) -> DataFrame:
    return A.load(spark, d, "pages").select("page_id", X.domain(F.col("url")).alias("domain"))


_FOUND = r"""
lu as (select page_id as doc_id, unnest(regexp_extract_all(html, '(?i)(?:^|\W)((?:(?:ht|f)tps?://|www\.)(?:[\w-]+\.)[\w!#$%&''()*+,./:;=?@\[\]{}~-]*)', 1)) as url from pages),
kd as (select min(page_id) as url_id, url from pages group by url)
"""


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = A.load(spark, d, "pages")
    return G.page_links(pages.select(F.col("page_id").alias("doc_id"), "html")), pages.groupBy("url").agg(F.min("page_id").alias("url_id"))


@query(f"with {_FOUND} select doc_id, url, count(*) as n from lu group by all")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d)[0].groupBy("doc_id", "url").agg(F.count("*").alias("n"))


@query(f"with {_FOUND}, nw as (select distinct url from lu where url not in (select url from kd)) select url_id, url from kd where url in (select url from lu) union all select (select max(url_id) from kd) + row_number() over (order by url), url from nw")
def unique_links(spark: SparkSession, d: str) -> DataFrame:
    return G.unique_links(*_pages(spark, d))


@query(f"with {EDGES} select id, n_out, n_in from dg")
def link_adjacency_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(A.graph_edges(spark, d))


@query(f"with {EDGES} select count(*) as n_nodes, count(*) filter (n_out = 0) as end_nodes, count(*) filter (n_in = 0) as no_in_nodes, count(*) filter (id not in (select src from e where src <> dst union select dst from e where src <> dst)) as isolated_nodes from dg")
def graph_counters(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_counters(A.graph_edges(spark, d))


@query(f"with {EDGES} select id || chr(9) || n_out || chr(9) || coalesce((select string_agg(dst, chr(9) order by dst) || chr(9) from e where src = id), '') || n_in || coalesce((select chr(9) || string_agg(src, chr(9) order by src) from e where dst = id), '') as value from dg")
def link_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return G.adjacency_lines(A.graph_edges(spark, d))


def _rank_sql(rounds: int, dangling: bool) -> str:
    steps = [f"r0 as (select id, {'1.0 / n' if dangling else '0.0'} as pr from v, c)"]
    for k in range(1, rounds + 1):
        lost = f"+ .9 * coalesce((select sum(pr) from r{k - 1} join dg using (id) where n_out = 0), 0) / n" if dangling else ""
        steps.append(
            f"g{k} as (select e.dst as id, sum(r.pr / d.n_out) as g from e join r{k - 1} r on r.id = e.src join dg d on d.id = e.src group by e.dst), "
            f"r{k} as (select v.id, .1 / n + .9 * coalesce(g, 0) {lost} as pr from v cross join c left join g{k} using (id))"
        )
    return f"with {EDGES}, {', '.join(steps)} select id, round(pr, 9) as pr from r{rounds}"


@query(_rank_sql(3, False))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.page_rank(A.graph_edges(spark, d), iterations=3, dangling=False), 9)


#: Ten rounds at most, and an end once nine tenths of the nodes have moved by less than 0.0001: the ranks of the first round that is so.
_STOPPED = _rank_sql(10, True).replace("select id, round(pr, 9) as pr from r10", "") + ", " + ", ".join(
    f"m{k} as (select count(*) filter (abs(a.pr - b.pr) < 1e-4) > .9 * count(*) as still from r{k} a join r{k - 1} b using (id))" for k in range(1, 11)
) + ", st as (select least(10, " + ", ".join(f"case when (select still from m{k}) then {k} else 10 end" for k in range(1, 11)) + ") as k) " + " union all ".join(
    f"select id, round(pr, 9) as pr from r{k} where (select k from st) = {k}" for k in range(1, 11)
)


@query(_STOPPED)
def pagerank_dangling(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.page_rank(A.graph_edges(spark, d), stop_share=0.9), 9)


@query(f"with p as ({_STOPPED}) select id, pr, row_number() over (order by pr desc, id) as place from p")
def sort_by_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """The place of each node in descending order of rank, numbered range by range."""
    from rankloom.operators.similarity import number_on

    ranked = pagerank_dangling(spark, d).withColumn("key", F.struct((-F.col("pr")).alias("a"), F.col("id").alias("b")))
    none = ranked.select(F.lit(0).cast("bigint").alias("place"), "key").limit(0)
    return number_on(none, ranked, "place", "key").select(F.col("key.b").alias("id"), (-F.col("key.a")).alias("pr"), "place")


_HITS = ["h0 as (select id, 1.0::double as a, 1.0::double as h from v)"]
for _k in range(1, 4):
    _HITS.append(
        f"h{_k} as (select id, coalesce((select sum(p.h) from e join h{_k - 1} p on p.id = e.src where e.dst = v.id), 0) as a, "
        f"coalesce((select sum(p.a) from e join h{_k - 1} p on p.id = e.dst where e.src = v.id), 0) as h from v)"
    )


@query(f"with {EDGES}, {', '.join(_HITS)} select id, round(a, 3) as a, round(h, 3) as h from h3")
def hits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.hits(A.graph_edges(spark, d)), 3)


@F.arrow_udf(T.BinaryType())
def _deflate(s: pa.Array) -> pa.Array:
    return X.in_runs(s, lambda t: zlib.compress((t or "").encode()), pa.binary())


@query("select page_id, coalesce(html, '') as html from pages")
def inflate_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages through base64 of zlib data and back: the reader's decoding, over the whole table."""
    pages = A.load(spark, d, "pages")
    return pages.select("page_id", X.inflate(F.base64(_deflate("html"))).alias("html"))
