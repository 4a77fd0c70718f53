"""Click-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import clicklog as C
from rankloom.operators import similarity as S
from rankloom.operators.lineage import cut_lineage
from rankloom.plans.common import BASE, CTR, KNOWN, rounded, sql_rounded
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


def _in(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The log and whole dictionaries."""
    return A.sessions(spark, d), A.query_dictionary(spark, d), A.url_dictionary(spark, d)


def _some(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The log and the dictionaries that leave entries out, for the operators whose feature is to filter by them."""
    return A.sessions(spark, d), A.known_queries(spark, d), A.known_urls(spark, d)


@query(f"with {BASE}, {CTR} select query, url, clicks::bigint as clicks, shows::bigint as shows, round(case when clicks > 0 and shows > 0 then clicks / shows end, 6) as qdoc_ctr from ctr")
def qdoc_ctr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.qdoc_ctr(*_in(spark, d)))


@query(f"with {KNOWN}, {CTR} select query, url, round(clicks / shows, 6) as ctr from ctr where clicks > 0 and shows > 0")
def qdoc_ctr_positive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.positive_ctr(_some(spark, d)[0], "qdoc", *_some(spark, d)[1:]))


@query(f"with {KNOWN} select url, round(sum(c) / sum(1 - c), 6) as ctr from ku group by url having sum(c) > 0 and sum(1 - c) > 0")
def url_global_ctr(spark: SparkSession, d: str) -> DataFrame:
    log, _, urls = _some(spark, d)
    return rounded(C.positive_ctr(log, "global", urls=urls))


@query(f"with {KNOWN} select url, (p + 1)::int as rank, round(sum(c) / sum(1 - c), 6) as ctr from ku group by url, p having sum(c) > 0 and sum(1 - c) > 0")
def url_rank_ctr_unbounded(spark: SparkSession, d: str) -> DataFrame:
    log, _, urls = _some(spark, d)
    return rounded(C.positive_ctr(log, "rank", urls=urls))


_RANKS = ", ".join(f"coalesce(sum(c) filter (least(p, 9) = {r}) / nullif(sum(1 - c) filter (least(p, 9) = {r}), 0), 0) as r{r}" for r in range(10))
_RANK_SQL = (
    f"rk as (select url, sum(c) as clicks, sum(1 - c) as shows, {_RANKS} from ku group by url), "
    "rc as (select url, case when clicks > 0 and shows > 0 then clicks / shows end as url_global_ctr, "
    + ", ".join(f"case when greatest({', '.join(f'r{i}' for i in range(10))}) > 0 then r{r} end as url_rank_ctr_{r + 1}" for r in range(10))
    + " from rk)"
)


@query(f"with {BASE}, {_RANK_SQL} select url, {sql_rounded(C.URL_FEATURES[:11])} from rc")
def url_rank_ctr(spark: SparkSession, d: str) -> DataFrame:
    log, _, urls = _in(spark, d)
    return rounded(C.url_ctr(log, urls))


@query(f"with {BASE}, {CTR} select query, url, a_n::bigint as a_n, a_d::bigint as a_d, s_n::bigint as s_n, s_d::bigint as s_d from sdbn")
def sdbn_counters(spark: SparkSession, d: str) -> DataFrame:
    return C.click_model_counters(*_in(spark, d))


_PLAIN = """
w as (select *, list_filter(shown, lambda u: list_contains(clicked, u)) as hit from sess where len(clicked) > 0),
x as (select *, case when len(hit) > 0 then shown[1:list_position(shown, hit[-1])] else shown end as seen from w),
y as (select query, unnest(clicked) as url, 1 as a_n, 0 as a_d, 0 as s_n, 1 as s_d from x union all select query, unnest(seen), 0, 1, 0, 0 from x union all select query, clicked[-1], 0, 0, 1, 0 from x),
z as (select query, url, sum(a_n) as a_n, sum(a_d) as a_d, sum(s_n) as s_n, sum(s_d) as s_d from y where query in (select query from qd) group by query, url)
"""


@query(f"with {KNOWN}, {_PLAIN} select query, url, round((a_n + .1) / (a_d + .2), 6) as a_u, round((s_n + .1) / (s_d + .2), 6) as s_u, round((a_n + .1) / (a_d + .2) * (s_n + .1) / (s_d + .2), 6) as r_u from z")
def sdbn_relevance(spark: SparkSession, d: str) -> DataFrame:
    log, queries, _ = _some(spark, d)
    return rounded(C.click_model(C.click_model_counters(log, queries)).select("query", "url", "a_u", "s_u", "r_u"))


_QUERY = """
qf as (
  select query, sum(len(clicked)) / count(*) as mean_click, sum(case when len(shown) > 0 then len(clicked) // len(shown) else 0 end) / count(*) as mean_show_click,
    sum(greatest(coalesce(list_position(shown, clicked[1]), 0) - 1, 0)) / count(*) as mean_first_pos,
    sum(greatest(coalesce(list_position(shown, clicked[-1]), 0) - 1, 0)) / count(*) as mean_last_pos
  from sess where query in (select query from qd) group by query
)
"""


@query(f"with {BASE}, {_QUERY} select query, {sql_rounded(C.QUERY_FEATURES)} from qf")
def features_query(spark: SparkSession, d: str) -> DataFrame:
    log, queries, _ = _in(spark, d)
    return rounded(C.features_query(log, queries))


@query(f"with {BASE}, {_QUERY} select query, round(mean_click, 6) as mean_click from qf")
def query_mean_click(spark: SparkSession, d: str) -> DataFrame:
    return features_query(spark, d).select("query", "mean_click")


@query(f"with {BASE}, {_QUERY} select query, {sql_rounded(C.QUERY_FEATURES[2:])} from qf")
def query_click_positions(spark: SparkSession, d: str) -> DataFrame:
    return features_query(spark, d).select("query", *C.QUERY_FEATURES[2:])


_URL = """
pl as (select *, row_number() over (partition by sid, c order by p) - 1 as q, max(c) over (partition by sid, url) as any_click from ku),
uf as (
  select url, sum(c) as click_count, sum(1 - c) as shows_count, coalesce(sum(q) filter (c = 0 and any_click = 1), 0) / nullif(sum(c), 0) as mean_click_pos,
    coalesce(sum(q) filter (c = 0), 0) / nullif(sum(1 - c), 0) as mean_show_pos
  from pl group by url
)
"""


@query(f"with {BASE}, {_URL} select url, click_count::bigint as click_count, shows_count::bigint as shows_count from uf")
def url_counts(spark: SparkSession, d: str) -> DataFrame:
    log, _, urls = _in(spark, d)
    return C.url_positions(log, urls).select("url", "click_count", "shows_count")


@query(f"with {BASE}, {_URL} select url, round(mean_click_pos, 6) as mean_click_pos, round(mean_show_pos, 6) as mean_show_pos from uf")
def url_mean_positions(spark: SparkSession, d: str) -> DataFrame:
    log, _, urls = _in(spark, d)
    return rounded(C.url_positions(log, urls).select("url", "mean_click_pos", "mean_show_pos"))


@query(f"with {BASE}, {_RANK_SQL}, {_URL} select url, {sql_rounded(C.URL_FEATURES[:11])}, click_count::bigint as click_count, shows_count::bigint as shows_count, round(mean_click_pos, 6) as mean_click_pos, round(mean_show_pos, 6) as mean_show_pos from rc join uf using (url)")
def features_url(spark: SparkSession, d: str) -> DataFrame:
    log, _, urls = _in(spark, d)
    return rounded(C.features_url(cut_lineage(log), urls))


_QD = """
qx as (
  select coalesce(ctr.query, sdbn.query) as query, coalesce(ctr.url, sdbn.url) as url, case when clicks > 0 and shows > 0 then clicks / shows end as qdoc_ctr,
    coalesce(a_n, 0)::bigint as a_n, coalesce(a_d, 0)::bigint as a_d, coalesce(s_n, 0)::bigint as s_n, coalesce(s_d, 0)::bigint as s_d
  from ctr full join sdbn on ctr.query = sdbn.query and ctr.url = sdbn.url
),
qf2 as (select *, (a_n + .1) / (a_d + .2) as a_u, (s_n + .1) / (s_d + .2) as s_u, (a_n + .1) / (a_d + .2) * ((s_n + .1) / (s_d + .2)) as r_u from qx)
"""


@query(f"with {BASE}, {CTR}, {_QD} select query, url, round(qdoc_ctr, 6) as qdoc_ctr, a_n, a_d, s_n, s_d, round(a_u, 6) as a_u, round(s_u, 6) as s_u, round(r_u, 6) as r_u from qf2")
def features_qd(spark: SparkSession, d: str) -> DataFrame:
    log, queries, urls = _in(spark, d)
    return rounded(C.features_qd(cut_lineage(log), queries, urls))  # the log is read by every part, and made once


_FLAT = "array_to_string(shown, ',') as shown, array_to_string(clicked, ',') as clicked"


def _flat(log: DataFrame, *columns: str) -> DataFrame:
    return log.select(*columns, F.array_join("shown", ",").alias("shown"), F.array_join("clicked", ",").alias("clicked"))


@query(f"with {KNOWN} select sid, query, {_FLAT} from sess where query in (select query from qd)")
def filter_log_known_query(spark: SparkSession, d: str) -> DataFrame:
    log, queries, _ = _some(spark, d)
    return _flat(C.filter_log(log, queries), "sid", "query")


@query(f"with {KNOWN} select sid, query, {_FLAT} from sess where sid in (select sid from ku)")
def filter_log_known_url(spark: SparkSession, d: str) -> DataFrame:
    log, _, urls = _some(spark, d)
    return _flat(C.filter_log(log, None, urls), "sid", "query")


@query(f"with {BASE} select distinct query, {_FLAT} from sess")
def distinct_log(spark: SparkSession, d: str) -> DataFrame:
    return C.distinct_log(_flat(_in(spark, d)[0], "query"))


@query(f"with {KNOWN}, p as (select distinct query, url from ent) select * from p where query in (select query from qd) or url in (select url from ud)")
def filter_pairs(spark: SparkSession, d: str) -> DataFrame:
    log, queries, urls = _some(spark, d)
    return C.filter_pairs(C.entries(log).select("query", "url").distinct(), queries, urls)


@query(f"with {BASE} select distinct query, url, case when c = 1 then 'clicked' else 'shown' end as kind from ent")
def query_link_profile(spark: SparkSession, d: str) -> DataFrame:
    return S.link_rows(_in(spark, d)[0]).select("query", F.col("link").alias("url"), F.when(F.col("clicked"), "clicked").otherwise("shown").alias("kind"))


def _asked(log: DataFrame) -> DataFrame:
    """What of the profiles the words need."""
    return log.select("query").distinct()


_WORDS = "wd as (select query, unnest(list_filter(regexp_split_to_array(query, '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) as word from qall)"


@query(f"with {BASE}, {_WORDS} select word, query from wd")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return S.inverted_index(_asked(_in(spark, d)[0]))


_LINKS = """
li as (select distinct query, url, c from ent),
n as (select query, sum(1 - c) as ns, sum(c) as nc from li group by query having sum(1 - c) > 0 and sum(c) > 0),
pr as (select a.query, b.query as sim, a.c, count(*) as m from li a join li b on a.url = b.url and a.c = b.c and a.query <> b.query group by all),
ds as (
  select query, sim, sum(case when c = 0 then m / (x.ns * y.ns) else 5.0 * m / (x.nc * y.nc) end) as dist
  from pr join n x using (query) join n y on pr.sim = y.query where query in (select query from qd) group by query, sim
),
rk as (select *, row_number() over (partition by query order by round(dist, 12) desc, sim) as rank from ds)
"""


@query(f"with {KNOWN}, {_LINKS} select query, rank::int as rank, sim as \"similar\", round(dist, 6) as dist from rk where rank <= 20")
def query_similarity_links_top20(spark: SparkSession, d: str) -> DataFrame:
    log, queries, _ = _some(spark, d)
    every = S.link_rows(log)
    dist = S.row_distances(every.join(queries.select("query"), "query", "left_semi"), every).withColumn("dist", F.round("dist", 12))
    return rounded(S.top_similar(dist, threshold=None))


_TEXT = f"""{_WORDS},
wn as (select query, count(*) as n from wd group by query),
dw as (select distinct query, word from wd),
ts as (
  select a.query, b.query as sim, count(*) / (any_value(x.n) * any_value(y.n)) as dist from dw a join dw b on a.word = b.word and a.query <> b.query
  join wn x on a.query = x.query join wn y on b.query = y.query where a.query in (select query from qd) group by a.query, b.query
),
tk as (select *, row_number() over (partition by query order by round(dist, 12) desc, sim) as rank from ts where dist > .1)
"""


@query(f"with {KNOWN}, {_TEXT} select query, rank::int as rank, sim as \"similar\", round(dist, 6) as dist from tk where rank <= 20")
def query_similarity_text_top20(spark: SparkSession, d: str) -> DataFrame:
    log, queries, _ = _some(spark, d)
    known, every = S.split_profiles(_asked(log), queries)
    return rounded(S.top_similar(S.text_distances(known, every).withColumn("dist", F.round("dist", 12))))


@query(
    f"with {KNOWN}, {_TEXT}, nw as (select distinct sim as query from tk where rank <= 20 and sim not in (select query from qd)) "
    "select query_id, query from qd union all select (select max(query_id) from qd) + row_number() over (order by query), query from nw"
)
def extend_query_dictionary(spark: SparkSession, d: str) -> DataFrame:
    log, queries, _ = _some(spark, d)
    known, every = S.split_profiles(_asked(log), queries)
    return S.extend_dictionary(queries, S.top_similar(S.text_distances(known, every))).select(F.col("query_id").cast("bigint").alias("query_id"), "query")


@query(
    f"with {KNOWN}, {_WORDS}, vw as (select distinct word from wd join qd using (query)), "
    "su as (select query, avg((url in (select url from ud))::int) as u from (select distinct query, url from ck) group by query), "
    "sw as (select query, avg((word in (select word from vw))::int) as w from wd group by query) "
    "select query from su join sw using (query) where u >= .4 and w >= 1 / 3"
)
def similarity_candidates(spark: SparkSession, d: str) -> DataFrame:
    log, queries, urls = _some(spark, d)
    return S.similar_candidates(S.profiles(log), urls, S.vocabulary(queries)).select("query")
