"""Queries of the normalisers, list and text functions, and of the log's text format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.functions.domains import TOP_LEVEL
from rankloom.operators import docscan as D
from rankloom.operators import graph as G
from rankloom.operators import similarity as S
from rankloom.operators import textscore as T
from rankloom.plans import links, texts
from rankloom.plans.common import BASE, KNOWN, rounded
from rankloom.sources import adapters as A
from rankloom.sources import io

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_URL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '^http://', ''), '^https://', ''), '^www\.', '')"
_DOMAINS = ", ".join(f"'{x}'" for x in sorted(TOP_LEVEL))


@query(
    "with x as (select page_id, case when page_id % 3 = 0 then ' ' || url when page_id % 3 = 1 then 'https://www.' || url else url || chr(9) end as u from pages), "
    f"p as (select page_id, {_URL} as prepared from x) "
    f"select page_id, prepared, coalesce(regexp_extract(split_part(prepared, '/', 1), '\\.([^.]*)$', 1) in ({_DOMAINS}), false) as valid from p"
)
def prepared_urls(spark: SparkSession, d: str) -> DataFrame:
    """Every page's URL, with blanks and prefixes put before or after it."""
    k = F.pmod("page_id", F.lit(3))
    u = F.when(k == 0, F.concat(F.lit(" "), F.col("url"))).when(k == 1, F.concat(F.lit("https://www."), F.col("url"))).otherwise(F.concat(F.col("url"), F.lit("\t")))
    return A.load(spark, d, "pages").select("page_id", X.prepare_url(u).alias("prepared"), X.is_valid_url(u).alias("valid"))


@query(f"with {BASE} select query, geo, array_to_string(shown, ',') as shown, array_to_string(clicked, ',') as clicked, count(*) as n from sess group by all")
def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The log as lines of text, read again: normalised queries, folded lists of links, geo after the last @."""
    lines = io.log_lines(A.sessions(spark, d).withColumn("query", F.concat(F.lit(" "), F.upper("query"), F.lit("\x0b"))))
    log = io.parse_log(lines).select("query", "geo", F.array_join("shown", ",").alias("shown"), F.array_join("clicked", ",").alias("clicked"))
    return log.groupBy("query", "geo", "shown", "clicked").agg(F.count("*").alias("n"))


@query(f"with {BASE} select sid, u.pos::int as pos, u.url as link from sess, unnest(list_transform(shown, lambda x, i: {{'pos': i - 1, 'url': x || '/a,b'}})) t(u)")
def split_links(spark: SparkSession, d: str) -> DataFrame:
    """Lists of links that hold the delimiter themselves, joined and split again."""
    joined = F.array_join(F.transform("shown", lambda u: F.concat(u, F.lit("/a,b"))), ",")
    return A.sessions(spark, d).select("sid", F.posexplode(X.split_links(joined)).alias("pos", "link"))


_COMMON = "len(list_intersect(list_distinct({0}), list_distinct({1}))) / nullif(len({0}) * len({1}), 0)"


@query(
    "with x as (select p_partkey, regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}_]+') as a, regexp_split_to_array(lower(p_type || ' ' || p_name || ' ' || p_brand), '[^\\p{L}\\p{N}_]+') as b from part), "
    "y as (select p_partkey, list_filter(a, lambda w: w <> '') as a, list_filter(b, lambda w: w <> '') as b from x) "
    f"select p_partkey, round(coalesce({_COMMON.format('a', 'b')}, 0), 6) as text_similarity, "
    f"round(coalesce({_COMMON.format('a', 'b')} + 5.0 * ({_COMMON.format('b', 'b')}), 0), 6) as link_similarity from y"
)
def set_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of word sets, and the weighted overlap of two pairs of lists."""
    a, b = F.lower("p_name"), F.lower(F.concat_ws(" ", "p_type", "p_name", "p_brand"))
    w = A.load(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"), X.words(a).alias("x"), X.words(b).alias("y"))
    x, y = F.col("x"), F.col("y")
    return rounded(w.select("p_partkey", X.text_similarity(F.col("a"), F.col("b")).alias("text_similarity"), X.link_similarity(x, y, y, y).alias("link_similarity")))


@query("with x as (select item_id, trim(regexp_replace(text, ' +', ' ', 'g')) as t from benchmark), g as (select item_id, substr(t, i::bigint, 4) as gram from x, unnest(range(1, len(t) + 1)) r(i)) select item_id, gram, count(*) as n from g group by all")
def char_ngrams_tail(spark: SparkSession, d: str) -> DataFrame:
    return A.load(spark, d, "benchmark").select("item_id", F.explode(X.char_ngrams_tail(F.col("text"), 4)).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("n"))


@query(r"with x as (select page_id, unnest(regexp_extract_all(url, '\p{L}+|\P{L}+')) as part from pages) select page_id, part, count(*) as n from x group by all")
def split_letters(spark: SparkSession, d: str) -> DataFrame:
    return A.load(spark, d, "pages").select("page_id", F.explode(X.split_letters(F.col("url"))).alias("part")).groupBy("page_id", "part").agg(F.count("*").alias("n"))


@query(
    f"with {texts.DOCS}, t as (select doc_id, {texts._TOKENS.format('body')} as t from dc) "
    "select doc_id, len(t) as n, len(list_filter(t, lambda x: x not in ('the', 'der', 'la'))) as kept, list_sum(list_transform(t, lambda x: len(regexp_extract_all(x, '\\p{L}+|\\P{L}+'))))::bigint as pieces from t where len(t) > 0"
)
def token_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document: all, without stop words, and cut at letter boundaries."""
    b, size = F.col("body"), lambda c: F.size(c).cast("bigint")
    whole = X.bound(lambda t: F.struct(size(t).alias("n"), size(X.without(t, ["the", "der", "la"])).alias("kept")), X.tokenize(b))
    t = A.documents(spark, d).select("doc_id", b, F.explode(F.array(whole)).alias("c")).where("c.n > 0")  # a row as it was: a filter on it doesn't cut the text again
    return t.select("doc_id", "c.n", "c.kept", size(X.tokenize(b, boundaries=True)).alias("pieces"))


@query(
    f"with {KNOWN}, ok as (select sid from sess where query in (select query from qd) union select sid from sh where url in (select url from ud)) "
    "select query, count(distinct url) as links from sh where sid in (select sid from ok) group by query"
)
def known_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Links shown in sessions of a known query or with a known URL."""
    rows = S.link_rows(S.known_sessions(A.sessions(spark, d), A.known_queries(spark, d), A.known_urls(spark, d)))
    return rows.where("not clicked").groupBy("query").agg(F.count("*").alias("links"))


@query(
    f"with {links._FOUND}, nw as (select distinct url from lu where url not in (select url from kd)), "
    "al as (select url_id, url from kd where url in (select url from lu) union all select (select max(url_id) from kd) + row_number() over (order by url), url from nw) "
    "select doc_id as src, url_id as dst, count(*) as n from lu join al using (url) group by all"
)
def link_edges(spark: SparkSession, d: str) -> DataFrame:
    found, known = links._pages(spark, d)
    return G.link_edges(found, G.unique_links(found, known)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"with {links._FOUND} select p.url as src, lu.url as dst, count(*) as n from lu join kd p on p.url_id = lu.doc_id group by all")
def link_edges_by_url(spark: SparkSession, d: str) -> DataFrame:
    found, known = links._pages(spark, d)
    return G.link_edges_by_url(found, known).groupBy("src", "dst").agg(F.count("*").alias("n"))


_BACK = ["h0 as (select id, 1.0::double as a, 1.0::double as h from v)"]
for _k in range(1, 4):
    _here, _there = ("src", "dst") if _k % 2 else ("dst", "src")
    _BACK.append(
        f"h{_k} as (select id, coalesce((select sum(p.h) from e join h{_k - 1} p on p.id = e.{_there} where e.{_here} = v.id), 0) as a, "
        f"coalesce((select sum(p.a) from e join h{_k - 1} p on p.id = e.{_there} where e.{_here} = v.id), 0) as h from v)"
    )


@query(f"with {links.EDGES}, {', '.join(_BACK)} select id, round(a, 3) as a, round(h, 3) as h from h3")
def hits_compat(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.hits(A.graph_edges(spark, d), compat=True), 3)


_HALF = "list_transform(range(1, greatest(len(tokens) - len(tokens) // 2 + 2, 1)::bigint), lambda i: ' ' || array_to_string(tokens[i:i + len(tokens) // 2 - 1], '  ') || ' ')"


def _runs(c: str) -> str:
    return f"(len({c}) - len(replace({c}, run, ''))) // len(run)"


@query(
    f"with {texts.BM25}, hq as (select query_id, unnest({_HALF}) as run from qs where len(tokens) >= 2), "
    "tx as (select doc_id, ' ' || array_to_string(body, '  ') || ' ' as b, ' ' || array_to_string(title, '  ') || ' ' as t from tk), "
    f"hf as (select query_id, doc_id, sum({_runs('b')} + 3 * {_runs('t')}) as tf from jp join hq using (query_id) join tx using (doc_id) group by all) "
    "select query_id, doc_id, round(rare * tf / (1 + tf), 6) as score from hf join ra using (query_id)"
)
def bm25_phrase_half(spark: SparkSession, d: str) -> DataFrame:
    docs, queries = texts._texts(spark, d)
    if D.small(queries):
        return rounded(D.scores(docs, queries, "phrase_half", texts.LONG))
    docs, pairs = texts._listed(docs, queries)
    terms = T.query_terms(queries)
    return rounded(T.phrase_score(pairs, queries.where("size(tokens) >= 2"), docs, T.log_icf(T.term_counts(docs, terms), terms), half=True))
