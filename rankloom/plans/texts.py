"""Text queries: grams, TF-IDF and the BM25-like score over documents and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators import docscan as D
from rankloom.operators import textscore as T
from rankloom.operators.lineage import cut_lineage
from rankloom.plans.common import rounded
from rankloom.sources import adapters as A

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', ' ', 'g'), ' +'), lambda x: x <> '')"
_GRAMS = "case when len({0}) > {1} then list_transform(range(1, (len({0}) - {1} + 1)::bigint), lambda i: substr({0}, i, {1})) else [] end"

#: A query is scored on every document that shares one of its words of more than so many letters.
LONG = 5

DOCS = f"""
dc as (select doc_id, regexp_extract(text, '^[^\\n.]*') as title, text as body from documents),
q0 as (select item_id as query_id, {_TOKENS.format("text")} as w from benchmark),
qs as (select query_id, w as tokens, list_filter(w, lambda x: len(x) > 7) as synonyms, array_to_string(w, ' ') as text from q0),
jp as (
  select distinct query_id, doc_id from (select distinct query_id, unnest(w) as term from q0)
  join (select distinct doc_id, unnest({_TOKENS.format("body")}) as term from dc) using (term) where len(term) > {LONG}
)
"""


@query(f"with g as (select item_id, unnest({_GRAMS.format("replace(lower(text), ' ', '')", 3)}) as gram from benchmark) select item_id, gram, count(*) as n from g group by all")
def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return A.load(spark, d, "benchmark").select("item_id", F.explode(X.char_ngrams(F.col("text"), 3)).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("n"))


@query(f"with w as (select doc_id, {_TOKENS.format('text')} as t from documents), g as (select doc_id, unnest(list_transform(range(1, greatest(len(t) - 1, 1)::bigint), lambda i: t[i] || ' ' || t[i + 2])) as gram from w) select doc_id, count(*) as n, count(distinct gram) as kinds, min(gram) as first from g group by doc_id")
def word_ngrams_gap(spark: SparkSession, d: str) -> DataFrame:
    texts = A.dealt(A.load(spark, d, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.collect_list("text").alias("texts"))  # texts move, of which grams are many times as many bytes
    count = lambda g: F.struct(F.size(g).cast("bigint").alias("n"), F.size(F.array_distinct(g)).cast("bigint").alias("kinds"), F.array_min(g).alias("first"))
    grams = F.flatten(F.transform("texts", lambda t: X.word_ngrams(X.tokenize(t), 2, "gap")))
    return texts.select("doc_id", F.explode(F.array(X.bound(count, grams))).alias("c")).where("c.n > 0").select("doc_id", "c.*")


@query(f"with {DOCS}, t as (select doc_id, unnest({_TOKENS.format('body')}) as term from dc) select term, count(distinct doc_id) as df, round(ln((select count(*) from dc)) - ln(count(distinct doc_id)), 6) as idf from t group by term")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    docs = A.documents(spark, d)
    t = docs.select("doc_id", F.explode(F.array_distinct(X.tokenize(F.col("body")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return rounded(t.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("term", "df", (F.ln("n") - F.ln("df")).alias("idf")))


def _tfidf_sql(n: int) -> str:
    # grams from n starting places, each a match after the other: no gram is cut from the text's start anew
    found = lambda columns, source: " union all ".join(f"select {columns}, unnest(regexp_extract_all(substr(x, {o + 1}, greatest(len(x) - {o + 1}, 0)), '(?s).{{{n}}}')) as term from {source}" for o in range(n))
    plain = lambda c: f"replace(lower({c}), ' ', '') as x"
    return f"""with {DOCS}, qx as (select query_id, {plain('text')} from qs), qg as (select query_id, term, count(*) as times from ({found('query_id', 'qx')}) group by all),
dx as materialized (select doc_id, 'T' as part, {plain('title')} from dc union all select doc_id, 'B', {plain('body')} from dc),
tt as (select doc_id, part, term, count(*) as tf from ({found('doc_id, part', 'dx')}) where term in (select term from qg) group by all),
df as (select part, term, ln((select count(*) from dc)) - ln(count(*)) as idf from tt group by all),
sc as (select query_id, doc_id, sum(times * tf * idf * case when part = 'T' then 1.0 else .8 end) as s from jp join qg using (query_id) join tt using (doc_id, term) join df using (part, term) group by all)
select query_id, doc_id, round(coalesce(s, 0), 6) as tf_idf_{n} from jp join dc using (doc_id) left join sc using (query_id, doc_id)"""


def _tfidf(n: int | tuple[int, ...]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs, queries, sizes = A.documents(spark, d), A.text_queries(spark, d), (n,) if isinstance(n, int) else n
        if D.small(queries):
            return rounded(D.tfidf_scores(docs, F.concat(X.tokenize(F.col("title")), X.tokenize(F.col("body"))), queries, sizes, LONG))
        pairs = T.term_pairs(T.tokenized(docs), queries, LONG)
        return rounded(T.tfidf_pair_scores(docs, queries.select("query_id", F.array_join("tokens", " ").alias("text")), pairs, sizes))

    return run


for _n in T.SIZES:
    query(_tfidf_sql(_n), f"tfidf_pair_score_{_n}")(_tfidf(_n))
query("select * from " + " join ".join(f"({_tfidf_sql(_n)}) t{_n}" + ("" if _n == T.SIZES[0] else " using (query_id, doc_id)") for _n in T.SIZES), "tfidf_pair_scores")(_tfidf(T.SIZES))


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The documents' words and the queries."""
    return T.tokenized(A.documents(spark, d)), A.text_queries(spark, d)


def _listed(docs: DataFrame, queries: DataFrame, longer_than: int = LONG) -> tuple[DataFrame, DataFrame]:
    """The documents, kept, and the pairs to score, for query sets too large to be sent to every task."""
    docs = cut_lineage(docs)
    return docs, T.term_pairs(docs, queries, longer_than)


def _total(spark: SparkSession, d: str, longer_than: int = LONG, best: int | None = None) -> DataFrame:
    docs, queries = _texts(spark, d)
    if D.small(queries):
        return D.scores(docs, queries, "total", longer_than, best)
    docs, pairs = _listed(docs, queries, longer_than)
    return T.total_score(docs, queries, pairs)


def _pairs_of(c: str) -> str:
    return f"list_transform(range(1, greatest(len({c}), 1)::bigint), lambda i: {c}[i] || ' ' || {c}[i + 1])"


def _reversed_of(c: str) -> str:
    return f"list_transform(range(1, greatest(len({c}), 1)::bigint), lambda i: {c}[i + 1] || ' ' || {c}[i])"


def _gaps_of(c: str) -> str:
    return f"list_transform(range(1, greatest(len({c}) - 1, 1)::bigint), lambda i: {c}[i] || ' ' || {c}[i + 2])"


_GRAM_ROWS = " union all ".join(f"select doc_id, unnest({f(c)}) as gram, {w * m} as w from tk" for f, w in ((_pairs_of, 1.2), (_reversed_of, 0.7), (_gaps_of, 0.5)) for c, m in (("body", 1.0), ("title", 3.0)))

BM25 = f"""{DOCS},
tk as (select doc_id, {_TOKENS.format('title')} as title, {_TOKENS.format('body')} as body from dc),
vc as (select distinct unnest(list_concat(tokens, synonyms)) as term from qs),
tc as (
  select doc_id, term, sum(1 - t) as tf, sum(t) as ht from (select doc_id, unnest(body) as term, 0 as t from tk union all select doc_id, unnest(title), 1 from tk)
  where term in (select term from vc) group by all
),
dl as (select doc_id, sum(tf) as dl from tc group by doc_id),
cf as (select term, coalesce(sum(tf), 0) as cf from vc left join tc using (term) group by term),
ic as (select term, ln(greatest((select sum(cf) from cf) / greatest(cf, 1), 1e-300)) as icf from cf),
qt as (select query_id, 'b' as k, unnest(tokens) as term from qs union all select query_id, 's', unnest(synonyms) from qs),
un as (select query_id, doc_id, k, sum(icf * (tf / (tf + 1.2 + dl / 1000.0) + case when ht > 0 then 1.5 else 0 end)) as score from jp join qt using (query_id) join ic using (term) join tc using (doc_id, term) join dl using (doc_id) group by all),
qg as (select query_id, 'b' as k, unnest({_pairs_of('tokens')}) as gram from qs union all select query_id, 's', unnest({_pairs_of('synonyms')}) from qs),
gr as (select doc_id, gram, sum(w) as tf from ({_GRAM_ROWS}) where gram in (select gram from qg) group by all),
bi as (
  select query_id, doc_id, k, sum((x.icf + y.icf) * tf / (1 + tf)) as score from jp join qg using (query_id) join gr using (doc_id, gram)
  join ic x on x.term = split_part(gram, ' ', 1) join ic y on y.term = split_part(gram, ' ', 2) group by all
),
ra as (select query_id, sum(case when icf > (select median(icf) from ic) / 2 then icf else 0 end) as rare from qt join ic using (term) where k = 'b' group by query_id),
ph as (
  select query_id, doc_id, rare * tf / (1 + tf) as score from (
    select query_id, doc_id, {{n}}('body') + 3 * {{n}}('title') as tf from jp join qs using (query_id) join tk using (doc_id)) join ra using (query_id)
)
"""


def _times(c: str) -> str:
    s = lambda x: f"(' ' || array_to_string({x}, '  ') || ' ')"
    return f"case when len(tokens) = 0 then 0 else (len({s(c)}) - len(replace({s(c)}, {s('tokens')}, ''))) // len({s('tokens')}) end"


BM25 = BM25.replace("{n}('body')", _times("body")).replace("{n}('title')", _times("title"))


@query(f"with {BM25} select query_id, doc_id, round(score, 6) as score from un where k = 'b'")
def bm25_unigram(spark: SparkSession, d: str) -> DataFrame:
    docs, queries = _texts(spark, d)
    if D.small(queries):
        return rounded(D.scores(docs, queries, "unigram", LONG))
    docs, pairs = _listed(docs, queries)
    terms = T.query_terms(queries)
    counts = cut_lineage(T.term_counts(docs, terms))
    return rounded(T.unigram_score(pairs, queries, counts, T.log_icf(counts, terms), T.document_lengths(counts)))


@query(f"with {BM25} select query_id, doc_id, round(score, 6) as score from bi where k = 'b'")
def bm25_bigram(spark: SparkSession, d: str) -> DataFrame:
    docs, queries = _texts(spark, d)
    if D.small(queries):
        return rounded(D.scores(docs, queries, "bigram", LONG))
    docs, pairs = _listed(docs, queries)
    terms = T.query_terms(queries)
    return rounded(T.bigram_score(pairs, queries, T.bigram_counts(docs, T.query_bigrams(queries)), T.log_icf(T.term_counts(docs, terms), terms)))


@query(f"with {BM25} select query_id, doc_id, round(score, 6) as score from ph")
def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    docs, queries = _texts(spark, d)
    if D.small(queries):
        return rounded(D.scores(docs, queries, "phrase", LONG))
    docs, pairs = _listed(docs, queries)
    terms = T.query_terms(queries)
    counts = cut_lineage(T.term_counts(docs, terms))
    return rounded(T.phrase_score(pairs, queries, docs, T.log_icf(counts, terms), counts=counts))


@query(f"with {BM25}, ms as (select query_id, doc_id, count(*) filter (coalesce(tf, 0) <= 5) as m from jp join qt using (query_id) left join tc using (doc_id, term) where k = 'b' group by all) select query_id, doc_id, round(rare * pow(.03, m), 6) as score from ms join ra using (query_id)")
def bm25_all_words(spark: SparkSession, d: str) -> DataFrame:
    docs, queries = _texts(spark, d)
    if D.small(queries):
        return rounded(D.scores(docs, queries, "all_words", LONG))
    docs, pairs = _listed(docs, queries)
    terms = T.query_terms(queries)
    counts = cut_lineage(T.term_counts(docs, terms))
    return rounded(T.all_words_score(pairs, queries, counts, T.log_icf(counts, terms)))


_TOTAL = """
tl as (
  select query_id, doc_id, sum(score) as score from (
    select query_id, doc_id, 0.0 as score from jp where doc_id in (select doc_id from dc)
    union all select query_id, doc_id, score * case when k = 'b' then 1.0 else .4 end from un
    union all select query_id, doc_id, score * case when k = 'b' then .2 else .08 end from bi
    union all select query_id, doc_id, score * .3 from ph) group by all
)
"""


@query(f"with {BM25}, {_TOTAL} select query_id, doc_id, round(score, 6) as score from tl")
def bm25_total(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_total(spark, d))


@query(f"with {BM25}, {_TOTAL} select query_id, doc_id, round(score, 6) as score from tl where round(score, 9) <> 0")
def bm25_predictions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_total(spark, d).where("score <> 0"))  # every pair's document is known


#: The same over every document that shares any word with a query.
ANY = BM25.replace(f" where len(term) > {LONG}", "")


@query(f"with {ANY}, {_TOTAL}, rk as (select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from tl) select query_id, rank::int as rank, doc_id, score from rk where rank <= 10")
def topn_docs_per_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.top_documents(_total(spark, d, 0, best=10).withColumn("score", F.round("score", 6))))


@query(f"with {BM25}, p as (select doc_id, unnest(body) as term, unnest(range(len(body))) as pos from tk) select doc_id, term, count(*) as n, min(pos)::int as first, max(pos)::int as last from p where term in (select term from vc) group by all")
def forward_index(spark: SparkSession, d: str) -> DataFrame:
    docs, queries = _texts(spark, d)
    f = T.forward_index(docs, T.query_terms(queries))
    return f.select("doc_id", "term", F.size("positions").cast("bigint").alias("n"), F.element_at("positions", 1).alias("first"), F.element_at("positions", -1).alias("last"))
