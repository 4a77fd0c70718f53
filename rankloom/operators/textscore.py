"""Text relevance of (query, document) pairs: character-gram TF-IDF and a BM25-like score. Long tables, no matrices.

docs: (doc_id, title, body) texts for TF-IDF; (doc_id, title, body) token arrays for the rest. pairs: (query_id, doc_id).
queries: (query_id, tokens, synonyms) token arrays, synonyms perhaps null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators.lineage import SMALL as VOCABULARY
from rankloom.operators.lineage import cut_lineage, small

SIZES = (3, 4, 5, 6, 7)
K1, K2 = 1.2, 1000.0


def char_terms(docs: DataFrame, n: int | tuple[int, ...], vocabulary: DataFrame | None = None, include_last: bool = False) -> DataFrame:
    """(doc_id, part, term, tf) of title (T) and body (B), for one gram length or several in one pass over the texts; only terms
    of the vocabulary (term), if given: a small one meets the grams before anything is shuffled."""
    sizes = (n,) if isinstance(n, int) else n
    part = lambda k, c, m: F.transform(X.char_ngrams(F.col(c), m, include_last), lambda t: F.struct(F.lit(k).alias("part"), t.alias("term")))
    rows = docs.select("doc_id", F.explode(F.concat(*[part(k, c, m) for m in sizes for k, c in (("T", "title"), ("B", "body"))])).alias("e")).select("doc_id", "e.*")
    if vocabulary is not None:
        rows = rows.join(vocabulary, "term", "left_semi")
    return rows.groupBy("doc_id", "part", "term").agg(F.count("*").alias("tf"))


def document_frequency(terms: DataFrame) -> DataFrame:
    return terms.groupBy("part", "term").agg(F.count("*").alias("df"))


def tfidf(terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(doc_id, part, term, weight): tf * (ln N - ln df), by part. n_docs: one row (n)."""
    idf = document_frequency(terms).crossJoin(F.broadcast(n_docs)).select("part", "term", (F.ln("n") - F.ln("df")).alias("idf"))
    return terms.join(idf, ["part", "term"]).select("doc_id", "part", "term", (F.col("tf") * F.col("idf")).alias("weight"))


def tfidf_pair_scores(docs: DataFrame, queries: DataFrame, pairs: DataFrame, sizes: tuple[int, ...] = SIZES, title_weight: float = 1.0, body_weight: float = 0.8, compat: bool = False) -> DataFrame:
    """(query_id, doc_id, tf_idf_<n> for each n of sizes): title_weight * title + body_weight * body, each the sum of the document's
    weights over the query's grams of length n, with their multiplicity. queries: (query_id, text). Pairs of an unknown query or
    document vanish. All lengths are counted in one pass over the texts.

    compat: the body's weights come from the title, by the logarithm of the logarithmic frequency (0 where that is not positive).
    """
    named = lambda n: lambda t: F.struct(F.lit(n).alias("n"), t.alias("term"))
    own = F.concat(*[F.transform(X.char_ngrams(F.col("text"), n), named(n)) for n in sizes])
    grams = queries.select("query_id", F.explode(own).alias("g")).groupBy("query_id", "g.n", "g.term").agg(F.count("*").alias("times"))
    n_docs = docs.agg(F.count("*").alias("n"))
    kept = cut_lineage(grams)
    terms = cut_lineage(char_terms(docs, tuple(sizes), small(kept.select("term").distinct())))  # counted, and weighed
    if compat:
        t = terms.where("part = 'T'")
        idf = document_frequency(t).crossJoin(F.broadcast(n_docs)).select("term", (F.ln("n") - F.ln("df")).alias("idf"))
        again = F.when(F.col("idf") > 0, F.ln("n") - F.ln("idf")).otherwise(0.0)
        weights = t.join(idf, "term").crossJoin(F.broadcast(n_docs)).select("doc_id", "term", (F.col("tf") * (title_weight * F.col("idf") + body_weight * again)).alias("weight"))
    else:
        by_part = F.when(F.col("part") == "T", title_weight).otherwise(body_weight)
        weights = tfidf(terms, n_docs).select("doc_id", "term", (by_part * F.col("weight")).alias("weight"))
    pairs = pairs.select("query_id", "doc_id").distinct().join(queries.select("query_id").distinct(), "query_id", "left_semi").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    parts = [F.sum(F.when(F.col("n") == n, F.col("times") * F.col("weight"))).alias(f"s{n}") for n in sizes]
    if kept.count() <= VOCABULARY:  # the queries' grams go to the documents' weights, which are shuffled only once summed
        matched = weights.join(F.broadcast(kept), "term")
    else:
        matched = pairs.join(kept, "query_id").join(weights, ["doc_id", "term"])
    scores = matched.groupBy("query_id", "doc_id").agg(*parts)
    return pairs.join(scores, ["query_id", "doc_id"], "left").select("query_id", "doc_id", *[F.coalesce(f"s{n}", F.lit(0.0)).alias(f"tf_idf_{n}") for n in sizes])


def tfidf_pair_score(docs: DataFrame, queries: DataFrame, pairs: DataFrame, n: int = 3, title_weight: float = 1.0, body_weight: float = 0.8, compat: bool = False) -> DataFrame:
    """tfidf_pair_scores for one length."""
    return tfidf_pair_scores(docs, queries, pairs, (n,), title_weight, body_weight, compat)


def term_pairs(docs: DataFrame, queries: DataFrame, longer_than: int = 0) -> DataFrame:
    """Distinct (query_id, doc_id) that share a token of the title or body, of more than so many letters."""
    long = lambda c: F.filter(F.array_distinct(c), lambda x: F.char_length(x) > longer_than)
    asked = queries.select("query_id", F.explode(long(F.col("tokens"))).alias("term"))
    held = docs.select("doc_id", F.explode(long(F.concat("title", "body"))).alias("term")).join(small(asked.select("term").distinct()), "term", "left_semi")
    return held.join(asked, "term").select("query_id", "doc_id").distinct()


def tokenized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.tokenize(F.col("title")).alias("title"), X.tokenize(F.col("body")).alias("body"))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct (term) of all queries' tokens and synonyms."""
    return queries.select(F.explode(F.concat("tokens", F.coalesce("synonyms", F.array().cast("array<string>")))).alias("term")).distinct()


def query_bigrams(queries: DataFrame) -> DataFrame:
    """Distinct (gram) of plain, reversed and gap bigrams over tokens followed by synonyms."""
    both = F.concat("tokens", F.coalesce("synonyms", F.array().cast("array<string>")))
    return queries.select(F.explode(F.concat(*[X.word_ngrams(both, 2, k) for k in ("plain", "reversed")], X.word_ngrams(both, 2, "gap"))).alias("gram")).distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, term, tf, title_tf) of the terms in body and title."""
    part = lambda c, k: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(k).alias("t")))
    rows = docs.select("doc_id", F.explode(F.concat(part("body", 0), part("title", 1))).alias("e")).select("doc_id", "e.*").join(small(terms), "term", "left_semi")
    return rows.groupBy("doc_id", "term").agg(F.count_if(F.col("t") == 0).alias("tf"), F.sum("t").alias("title_tf"))


def forward_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, term, positions) in the body."""
    rows = docs.select("doc_id", F.posexplode("body").alias("pos", "term")).join(small(terms), "term", "left_semi")
    return rows.groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def document_lengths(counts: DataFrame) -> DataFrame:
    """(doc_id, dl): known tokens in the body."""
    return counts.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def log_icf(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, icf, median_icf): ln(all known tokens in bodies / those of the term), a term that is nowhere counting as once."""
    cf = terms.join(counts.groupBy("term").agg(F.sum("tf").alias("cf")), "term", "left").select("term", F.coalesce("cf", F.lit(0)).alias("cf"))
    total = cf.agg(F.sum("cf").alias("total"))
    ratio = F.col("total") / F.greatest("cf", F.lit(1))
    icf = cf.crossJoin(F.broadcast(total)).select("term", F.ln(X.positive_or_one(ratio)).alias("icf"))
    return icf.crossJoin(F.broadcast(icf.agg(F.median("icf").alias("median_icf"))))


def _tokens(pairs: DataFrame, queries: DataFrame, column: str) -> DataFrame:
    return pairs.join(queries.select("query_id", F.explode(column).alias("term")), "query_id")


def unigram_score(pairs: DataFrame, queries: DataFrame, counts: DataFrame, icf: DataFrame, lengths: DataFrame, column: str = "tokens", k1: float = K1, k2: float = K2) -> DataFrame:
    """(query_id, doc_id, score): sum over the query's tokens of icf * (tf/(tf + k1 + dl/k2) + 3h/(1+h)), h: in the title."""
    rows = _tokens(pairs, queries, column).join(icf, "term").join(counts, ["doc_id", "term"]).join(lengths, "doc_id")
    h = X.binarise(F.col("title_tf"))
    value = F.col("icf") * (F.col("tf") / (F.col("tf") + k1 + F.col("dl") / k2) + 3.0 * h / (1.0 + h))
    return rows.groupBy("query_id", "doc_id").agg(F.sum(value).alias("score"))


def bigram_counts(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(doc_id, gram, tf): 1.2 plain + .7 reversed + .5 gap occurrences, those in the title threefold."""
    kinds = (("plain", 1.2), ("reversed", 0.7), ("gap", 0.5))
    part = lambda c, k, w: F.transform(X.word_ngrams(F.col(c), 2, k), lambda g: F.struct(g.alias("gram"), F.lit(w).alias("w")))
    rows = docs.select("doc_id", F.explode(F.concat(*[part(c, k, w * m) for k, w in kinds for c, m in (("body", 1.0), ("title", 3.0))])).alias("e"))
    return rows.select("doc_id", "e.*").join(small(grams), "gram", "left_semi").groupBy("doc_id", "gram").agg(F.sum("w").alias("tf"))


def bigram_score(pairs: DataFrame, queries: DataFrame, bigrams: DataFrame, icf: DataFrame, column: str = "tokens") -> DataFrame:
    """(query_id, doc_id, score): sum over the query's bigrams of (icf(a) + icf(b)) * tf/(1 + tf)."""
    g = queries.select("query_id", F.explode(X.word_ngrams(F.col(column), 2)).alias("gram"))
    one, two = (icf.select(F.col("term").alias(k), F.col("icf").alias(f"icf_{k}")) for k in "ab")
    g = g.withColumns({"a": F.split_part("gram", F.lit(" "), F.lit(1)), "b": F.split_part("gram", F.lit(" "), F.lit(2))}).join(one, "a").join(two, "b")
    rows = pairs.join(g, "query_id").join(bigrams, ["doc_id", "gram"])
    return rows.groupBy("query_id", "doc_id").agg(F.sum((F.col("icf_a") + F.col("icf_b")) * F.col("tf") / (1.0 + F.col("tf"))).alias("score"))


def _rare(queries: DataFrame, icf: DataFrame, column: str) -> DataFrame:
    """(query_id, rare): sum of those icf of the query's tokens that exceed half the median."""
    t = queries.select("query_id", F.explode(column).alias("term")).join(icf, "term")
    return t.groupBy("query_id").agg(F.sum(F.when(F.col("icf") > F.col("median_icf") / 2, F.col("icf")).otherwise(0.0)).alias("rare"))


def all_words_score(pairs: DataFrame, queries: DataFrame, counts: DataFrame, icf: DataFrame, penalty: float = 0.03, enough: int = 5, column: str = "tokens") -> DataFrame:
    """(query_id, doc_id, score): rare * penalty^missing; missing: the query's tokens that the body has no more than `enough` times."""
    t = _tokens(pairs, queries, column).join(counts, ["doc_id", "term"], "left")
    missing = t.groupBy("query_id", "doc_id").agg(F.count_if(F.coalesce("tf", F.lit(0)) <= enough).alias("missing"))
    return missing.join(_rare(queries, icf, column), "query_id").select("query_id", "doc_id", (F.col("rare") * F.pow(F.lit(penalty), "missing")).alias("score"))


def phrase_score(pairs: DataFrame, queries: DataFrame, docs: DataFrame, icf: DataFrame, half: bool = False, column: str = "tokens", counts: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): rare * tf/(1 + tf), tf the non-overlapping matches of the whole query in the body and three
    times those in the title; half: of all runs of half its length.

    counts: term_counts of the query's tokens. With them a text is looked at only for queries whose every token it holds; no
    other can match as a whole, so the scores are the same."""
    asked = queries.select("query_id", F.col(column).alias("q"))
    nothing = None
    if counts is not None and not half:
        kinds = asked.select("query_id", F.size(F.array_distinct("q")).alias("kinds"), F.explode(F.array_distinct("q")).alias("term"))
        held = pairs.join(kinds, "query_id").join(counts.select("doc_id", "term"), ["doc_id", "term"]).groupBy("query_id", "doc_id").agg((F.count("*") == F.first("kinds")).alias("whole"))
        some = cut_lineage(held.where("whole").select("query_id", "doc_id"))
        nothing = pairs.join(asked.select("query_id"), "query_id").join(docs.select("doc_id"), "doc_id").join(some, ["query_id", "doc_id"], "left_anti").join(_rare(queries, icf, column), "query_id").select("query_id", "doc_id", F.lit(0.0).alias("score"))
        pairs = some
    rows = pairs.join(asked, "query_id").join(docs, "doc_id")
    times = lambda p: X.phrase_count(p, F.col("body")) + 3 * X.phrase_count(p, F.col("title"))
    if half:
        n = F.floor(F.size("q") / 2).cast("int")
        runs = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size("q") - n + 1, F.lit(1))), lambda i: F.slice("q", i, n))).otherwise(F.array().cast("array<array<string>>"))
        tf = F.aggregate(runs, F.lit(0), lambda s, p: s + times(p))
    else:
        tf = times(F.col("q"))
    rows = rows.select("query_id", "doc_id", tf.alias("tf")).join(_rare(queries, icf, column), "query_id")
    out = rows.select("query_id", "doc_id", (F.col("rare") * F.col("tf") / (1.0 + F.col("tf"))).alias("score"))
    return out if nothing is None else out.unionByName(nothing)


def total_score(docs: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): unigrams + .4 synonyms' + .2 bigrams + .08 synonyms' + .3 phrase. Pairs of unknown queries or
    documents vanish; see predicted() for them."""
    terms = query_terms(queries)
    counts = cut_lineage(term_counts(docs, terms))  # read again by every part
    icf, lengths = cut_lineage(log_icf(counts, terms)), document_lengths(counts)
    pairs = cut_lineage(pairs.select("query_id", "doc_id").distinct()).join(docs.select("doc_id"), "doc_id", "left_semi").join(queries.select("query_id"), "query_id", "left_semi")
    wanted = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    bigrams = bigram_counts(wanted, query_bigrams(queries))
    parts = [
        (unigram_score(pairs, queries, counts, icf, lengths), 1.0), (unigram_score(pairs, queries, counts, icf, lengths, "synonyms"), 0.4),
        (bigram_score(pairs, queries, bigrams, icf), 0.2), (bigram_score(pairs, queries, bigrams, icf, "synonyms"), 0.2 * 0.4), (phrase_score(pairs, queries, wanted, icf, counts=counts), 0.3),
    ]
    every = pairs.withColumn("score", F.lit(0.0))
    for p, w in parts:
        every = every.unionByName(p.select("query_id", "doc_id", (F.col("score") * w).alias("score")))
    return every.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def predicted(pairs: DataFrame, scores: DataFrame, docs: DataFrame, unknown: float = -2.123) -> DataFrame:
    """The scores of pairs: `unknown` where the document is unknown, no row where the score is zero."""
    known = docs.select("doc_id").distinct().withColumn("__known", F.lit(True))
    out = pairs.select("query_id", "doc_id").distinct().join(scores, ["query_id", "doc_id"], "left").join(known, "doc_id", "left")
    return out.withColumn("score", F.when(F.col("__known").isNull(), F.lit(unknown)).otherwise(F.coalesce("score", F.lit(0.0)))).where("score <> 0").select("query_id", "doc_id", "score")


def top_documents(scores: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): the n best a query, ties by document."""
    rank: Column = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "rank", "doc_id", "score")
