"""Scores by scans of the documents against the same by joins, and what the scans leave out of shuffles."""

import os

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators import docscan as D
from rankloom.operators import textscore as T

SF = "/root/testdata/sf0.001"
DOCS = [
    (1, "red apple", "red apple pie with red apple sauce red apple pie"), (2, "", ""), (3, None, None), (4, "pie", "apple red of pie"), (5, "a b a", "a b a b a b a x a b"),
    (6, "nothing", "nothing to see"), (7, "x", "with sauce apple pie red"), (8, "apple", "apple apple apple apple apple apple red pie"), (9, "é日本", "本日 é日本 日本é apple"),
]
QUERIES = [(10, "red apple pie", "apple"), (11, "a b a", None), (12, "", ""), (13, "pie", "pie sauce"), (14, "apple apple sauce é日本", "unseen"), (15, "absent words", None), (16, "a b a b a b", "b a")]


def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, title string, body string")
    q = spark.createDataFrame(QUERIES, "query_id bigint, t string, s string")
    return docs, q.select("query_id", X.tokenize(F.col("t")).alias("tokens"), X.tokenize(F.col("s")).alias("synonyms"))


def rows(df):
    found = [((r.query_id, r.doc_id), tuple(round(x, 9) for x in r[2:])) for r in df.collect()]
    assert len(found) == len(dict(found))
    return dict(found)


def by_joins(kind, docs, queries, pairs):
    terms = T.query_terms(queries)
    counts = T.term_counts(docs, terms)
    icf = T.log_icf(counts, terms)
    if kind == "unigram":
        return T.unigram_score(pairs, queries, counts, icf, T.document_lengths(counts))
    if kind == "bigram":
        return T.bigram_score(pairs, queries, T.bigram_counts(docs, T.query_bigrams(queries)), icf)
    if kind == "all_words":
        return T.all_words_score(pairs, queries, counts, icf)
    if kind == "total":
        return T.total_score(docs, queries, pairs)
    if kind == "phrase_half":
        return T.phrase_score(pairs, queries.where("size(tokens) >= 2"), docs, icf, half=True)
    return T.phrase_score(pairs, queries, docs, icf, counts=counts)


@pytest.mark.parametrize("step", [7, 1 << 19])
@pytest.mark.parametrize("kind", sorted(D.SCORES))
def test_scans_give_the_scores_of_joins(spark, kind, step, monkeypatch):
    docs, queries = tables(spark)
    docs = T.tokenized(docs)
    for longer_than in (0, 3):
        want = rows(by_joins(kind, docs, queries, T.term_pairs(docs, queries, longer_than)))
        assert want and rows(D.scores(docs.coalesce(1), queries, kind, longer_than)) == want
    # blocks of any size give the same
    words = D._asked(queries, 0)
    k = D._weights(words, D._log_icf(D._frequencies(docs, words)), kind)
    batch = docs.select("doc_id", "body", "title").toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(D, "STEP", step)
    got = {}
    for ids, block in D._scan(words, iter([batch]), 0):
        some, value = D.SCORES[kind](block, k)
        for i, j in zip(*(block.pairs() if some is None else block.pairs() & some).nonzero()):
            got[words.ids[j], ids[int(i)].as_py()] = (round(float(value[i, j]), 9),)
    assert got == rows(by_joins(kind, docs, queries, T.term_pairs(docs, queries)))


@pytest.mark.parametrize("step", [5, 1 << 19])
def test_gram_scores_are_those_of_joins(spark, step, monkeypatch):
    docs, queries = tables(spark)
    tokens = F.concat(X.tokenize(F.col("title")), X.tokenize(F.col("body")))
    texts = queries.select("query_id", F.array_join("tokens", " ").alias("text"))
    for sizes in ((3,), T.SIZES):
        want = rows(T.tfidf_pair_scores(docs, texts, T.term_pairs(T.tokenized(docs), queries), sizes))
        assert len(want) > 5 and rows(D.tfidf_scores(docs, tokens, queries, sizes)) == want
    # a text that is looked at in steps is counted as in one
    q = queries.select("query_id", D._plain(F.array_join("tokens", " ")).alias("x")).collect()
    grams = D.Grams(q, None, (3, 5), D._asked(queries, 0))
    whole = D._gram_counts(grams, [d[2] for d in DOCS])
    monkeypatch.setattr(D, "STEP", step)
    assert all((a == b).all() for k in whole for a, b in zip(whole[k], D._gram_counts(grams, [d[2] for d in DOCS])[k]))


def test_best_are_the_first_of_all_by_rounded_score(spark):
    docs, queries = tables(spark)
    docs = T.tokenized(docs)
    every = T.top_documents(D.scores(docs, queries).withColumn("score", F.round("score", 6)), 2).collect()
    few = T.top_documents(D.scores(docs, queries, best=2).withColumn("score", F.round("score", 6)), 2).collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, few))
    import numpy as np

    assert D._best(np.array([1.0000001, 1.0000002, 0.5, 1.0]), [4, 3, 1, 2], 2) == [3, 1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["bm25_unigram", "bm25_bigram", "bm25_phrase", "bm25_phrase_half", "bm25_all_words", "bm25_total", "bm25_predictions", "tfidf_pair_score_3", "tfidf_pair_scores"])
def test_no_pairs_are_shuffled_or_joined(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Aggregate" not in plan and "LogicalRDD" not in plan


def test_documents_that_share_only_short_words_are_ranked(spark, tmp_path):
    from rankloom.plans import texts

    spark.createDataFrame([(1, "the cat sat"), (2, "mountain view"), (3, "cat")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "the cat of the mountain")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.doc_id for r in texts.topn_docs_per_query(spark, str(tmp_path)).collect()} == {1, 2, 3}
