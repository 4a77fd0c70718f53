"""Text functions, scorers, graph and ranking against worked examples."""

import base64
import math
import os
import zlib

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators import graph as G
from rankloom.operators import ltr as L
from rankloom.operators import textscore as T
from rankloom.sources import io


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def test_normalisers(spark):
    lit = F.lit
    assert one(spark, X.prepare_url(lit(" http://www.A.com/x "))) == "A.com/x"
    assert one(spark, X.prepare_url(lit("http://https://www.a.com"))) == "a.com" and one(spark, X.prepare_url(lit("www.http://a.com"))) == "http://a.com"
    assert one(spark, X.prepare_query(lit("\t Foo  "))) == "foo "
    for u, ok in (("a.com:80/x", False), ("a.com", True), ("///", False), ("", False), ("x.COM", False), (None, False)):
        assert one(spark, X.is_valid_url(lit(u).cast("string"))) is ok
    assert one(spark, X.parse_links(lit("junk,http://a.com/x,y,b.ru,zzz"))) == ["a.com/x,y", "b.ru,zzz"]
    urls = ["a.com/1", "b.ru", "c.net/x/y"]
    assert one(spark, X.split_links(X.list_to_string(arr(*urls), ","))) == urls
    assert one(spark, X.string_to_list(lit("a<:LD:><:LD:>b"), "<:LD:>")) == ["a", "b"]
    assert one(spark, X.domain(lit("http://www.a.com/x"))) == "a.com" and one(spark, X.domain(lit("nonsense"))) == ""


def test_similarities(spark):
    assert math.isclose(one(spark, X.overlap_similarity(arr("a", "b", "b"), arr("b", "c"))), 1 / 6)
    assert one(spark, X.link_similarity(arr("x", "y"), arr("x"), arr("y"), arr())) == 0
    assert one(spark, X.link_similarity(arr("x", "y"), arr("x"), arr("y", "z"), arr("x"))) == 5.25
    assert one(spark, X.text_similarity(F.lit("a b"), F.lit("")))== 0


def test_grams_and_words(spark):
    lit = F.lit
    assert one(spark, X.char_ngrams(lit("ab cde"), 3)) == ["abc", "bcd"] and one(spark, X.char_ngrams(lit("ab cde"), 3, True)) == ["abc", "bcd", "cde"] and one(spark, X.char_ngrams(lit("ab"), 3)) == []
    assert one(spark, X.char_ngrams_tail(lit("abcd"), 3)) == ["abc", "bcd", "cd", "d"] and one(spark, X.char_ngrams_tail(lit(""), 3)) == []
    assert one(spark, X.word_ngrams(arr(*"abcd"), 2, "gap")) == ["a c", "b d"] and one(spark, X.word_ngrams(arr(*"abc"), 2, "reversed")) == ["b a", "c b"]
    assert one(spark, X.words(lit("привет мир"), False)) == [] and one(spark, X.words(lit("привет мир"))) == ["привет", "мир"] and one(spark, X.words(lit(" x y"), False)) == ["", "x", "y"]
    assert one(spark, X.split_letters(lit("ab12c"))) == ["ab", "12", "c"]
    assert one(spark, X.tokenize(lit("A&nbsp;Wörd, the 12th"), ["the"], True)) == ["a", "wörd", "12", "th"]
    assert one(spark, X.space_split(lit("a  b"))) == ["a", "", "b"]
    assert one(spark, X.phrase_positions(arr("a", "a"), arr("a", "a", "a"))) == [0] and one(spark, X.phrase_count(arr("a", "b"), arr(*"abxab"))) == 2 and one(spark, X.phrase_count(arr(), arr("a"))) == 0
    assert one(spark, X.binarise(lit(-1))) == 0 and one(spark, X.positive_or_one(lit(0.0))) == 1
    assert one(spark, X.lemmatise(arr("Cats", "cats"), str.lower)) == ["cats", "cats"] and one(spark, X.lemmatise(arr("a"))) == ["a"]


def test_inflate_and_links(spark, tmp_path):
    html = '<a href="http://www.a.com/x">é</a> <img src="http://a.com/i.png"> http://b.org/y'
    good = base64.b64encode(zlib.compress(html.encode())).decode()
    (tmp_path / "pages.tsv").write_text(f"1\t{good}\n2\tbroken!!\n3\taGk=\n")
    pages = io.read_pages(spark, str(tmp_path / "pages.tsv"))
    assert [r.html for r in pages.orderBy("doc_id").collect()] == [html, "", ""]
    links = G.page_links(pages)
    assert [r.url for r in links.collect()] == ["http://www.a.com/x", "http://a.com/i.png", "http://b.org/y"]
    assert [r.url for r in G.site_links(links, "a.com").collect()] == ["http://www.a.com/x"]
    known = spark.createDataFrame([(7, "http://b.org/y"), (9, "http://z")], "url_id int, url string")
    assert sorted((r.url_id, r.url) for r in G.unique_links(links, known).collect()) == [(7, "http://b.org/y"), (10, "http://a.com/i.png"), (11, "http://www.a.com/x")]
    assert [tuple(r) for r in G.link_edges(links, known).collect()] == [(1, 7)]
    assert G.link_edges_by_url(links, known.unionByName(spark.createDataFrame([(1, "http://me")], known.schema))).first().src == "http://me"


FIVE = [("A", "B"), ("A", "D"), ("B", "E"), ("C", "A"), ("D", "A"), ("E", "A")]


def values(df, *cols):
    return {r.id: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_page_rank(spark):
    e = spark.createDataFrame(FIVE, "src string, dst string")
    got = values(G.page_rank(e, iterations=2, dangling=False), "pr")
    assert {k: round(v, 6) for k, v in got.items()} == {"A": 0.074, "B": 0.029, "C": 0.02, "D": 0.029, "E": 0.038}
    three = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "C")], "src string, dst string")
    for k, want in enumerate([(0.283333, 0.433333, 0.283333), (0.313333, 0.373333, 0.313333), (0.295333, 0.409333, 0.295333), (0.306133, 0.387733, 0.306133)], 1):
        got = values(G.page_rank(three, iterations=k), "pr")
        assert all(math.isclose(got[n], w, abs_tol=1e-6) for n, w in zip("ABC", want)) and math.isclose(sum(got.values()), 1)
    for k, want in enumerate([(0.183333, 0.333333, 0.183333), (0.238333, 0.253333, 0.238333), (0.218833, 0.319333, 0.218833), (0.242683, 0.295933, 0.242683)], 1):
        got = values(G.page_rank(three, iterations=k, compat=True), "pr")
        assert all(math.isclose(got[n], w, abs_tol=1e-6) for n, w in zip("ABC", want))
    early = values(G.page_rank(three, iterations=50, stop_share=0.9), "pr")
    assert math.isclose(sum(early.values()), 1) and abs(early["A"] - early["C"]) < 1e-9
    assert G.page_rank(e.limit(0)).count() == 0


def test_hits_and_counters(spark):
    e = spark.createDataFrame(FIVE, "src string, dst string")
    for k, want in enumerate(["32 11 01 11 11", "32 21 03 23 13", "94 21 03 23 13"], 1):
        got = values(G.hits(e, k), "a", "h")
        assert [got[n] for n in "ABCDE"] == [(float(w[0]), float(w[1])) for w in want.split()]
    for k, want in enumerate(["22 11 11 11 11", "33 22 00 22 11", "44 11 33 33 33"], 1):
        got = values(G.hits(e, k, compat=True), "a", "h")
        assert [got[n] for n in "ABCDE"] == [(float(w[0]), float(w[1])) for w in want.split()]
    assert tuple(G.graph_counters(e).first()) == (5, 0, 1, 0)
    assert G.adjacency_lines(e).where("value like 'A%'").first().value == "A\t2\tB\tD\t3\tC\tD\tE"
    assert [r.id for r in G.sorted_by(G.hits(e), "a").collect()][0] == "A"


def test_scorers(spark):
    docs = spark.createDataFrame([(1, "red car", "the red car is a red car"), (2, "sea", "blue sea and red sun"), (3, "x", "nothing here")], "doc_id int, title string, body string")
    queries = spark.createDataFrame([(1, ["red", "car"], ["sun"]), (2, ["zzz"], None)], "query_id int, tokens array<string>, synonyms array<string>")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (1, 99)], "query_id int, doc_id int")
    t = T.tokenized(docs)
    terms = T.query_terms(queries)
    counts = T.term_counts(t, terms)
    icf = {r.term: (r.icf, r.median_icf) for r in T.log_icf(counts, terms).collect()}
    total, cf = 6, {"red": 3, "car": 2, "sun": 1, "zzz": 1}
    want = {k: math.log(total / v) for k, v in cf.items()}
    median = sorted(want.values())[1] / 2 + sorted(want.values())[2] / 2
    assert all(math.isclose(icf[k][0], want[k]) and math.isclose(icf[k][1], median) for k in want)
    got = {(r.query_id, r.doc_id): r.score for r in T.total_score(t, queries, pairs).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (2, 1)} and got[(1, 3)] == 0 == got[(2, 1)]
    uni = sum(want[w] * (2 / (2 + 1.2 + 4 / 1000) + 1.5) for w in ("red", "car"))
    tf = 1.2 * (2 + 3) + 0.5 * 0 + 0.7 * 0
    rare = sum(want[w] for w in ("red", "car") if want[w] > median / 2)
    assert math.isclose(got[(1, 1)], uni + 0.2 * (want["red"] + want["car"]) * tf / (1 + tf) + 0.3 * rare * 5 / 6)
    seen = {(r.query_id, r.doc_id): r.score for r in T.predicted(pairs, T.total_score(t, queries, pairs), docs).collect()}
    assert set(seen) == {(1, 1), (1, 2), (1, 99)} and seen[(1, 99)] == -2.123
    half = {(r.query_id, r.doc_id): r.score for r in T.phrase_score(pairs, queries, t, T.log_icf(counts, terms), half=True).collect()}
    assert math.isclose(half[(1, 1)], rare * 10 / 11)


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "abcx", "abcabcx"), (2, "zzzz", "abczz"), (3, "q", "q")], "doc_id int, title string, body string")
    queries = spark.createDataFrame([(1, "abcabcd")], "query_id int, text string")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "query_id int, doc_id int")
    got = {(r.query_id, r.doc_id): r.tf_idf_3 for r in T.tfidf_pair_score(docs, queries, pairs).collect()}
    # grams of the query: abc x2 (abc, bca, cab, abc); title of 1: abc; bodies: 1 abc bca cab abc, 2 abc bcz
    body = 0.8 * (2 * 2 * math.log(3 / 2) + math.log(3) + math.log(3))
    assert math.isclose(got[(1, 1)], 2 * math.log(3) + body) and math.isclose(got[(1, 2)], 0.8 * 2 * math.log(3 / 2)) and got[(1, 3)] == 0 and (2, 1) not in got
    assert T.tfidf_pair_score(docs, queries, pairs, compat=True).count() == 3


def test_ranking(spark):
    sample = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 4, 1), (2, 5, 2)], "query_id int, url_id int, position int")
    preds = spark.createDataFrame([(1, 1, 0.3), (1, 3, 0.9)], "query_id int, url_id int, score double")
    assert [(r.query_id, r.url_id) for r in L.submission(sample, preds).orderBy("query_id", "rank").collect()] == [(1, 3), (1, 1), (1, 2), (2, 4), (2, 5)]
    assert {r.query_id: round(r.share, 6) for r in L.unscored_share(sample, preds).collect()} == {1: 0.333333, 2: 1.0}
    assert {r.url_id for r in L.unscored_urls(sample, preds).collect()} == {2, 4, 5}
    scored = spark.createDataFrame([(1, 1, 2, 0.1), (1, 2, 0, 0.9), (2, 3, 0, 1.0)], "query_id int, url_id int, mark int, score double")
    assert {r.query_id: round(r.ndcg, 6) for r in L.ndcg(scored).collect()} == {1: round(1 / math.log2(3), 6), 2: 1.0}
    inter = L.interactions(spark.createDataFrame([(2.0, 3.0, 5.0)], "a double, b double, c double"), ["a", "b", "c"], 3)
    assert inter.columns == ["a", "b", "c", "a_b", "a_c", "b_c", "a_b_c"] and tuple(inter.first()) == (2, 3, 5, 6, 10, 15, 30)
    split = L.split_by_query(spark.createDataFrame([(i,) for i in range(10)], "query_id int"))
    assert {r.query_id for r in split.where("validation").collect()} == {8, 9}
    assert L.sample_submission(scored.select("query_id").distinct(), scored, 2).count() == 4
    a, b = (spark.createDataFrame(x, f"url_id int, {n} int") for x, n in (([(1, 5), (2, 6)], "p"), ([(2, 7), (3, 8), (4, 9)], "q")))
    assert L.merge_sources([a, b], ["url_id"]).count() == 4 and L.merge_sources([a, b], ["url_id"], compat=True).count() == 3
    empty = spark.createDataFrame([(1, None), (2, 3)], "url_id int, f int")
    assert L.with_any(empty, ["f"]).count() == 1


@pytest.mark.parametrize("kind", ["boosted", "pairwise"])
def test_rankers_order_by_a_telling_feature(spark, kind):
    rows = [(q, u, int(u > 5), float(u) + q % 2, float((u * 7) % 3)) for q in range(6) for u in range(10)]
    df = spark.createDataFrame(rows, "query_id int, url_id int, mark int, good double, noise double")
    score, importance = L.train_ranker(df, ["good", "noise"], kind=kind, rounds=5)
    assert importance["good"] > importance["noise"]
    assert L.ndcg(score(df)).agg(F.avg("ndcg")).first()[0] > 0.95


def test_files(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("1\tFoo \n2\tfoo\n3\thttp://www.a.com\nbad\tx\n")
    assert {(r.id, r.name) for r in io.read_dictionary(spark, str(tmp_path / "d.tsv"), True).collect()} == {(2, "foo"), (3, "http://www.a.com")}
    assert (1, "Foo ") in {tuple(r) for r in io.read_dictionary(spark, str(tmp_path / "d.tsv"), True, normalise=False).collect()}
    (tmp_path / "p.csv").write_text("QueryId,DocumentId\n1,2\nx,y\n3,4\n")
    assert [tuple(r) for r in io.read_test_pairs(spark, str(tmp_path / "p.csv")).collect()] == [(1, 2, -1), (3, 4, -1)]
    (tmp_path / "stop.txt").write_text("the\nand \n\nthe\n")
    assert io.read_stop_words(spark, str(tmp_path / "stop.txt")) == ["and", "the"]
    rows = spark.createDataFrame([(5, 1, 7, 0.5, None), (6, 0, 7, None, None)], "url_id int, mark int, query_id int, a double, b double")
    lines = io.libsvm_lines(rows, ["a", "b"])
    assert [r.value for r in lines.collect()] == ["5\t1 qid:7 0:0.5", "6\t0 qid:7"]
    assert io.parse_libsvm(lines, ["a", "b"]).collect() == rows.select("url_id", "mark", "query_id", "a", "b").collect()
    assert io.parse_libsvm(spark.createDataFrame([("5\t1 qid:7 0:1 0:2",)], "value string"), ["a"]).count() == 0
    io.write_lines(lines, str(tmp_path / "o"), "bzip2", single=True)
    assert io.read_lines(spark, str(tmp_path / "o")).count() == 2
    io.write_groups({"QD": lines, "URL": lines}, str(tmp_path / "g"))
    assert io.read_lines(spark, str(tmp_path / "g" / "URL")).count() == 2
    ranked = spark.createDataFrame([(2, 1, 9), (1, 2, 8), (1, 1, 7)], "query_id int, rank int, url_id int")
    io.write_submission(ranked, str(tmp_path / "s"))
    assert "".join(p.read_text() for p in (tmp_path / "s").glob("*.csv")) == "QueryId,DocumentId\n1,7\n1,8\n2,9\n"
    both = io.tagged_union(one=ranked, two=rows.select("query_id", "url_id", "mark"))
    assert both.count() == 5 and both.where("source = 'two'").count() == 2
    counted, seen = io.counted(ranked, "n", rows=F.count("*"))
    counted.collect()
    assert seen.get["rows"] == 3


def test_links_with_and_without_scheme(spark):
    html = '<a href="http://a.com/x?y=1&z">A</a> see www.b.org/p, or (WWW.C.net) not xwww.d.org; ftps://e.f/ HTTPS://g.h\nwww.i.j. k.com http://nodot é www.l.m'
    got = spark.createDataFrame([(html,), (None,), ("",), ("www.a.b",)], "html string").select(X.extract_urls(F.col("html"))).collect()
    assert got[0][0] == ["http://a.com/x?y=1&z", "www.b.org/p,", "WWW.C.net)", "ftps://e.f/", "HTTPS://g.h", "www.i.j.", "www.l.m"]
    assert [r[0] for r in got[1:]] == [None, [], ["www.a.b"]]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_the_tables_hold_links(spark):
    from rankloom import plans

    assert plans.QUERIES["page_links"](spark, "/root/testdata/sf0.001").count() > 0
    assert plans.QUERIES["unique_links"](spark, "/root/testdata/sf0.001").count() > 0


def test_grams_of_long_texts_take_time_in_proportion(spark):
    import time

    df = spark.createDataFrame([(" ".join(f"w{i % 997}" for i in range(20_000)),)], "t string")
    began = time.perf_counter()
    for kind in ("plain", "reversed", "gap"):
        assert df.select(F.size(X.word_ngrams(X.tokenize(F.col("t")), 3, kind))).first()[0] == 20_000 - (3 if kind == "gap" else 2)
    assert df.select(F.size(X.char_ngrams_tail(F.col("t"), 5))).first()[0] > 90_000
    assert df.select(X.phrase_count(X.tokenize(F.lit("w5 w6")), X.tokenize(F.col("t")))).first()[0] == 21
    assert time.perf_counter() - began < 15


def test_dictionary_takes_the_last_line_and_feature_names_are_written(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.tsv").write_text("9\tfoo\n8\tbar\n7\tfoo\n")
    (tmp_path / "d" / "b.tsv").write_text("3\tbar\n")
    assert {(r.id, r.name) for r in io.read_dictionary(spark, str(tmp_path / "d"), True).collect()} == {(7, "foo"), (3, "bar")}
    qd = spark.createDataFrame([("q", "u", 1.0, 2.0)], "query string, url string, b double, a double")
    io.write_feature_names({"QD": qd, "URL": qd.drop("query", "b")}, str(tmp_path / "o"))
    assert [r.value for r in io.read_lines(spark, str(tmp_path / "o" / "FeatureNames" / "QD")).collect()] == ["b", "a"]
    assert [r.value for r in io.read_lines(spark, str(tmp_path / "o" / "FeatureNames" / "URL")).collect()] == ["a"]


def test_profiles_of_known_sessions_and_sorted_vocabulary(spark):
    from rankloom.operators import similarity as S

    log = spark.createDataFrame([("a", ["x"], []), ("b", ["x", "y"], ["y"]), ("c", ["z"], ["z"]), ("b", ["w"], [])], "query string, shown array<string>, clicked array<string>")
    queries, urls = spark.createDataFrame([("a",)], "query string"), spark.createDataFrame([("y",)], "url string")
    for compat in (False, True):
        got = {r["query"]: (r.shown, r.clicked) for r in S.known_profiles(log, queries, urls, compat).collect()}
        assert got == {"a": (["x"], []), "b": (["x", "y"], ["y"])}
    words = spark.createDataFrame([("b c",), ("a b",)], "query string")
    assert [r.word for r in S.vocabulary(words).collect()] == ["a", "b", "c"]


def test_only_the_first_of_each_query_are_moved_for_the_metric(spark):
    rows = [(1, u, u % 3, u * 7 % 11) for u in range(20)] + [(2, 1, 0, 5), (3, 1, 2, None), (3, 2, 1, 1)]
    got = L.ndcg(spark.createDataFrame(rows, "query_id int, url_id int, mark int, score int"))
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    gain = lambda marks: sum((2**m - 1) / math.log2(i + 2) for i, m in enumerate(marks[:5]))
    by = sorted((r for r in rows if r[0] == 1), key=lambda r: (-r[3], r[1]))
    best = sorted((r[2] for r in rows if r[0] == 1), reverse=True)
    want = {1: gain([r[2] for r in by]) / gain(best), 2: 1.0, 3: gain([1, 2]) / gain([2, 1])}
    assert {r.query_id: round(r.ndcg, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_grams_of_a_document_are_counted_where_it_is(spark, tmp_path):
    from rankloom.plans import texts

    rows = [(1, "a b a c a b"), (2, "x"), (3, None), (4, "a b c"), (4, "a d c e")]  # one document in two rows: its grams count together
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = texts.word_ngrams_gap(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(1, 4, 3, "a a"), (4, 3, 2, "a c")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "collect_list(text" in plan  # what moves are texts, not their grams


def test_words_are_cut_in_one_pass(spark):
    for text, want in (("A1b2&nbsp;c&NBSP;d", ["a", "1", "b", "2", "c", "d"]), ("&&nbsp;x&nbs&mdash;p;é9", ["x", "nbs", "p", "é", "9"]), ("", []), ("--", []), ("12٣a", ["12٣", "a"])):
        column = X.tokenize(F.lit(text), boundaries=True)
        assert one(spark, column) == want
        assert one(spark, X.tokenize(F.lit(text))) == one(spark, F.filter(F.split(X.clean_text(F.lit(text)), " +"), lambda x: x != ""))
    plan = spark.range(1).select(X.tokenize(F.col("id").cast("string"), boundaries=True))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "regexp_replace" not in plan


def test_a_batch_of_pages_is_inflated_in_short_runs():
    import tracemalloc

    import pyarrow as pa

    pages = ["é" + "x" * 100_000] * 500
    payload = pa.array([zlib.compress(p.encode()) for p in pages] + [None, b"broken"], pa.binary())
    tracemalloc.start()
    got = X._inflate.func(payload)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [*pages, "", ""] and peak < 25_000_000  # all at once as Python objects: over 50 MB
