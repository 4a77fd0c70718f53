"""Click-log features against worked examples."""

import math

import pytest

from rankloom.operators import clicklog as C
from rankloom.operators import similarity as S
from rankloom.sources import io
from rankloom.streaming import running_ctr_counts

LINES = ["Foo Bar@1\thttp://a.com/x,y,b.ru,c.net\tb.ru\t10", "foo bar@2\tb.ru,c.net\tc.net,b.ru\t20,21", "baz@1\tc.net\t\t30"]


@pytest.fixture(scope="module")
def log(spark):
    from pyspark.sql import functions as F

    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    return io.parse_log(lines).coalesce(1).withColumn("sid", F.monotonically_increasing_id())


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "foo bar"), (2, "baz")], "query_id int, query string")


@pytest.fixture(scope="module")
def urls(spark):
    return spark.createDataFrame([(10, "a.com/x,y"), (11, "b.ru"), (12, "c.net")], "url_id int, url string")


def near(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, abs_tol=1e-6))


def test_parse(log):
    rows = log.orderBy("sid").collect()
    assert rows[0].shown == ["a.com/x,y", "b.ru", "c.net"] and rows[0].query == "foo bar" and rows[0].geo == 1
    assert rows[1].clicked == ["c.net", "b.ru"] and rows[1].ts == [20, 21]
    assert rows[2].clicked == [] and rows[2].shown == ["c.net"]


def test_corrupt_lines_and_the_last_at_sign(spark):
    lines = spark.createDataFrame([(x,) for x in ["no tabs", "q\ta.com\ta.com\t1", "q@x\ta.com\t\t1", "a@b@3\ta.com\ta.com\t1", "q@1\ta.com\t\tzz", None]], "value string")
    got = io.parse_log(lines, keep_corrupt=True).collect()
    assert [r._corrupt for r in got] == [True, True, True, False, True, True] and got[3].query == "a@b" and got[3].geo == 3
    assert io.parse_log(lines).count() == 1


def test_log_lines_round_trip(spark, log):
    again = io.parse_log(io.log_lines(log))
    assert sorted(map(str, again.collect())) == sorted(map(str, log.drop("sid").collect()))


def test_pair_features(log, queries, urls):
    want = {
        ("foo bar", "b.ru"): (1.0, 2, 2, 2, 2, 0.954545, 0.954545, 0.911157), ("foo bar", "c.net"): (0.5, 1, 1, 0, 1, 0.916667, 0.083333, 0.076389),
        ("foo bar", "a.com/x,y"): (None, 0, 1, 0, 0, 0.083333, 0.5, 0.041667), ("baz", "c.net"): (None, 0, 0, 0, 0, 0.5, 0.5, 0.25),
    }
    for q, u in ((queries, urls), (None, None)):
        got = {(r.query, r.url): tuple(r)[2:] for r in C.features_qd(log, q, u).collect()}
        assert got.keys() == want.keys() and all(near(a, b) for k in want for a, b in zip(got[k], want[k]))


def test_url_features(log, urls):
    got = {r.url: r for r in C.features_url(log, urls).collect()}
    assert near(got["b.ru"].url_global_ctr, 1.0) and near(got["c.net"].url_global_ctr, 1 / 3) and got["a.com/x,y"].url_global_ctr is None
    assert [got["b.ru"][f"url_rank_ctr_{r}"] for r in (1, 2, 3, 10)] == [1.0, 1.0, 0.0, 0.0]
    assert [got["c.net"][f"url_rank_ctr_{r}"] for r in (1, 2, 10)] == [1.0, 0.0, 0.0]
    assert got["a.com/x,y"].url_rank_ctr_1 is None
    assert [(got[u].click_count, got[u].shows_count, got[u].mean_click_pos, got[u].mean_show_pos) for u in ("b.ru", "c.net", "a.com/x,y")] == [(2, 2, 0.5, 0.5), (1, 3, 1.0, 1.0), (0, 1, None, 0.0)]


def test_query_features(log, queries):
    got = {r.query: tuple(r)[1:] for r in C.features_query(log, queries).collect()}
    assert got == {"foo bar": (1.5, 0.5, 1.0, 0.5), "baz": (0.0, 0.0, 0.0, 0.0)}


def test_filters(spark, log, queries, urls):
    one = queries.where("query = 'baz'")
    assert C.filter_log(log, one).count() == 1 and C.filter_log(log, None, urls.where("url = 'b.ru'")).count() == 2
    assert C.distinct_log(log.unionByName(log)).count() == 3
    pairs = spark.createDataFrame([("baz", "x"), ("no", "b.ru"), ("no", "no")], "query string, url string")
    assert sorted(r.url for r in C.filter_pairs(pairs, one, urls).collect()) == ["b.ru", "x"] and C.filter_pairs(pairs, None, None).count() == 3
    kept = {r.sid: r for r in io.keep_urls(log, urls.where("url <> 'b.ru'")).collect()}
    assert kept[0].shown == ["a.com/x,y", "c.net"] and kept[0].clicked == [] and kept[1].clicked == ["c.net"]


def test_rates_lie_in_the_unit_interval_if_clicks_are_shown(log):
    assert all(0 <= r.ctr <= 1 for g in ("qdoc", "global") for r in C.positive_ctr(log, g).collect())


def test_similarity_agrees_with_all_pairs(spark):
    from itertools import product

    rows = [(f"q{i} word{i % 3}", [f"u{k}" for k in range(i, i + 4)], [f"u{i + 1}"] if i % 4 else []) for i in range(9)]
    p = spark.createDataFrame(rows, "query string, shown array<string>, clicked array<string>")
    every = S.all_pair_distances(p, p).collect()
    links = {(r.query, r.similar): r.dist for r in S.link_distances(p, p).collect()}
    texts = {(r.query, r.similar): r.dist for r in S.text_distances(p, p).collect()}
    assert len(every) == 72 == len([1 for a, b in product(range(9), repeat=2) if a != b])
    for r in every:
        assert near(links.get((r.query, r.similar), 0.0), r.link_dist) and near(texts.get((r.query, r.similar), 0.0), r.text_dist)
    top = S.top_similar(S.text_distances(p, p), k=1).collect()
    assert len(top) == 9 and all(r["rank"] == 1 for r in top)
    zero = spark.createDataFrame([("a", "b", 0.0), ("a", "c", 0.1)], "query string, similar string, dist double")
    assert S.top_similar(zero).count() == 0 and [r.similar for r in S.top_similar(zero, compat=True).collect()] == ["b"]


def test_profiles_index_and_extension(spark, log, queries):
    p = {r.query: r for r in S.profiles(log).collect()}
    assert p["foo bar"].shown == ["a.com/x,y", "b.ru", "c.net"] and p["foo bar"].clicked == ["b.ru", "c.net"] and p["baz"].clicked == []
    twice = spark.createDataFrame([("a a b",)], "query string")
    assert sorted(r.word for r in S.inverted_index(twice).collect()) == ["a", "a", "b"]
    similar = spark.createDataFrame([("baz", "zeta", 0.5), ("baz", "alpha", 0.2), ("baz", "low", 0.05), ("x", "baz", 0.9)], "query string, similar string, dist double")
    assert sorted((r.query_id, r.query) for r in S.extend_dictionary(queries, similar).collect()) == [(1, "foo bar"), (2, "baz"), (3, "alpha"), (4, "zeta")]


def test_streaming_counts(spark, tmp_path, log):
    log.drop("sid").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.drop("sid").schema).parquet(str(tmp_path / "in"))
    q = running_ctr_counts(stream).writeStream.outputMode("complete").format("memory").queryName("ctr").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.query, r.url): (r.clicks, r.shows) for r in spark.table("ctr").collect()}
    assert got[("foo bar", "b.ru")] == (2, 2) and got[("baz", "c.net")] == (0, 1)


def test_known_sessions_are_the_same_however_often_the_log_is_made(spark):
    """Sessions were numbered anew for each test they must pass, and a log that comes in another order had others pass."""
    from pyspark.sql import functions as F

    n = 400
    log = spark.range(n).repartition(7).select(
        F.when(F.col("id") % 2 == 0, "known").otherwise("other").alias("query"), F.array(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("shown"), F.array().cast("array<string>").alias("clicked")
    ).orderBy(F.rand())
    queries, urls = spark.createDataFrame([("known",)], "query string"), spark.range(1, n, 4).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    for _ in range(3):
        got = {r["query"]: r.shown for r in S.known_profiles(log, queries, urls).collect()}
        assert got == {"known": sorted(f"u{i}" for i in range(0, n, 2)), "other": sorted(f"u{i}" for i in range(1, n, 4))}


def test_links_that_two_queries_share_are_counted_without_lists(spark):
    log = spark.createDataFrame([("a", ["x", "y"], ["x"]), ("b", ["x"], ["x"]), ("c", ["x"], []), ("a", [], ["z"]), ("d", None, None)], "query string, shown array<string>, clicked array<string>")
    rows = S.link_rows(log)
    assert sorted((r["query"], r.clicked, r.link) for r in rows.collect()) == [("a", False, "x"), ("a", False, "y"), ("a", True, "x"), ("a", True, "z"), ("b", False, "x"), ("b", True, "x"), ("c", False, "x")]
    dist = S.row_distances(rows, rows)
    assert {(r["query"], r.similar): r.dist for r in dist.collect()} == {("a", "b"): 3.0, ("b", "a"): 3.0}
    plan = dist._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    assert {r["query"]: (r.shown, r.clicked) for r in S.profiles(log).collect()} == {"a": (["x", "y"], ["x", "z"]), "b": (["x"], ["x"]), "c": (["x"], []), "d": ([], [])}


def test_counts_of_pairs_and_sessions_in_one_pass(spark):
    log = spark.createDataFrame([("a", ["x", "y"], ["x", "x"]), ("a", [], ["z"]), ("a", [], []), ("b", None, None), ("b", ["x"], [])], "query string, shown array<string>, clicked array<string>")
    got = {(r["query"], r.url): (r.clicks, r.shows, r.sessions) for r in C.counted_pairs(log).collect()}
    assert got == {("a", "x"): (2, 1, 1), ("a", "y"): (0, 1, 0), ("a", "z"): (1, 0, 1), ("a", None): (0, 0, 1), ("b", None): (0, 0, 1), ("b", "x"): (0, 1, 1)}
