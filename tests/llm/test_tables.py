"""URL filter, top-k search, chat formatting and the pipeline: against brute force and SQL, and for odd input."""

import duckdb
import numpy as np
import pytest

from rankloom.llm import chat, mtree, queries, urls

# URL filter

RULES = [("bad.org", "block"), ("ok.bad.org", "allow"), ("good.com", "allow"), ("good.com/x", "block"), ("good.com/x/y", "allow"), ("tie.net", "allow"), ("tie.net", "block"), ("sub.good.com", "block")]
URLS = [
    "http://bad.org", "https://a.bad.org/q", "http://ok.bad.org/", "http://x.ok.bad.org/p?z=1", "http://good.com/x", "http://good.com/x/yy", "http://good.com//x//y/z#f", "http://tie.net/a",
    "HTTP://USER:pw@Good.COM:8080/x/?q", "http://sub.good.com/x/y", "http://notbad.org", "//bad.org/a", "http://bad.org./", "", None, "no url", "http://", "http:///path", "http://good.comx/x",
    "http://foo..good.com/x", "http://a..b", "http://.b", "http://..", "http://.good.com./x/y", "http://..good.com..", "http://0.1", "http://good.com/0/1", "//1.good.com/1",
]


def brute(rules, url):
    p = urls.parts(url)
    if p is None:
        return None, "block"
    best = None
    for entry, action in rules:
        e = urls.entry_parts(entry)
        if p[0][: len(e[0])] == e[0] and p[1][: len(e[1])] == e[1]:
            best = max(best or (0, -1, "", ""), (len(e[0]), len(e[1]), action, entry))
    return (best[3], best[2]) if best else (None, "allow")


def pages(spark, us):
    return spark.createDataFrame([(i, u, "<html>", "clash", "clash") for i, u in enumerate(us)], "page_id bigint, url string, html string, entry string, decision string")


def test_urls_by_trie_and_by_join(spark):
    df = pages(spark, [*URLS, URLS[0]])
    want = {i: brute(RULES, u) for i, u in enumerate([*URLS, URLS[0]])}
    rules = spark.createDataFrame(RULES, "entry string, action string")
    for given, limit in ((RULES, 100), (RULES, 3), (rules, 100), (rules, 3)):
        got = urls.filter_urls(df, given, limit=limit).collect()
        assert {r.page_id: (r.entry, r.decision) for r in got} == want and len(got) == len(want)
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate([*URLS, URLS[0]])))
    assert {r[0]: (r[2], r[3]) for r in con.execute(urls.sql(RULES)).fetchall()} == want


def test_urls_with_empty_labels_in_rules(spark):
    rules = [("a..b", "block"), ("b", "allow"), (".", "block"), (None, "block"), ("c.", "block"), ("d", "maybe")]
    us = ["http://a..b/x", "http://x.a..b", "http://a.b", "http://.b", "http://c", "http://d", "http://.."]
    want = ["block", "block", "allow", "allow", "block", "allow", "block"]
    for limit in (100, 1):
        assert [r.decision for r in urls.filter_urls(pages(spark, us), rules, limit=limit).orderBy("page_id").collect()] == want


def test_urls_odd(spark):
    df = pages(spark, URLS)
    assert {r.decision for r in urls.filter_urls(df, [], default="block").collect()} == {"block"}
    assert urls.filter_urls(pages(spark, []), RULES).count() == 0
    assert {r.decision for r in urls.filter_urls(df).collect()} == {"allow", "block"}
    long = "http://good.com/" + "/".join(["x"] * 20_000)
    for limit in (100, 3):
        assert urls.filter_urls(pages(spark, [long, "http://" + "a." * 20_000 + "bad.org"]), RULES, limit=limit).orderBy("page_id").first().entry == "good.com/x"


# top-k search


def brute_top(rows, k):
    """By full distance tables, ties by id."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float32).astype(float)
    out = []
    for i, v in zip(ids, x):
        d = np.round(np.sqrt(((x - v) ** 2).sum(1)), 9)
        near = sorted((a, b) for a, b in zip(d, ids) if b != i)[:k]
        out += [(int(i), r + 1, int(b), round(float(np.floor(a * 1e6 + 0.5) / 1e6), 5)) for r, (a, b) in enumerate(near)]
    return sorted(out)


def search(spark, rows, only=None, **kw):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label int, rank int, tree string")
    kw |= {"queries": df.where(only)} if only else {}
    return sorted((r.vec_id, r.rank, r.neighbor, round(r.distance, 5)) for r in mtree.top_k(df, **kw).collect())


@pytest.mark.parametrize("shape", ["clusters", "uniform", "equal"])
def test_top_k_against_brute_force(spark, shape):
    r = np.random.default_rng(4)
    if shape == "clusters":
        x = r.normal(size=(8, 6))[r.integers(0, 8, 400)] * 10 + r.normal(size=(400, 6))
    elif shape == "uniform":
        x = r.normal(size=(300, 12))
    else:
        x = np.repeat(r.normal(size=(3, 4)), 60, axis=0)
    rows = [(int(i), [float(np.float32(e)) for e in v]) for i, v in enumerate(x)]
    assert search(spark, rows, k=5, subtree=64, page=8) == brute_top(rows, 5)


def test_top_k_of_some_queries_among_many_copies_and_ties(spark, monkeypatch):
    r = np.random.default_rng(6)
    x = np.concatenate((np.repeat(r.integers(0, 3, (2, 3)), 150, axis=0), r.integers(0, 3, (300, 3)))).astype(float)  # few places, many ties
    rows = [(int(i), [float(e) for e in v]) for i, v in zip(r.permutation(600), x)] + [(7, [9.0, 9.0, 9.0])]
    want = [w for w in brute_top(rows, 4) if w[0] % 20 == 0]
    monkeypatch.setattr(mtree, "QUERIES_A_TASK", 5)
    assert search(spark, rows, "vec_id % 20 = 0", k=4, subtree=16, page=4) == want and len(want) == 30 * 4
    assert search(spark, rows, "vec_id < 0", k=4) == []


def test_heads_rule_out_only_what_lies_beyond():
    r = np.random.default_rng(7)
    c = r.normal(size=(200, 5)) * r.choice([0.1, 20], (200, 1))
    h = mtree.Heads(np.arange(200), c, r.random(200), page=8)
    x, worst = r.normal(size=(50, 5)) * 10, r.random(50) * 15
    got, done = h.least(x, worst)
    want = np.maximum(mtree.distances(x, h.x) - h.radius, 0)
    assert (np.isinf(got) == (want > worst[:, None] + mtree.SLACK)).all() and np.allclose(got[np.isfinite(got)], want[np.isfinite(got)])
    assert done < 0.9 * 50 * 200 and (np.sort(h.names) == np.arange(200)).all() and np.isfinite(h.least(x, np.full(50, np.inf))[0]).all()


def test_search_passes_over_far_subtrees():
    r = np.random.default_rng(5)
    x = np.concatenate((r.normal(size=(256, 4)), r.normal(size=(256, 4)) + 100))
    trees = [mtree.build(np.arange(256), x[:256], 16), mtree.build(np.arange(256, 512), x[256:], 16)]
    best = mtree.Best(trees[0]["ids"], trees[0]["x"], 3)
    own = best.search(trees[0])
    assert best.search(trees[1]) == 256 and own < 256 * 256  # distances to the other's routing object, and no more
    t = trees[0]
    for lo, hi, c, rad, par in zip(t["bounds"], t["bounds"][1:], t["routing"], t["cover"], t["parent"]):
        assert hi - lo <= 16
        assert np.allclose(np.sqrt(((t["x"][lo:hi] - c) ** 2).sum(1)), t["entry"][lo:hi])
        assert np.isclose(np.sqrt(((t["x"][lo:hi] - c) ** 2).sum(1)).max(), rad) and np.isclose(np.sqrt(((c - t["center"]) ** 2).sum()), par)


def test_top_k_odd(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (None, [5.0, 5.0]), (4, None), (5, []), (6, [1.0]), (7, [float("nan"), 0.0]), (8, [None, 1.0]), (9, [float("inf"), 1.0])]
    assert search(spark, rows, k=10) == brute_top([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], 10)
    assert search(spark, []) == [] and search(spark, [(4, None)]) == [] and search(spark, [(1, [1.0])]) == []


# chat formatting

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hello"), (1, 2, "assistant", "hi"), (1, 3, "user", "bye"), (1, 4, "assistant", ""),
    (2, 0, "user", "hello"), (3, 0, "assistant", "hi"), (4, 0, "user", "a"), (4, 1, "user", "b"), (4, 2, "assistant", "c"), (5, 0, "user", "a"), (5, 1, "assistant", None),
    (6, 0, "user", "a"), (6, 0, "user", "a"), (6, 1, " Assistant ", "b" * 50_000), (7, 0, "user", "a"), (7, 0, "user", "other"), (7, 1, "assistant", "b"), (8, None, "user", "a"), (9, 0, None, "a"),
    (10, 0, "user", "u"), (10, 1, "assistant", "call"), (10, 2, "tool", "result"), (10, 3, "assistant", "done"), (11, 0, "system", "only"), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (12, 5, "assistant", "late"), (12, 2, "user", "early"),
]


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, seg string, loss int")


def test_chat_against_sql(spark):
    got = sorted(map(str, (tuple(r) for r in chat.segments(turns(spark, TURNS)).collect())))
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", TURNS)
    assert got == sorted(map(str, con.execute(chat.SQL).fetchall()))


@pytest.mark.parametrize("hot", [0, 1, 2, 4])
def test_long_conversations_are_spread_with_the_same_rows(spark, hot):
    r = np.random.default_rng(2)
    rows = [*TURNS, (20, 5, "user", "x")]
    for i in range(30, 50):  # walks of the machine, some of them broken
        role, at = "user", 0
        for _ in range(int(r.integers(1, 12))):
            rows.append((i, at, role if r.random() > 0.05 else "tool", f"{i} {at}"))
            at += int(r.random() > 0.03)
            role = "assistant" if role in ("user", "tool") else ["user", "tool"][int(r.integers(0, 2))]
    df = turns(spark, rows)
    plain = sorted(map(str, chat.segments(df).collect()))
    assert sorted(map(str, chat.segments(df, hot=hot).collect())) == plain and len(plain) > 100
    assert chat.segments(df.limit(0), hot=hot).count() == 0


def test_chat_of_very_many_turns(spark):
    import time

    df = spark.range(100_000).selectExpr("if(id % 2 = 0, 7, null) as conv_id", "id as turn", "if((id div 2) % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    df = df.unionByName(df)  # every row twice
    began = time.perf_counter()
    for hot in (chat.HOT * 2, 20_000):
        got = chat.segments(df, hot=hot).groupBy("conv_id").agg({"seg": "max", "*": "count"}).collect()
        assert {(r[0], r[1], r[2]) for r in got} == {(7, 150_001, 150_002), (None, 150_001, 150_002)}
    assert time.perf_counter() - began < 60


def test_chat_text_and_reasons(spark):
    df = turns(spark, TURNS)
    reasons = {r.conv_id: r.reason for r in chat.conversations(df).collect()}
    assert reasons == {1: None, 2: "order", 3: "order", 4: "order", 5: "null turn", 6: None, 7: "repeated turn", 8: "null turn", 9: "null turn", 10: None, 11: "order", 12: None, None: None}
    rows = [r for r in chat.segments(df).orderBy("seg").collect() if r.conv_id == 1]
    assert "".join(r.text for r in rows) == "<|begin|><|system|>\nbe kind<|end|>\n<|user|>\nhello<|end|>\n<|assistant|>\nhi<|end|>\n<|user|>\nbye<|end|>\n<|assistant|>\n<|end|>\n<|stop|>"
    assert "".join(r.text for r in rows if r.loss) == "hi<|end|>\n<|end|>\n<|stop|>"
    short = chat.Template(start="[", end="]", opening="", closing="", loss=())
    assert not any(r.loss for r in chat.segments(df, template=short).collect())
    assert chat.segments(turns(spark, [])).count() == 0


# pipeline


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    from tests.llm.test_documents import ODD, docs, prose

    words = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    rows = [(i, f"{prose(g, 80, i)} {words(i)}", g) for i, g in enumerate(["en", "de"] * 30)]
    rows += [(100 + i, rows[i][1].replace(f"w{i}x3 ", ""), rows[i][2]) for i in range(10)]
    rows += [(200 + i, " ".join(["Der!! | ###"] * (10 + i)), "de") for i in range(20)]
    rows += [(300, prose("en", 80, 900) + " mail a.b@c.example.com " + words(900), "en"), *ODD]
    d = tmp_path_factory.mktemp("corpus")
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    marks = [(i, 1, 0) for i in range(0, 60, 2)] + [(200 + i, 0, 0) for i in range(0, 20, 2)]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_pipeline_stage_by_stage(spark, corpus_dir):
    import corpus_pipeline as P
    from rankloom.llm import langid, packing, pii, quality, simhash

    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    seen = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, corpus_dir)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    enc = langid.encoders(langid.fit(spark.read.parquet(f"{corpus_dir}/documents.parquet")))
    assert set(seen["language ID"]) == {r.doc_id for r in rows if langid.verdict(r.text, enc)[3]}
    good = set(seen["quality rules"])
    assert set(range(60)) <= good and not good & set(range(200, 220))
    one = set(seen["SimHash near-dedup"])
    assert set(range(60)) <= one and not one & set(range(100, 110))
    assert set(seen["PII"]) == one and "a.b@c" not in seen["PII"][300] and "<EMAIL>" in seen["PII"][300]
    last = P.run(spark, corpus_dir).collect()
    assert {r.doc_id for r in last} == one and len(last) == len(seen["PII"])
    assert {r.doc_id: r.n_tokens for r in last} == {i: len(t.split()) for i, t in seen["PII"].items()}
    assert [n for n, _ in P.STAGES] == ["language ID", "quality rules", "SimHash near-dedup", "PII", "packing"] and packing and pii and quality and simhash


def test_pipeline_odd(spark, tmp_path):
    """Empty tables; repeated rows, nulls and a clashing column through every stage; nothing left in the shared folder."""
    import os

    import corpus_pipeline as P
    from tests.llm.test_documents import ODD, SCHEMA, clashing, docs, prose

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert P.run(spark, f"{tmp_path}/none").collect() == []
    rows = [(1000 + i, f"{prose(g, 80, i)} " + " ".join(f"w{i}x{k}" for k in range(40)), g) for i, g in enumerate(["en", "de"] * 10)]
    rows += [rows[3], rows[3], (None, rows[4][1], "en"), *ODD]
    d = clashing(docs(spark, rows))
    d.write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([(1000, 1, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/odd/labels.parquet")
    for _, stage in P.STAGES[:-1]:
        after = stage(spark, d, f"{tmp_path}/odd")
        assert after.columns == d.columns
        d = after
    got = sorted(r.doc_id for r in P.run(spark, f"{tmp_path}/odd").collect() if r.doc_id is None or r.doc_id >= 1000)
    assert got == list(range(1000, 1020)) and sorted(r.doc_id for r in d.select("doc_id").collect() if r.doc_id >= 1000) == got
    shared = P.ensure_checkpoint_dir(spark).removeprefix("file:")
    assert not [x for x in os.listdir(shared) if x.startswith("pipeline-")]


def test_pipeline_keeps_no_two_texts_within_the_radius(spark, tmp_path):
    """Its near-duplicate stage against all pairs of fingerprints; what the whole pipeline keeps is a part of that."""
    import corpus_pipeline as P
    from tests.llm.test_documents import brute_groups, docs, near_texts

    rows, fps = near_texts()
    d = docs(spark, [(i, t, "en") for i, t in rows])
    label, near = brute_groups(fps)
    assert len(near) > 150
    assert sorted(r.doc_id for r in P.near_dedup(spark, d, "").collect()) == sorted(set(label.tolist()))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in P.run(spark, str(tmp_path)).collect()}
    assert len(kept) > 400 and not [1 for i, j in near.tolist() if i in kept and j in kept]


def test_all_ten_are_registered():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.ORACLES) <= set(names)
