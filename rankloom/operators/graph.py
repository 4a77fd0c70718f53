"""The link graph: links of pages, adjacency, PageRank, HITS. A graph is a DataFrame of edges (src, dst)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators.lineage import cut_lineage
from rankloom.operators.similarity import number_on

ASSETS = r"(?i)\.(?:js|css|png|jpe?g|gif|ico|svg|webp|bmp|pdf|docx?|xlsx?|zip|rar|gz|mp3|mp4|avi|swf|xml|rss)(?:[?#].*)?$"


def page_links(pages: DataFrame) -> DataFrame:
    """(doc_id, url) of every absolute link of pages (doc_id, html), repeats kept."""
    return pages.select("doc_id", F.explode(X.extract_urls(F.col("html"))).alias("url"))


def site_links(links: DataFrame, site: str, drop_assets: bool = True) -> DataFrame:
    """Links whose host contains the site's name, without those to files that are no pages."""
    kept = links.where(F.contains(X.domain(F.col("url")), F.lit(site)))
    return kept.where(~F.col("url").rlike(ASSETS)) if drop_assets else kept


def unique_links(links: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(url_id, url): known links with their ids, new ones numbered after the largest in order of URL."""
    found = links.select("url").distinct()
    known = dictionary.join(found, "url", "left_semi").select("url_id", "url")
    new = found.join(dictionary, "url", "left_anti")
    return number_on(dictionary, new, "url_id", "url").join(known.select("url").unionByName(new), "url", "left_semi")


def link_edges(links: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(src, dst) in ids: links of pages to known URLs, repeats kept."""
    return links.join(dictionary, "url").select(F.col("doc_id").alias("src"), F.col("url_id").alias("dst"))


def link_edges_by_url(links: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(src, dst) in URLs: a page is its own URL; pages without one are dropped."""
    own = dictionary.select(F.col("url_id").alias("doc_id"), F.col("url").alias("src"))
    return links.select("doc_id", F.col("url").alias("dst")).join(own, "doc_id").select("src", "dst")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in) of every node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def graph_counters(edges: DataFrame) -> DataFrame:
    """One row (n_nodes, end_nodes, no_in_nodes, isolated_nodes); isolated: no link but to itself."""
    own = degrees(edges.where("src <> dst"))
    d = degrees(edges).join(own.select("id", F.lit(1).alias("k")), "id", "left")
    return d.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("n_out") == 0).alias("end_nodes"), F.count_if(F.col("n_in") == 0).alias("no_in_nodes"), F.count_if(F.col("k").isNull()).alias("isolated_nodes"))


def adjacency_lines(edges: DataFrame) -> DataFrame:
    """'node TAB n_out TAB out... TAB n_in TAB in...' of every node, lists sorted."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("o"))
    in_ = edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("src")).alias("i"))
    none = F.array().cast("array<string>")
    j = out.join(in_, "id", "full").select("id", F.coalesce("o", none).alias("o"), F.coalesce("i", none).alias("i"))
    return j.select(F.concat_ws("\t", F.col("id"), F.size("o"), "o", F.size("i"), "i").alias("value"))


def page_rank(edges: DataFrame, alpha: float = 0.1, iterations: int = 10, dangling: bool = True, n: int | None = None, start: float | None = None, stop_share: float | None = None, stop_delta: float = 1e-4, compat: bool = False, every: int = 5, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """(id, pr) after at most `iterations` rounds of pr(v) = alpha/n + (1-alpha) * (sum of pr(u)/outdegree(u) + dangling/n).

    n: number of nodes, counted if not given. start: 1/n if dangling, else 0. dangling: the mass of nodes without links is
    spread over all; compat loses it in the first round. stop_share: end when more than this share of nodes moved by less
    than stop_delta. Repeated edges count each. The ranks' lineage is cut every few rounds.
    """
    edges = cut(edges.select("src", "dst").repartition(_parts(edges), "src"))  # shuffled once; every round reads it where it lies
    degree = cut(degrees(edges).select("id", "n_out"))
    n = degree.count() if n is None else n
    if n == 0:
        return degree.select("id", F.lit(0.0).alias("pr"))
    start = (1.0 / n if dangling else 0.0) if start is None else start
    ranks = degree.select("id", "n_out", F.lit(start).alias("pr"))
    for k in range(iterations):
        sent = edges.join(ranks, edges["src"] == ranks["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pr") / F.col("n_out")).alias("got"))
        got = F.coalesce("got", F.lit(0.0))
        old = ranks.withColumnRenamed("pr", "old").join(sent, "id", "left")
        if dangling and not (compat and k == 0):
            lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("n_out") == 0, F.col("pr"))), F.lit(0.0)).alias("lost"))
            old, got = old.crossJoin(F.broadcast(lost)), got + F.col("lost") / n  # one row
        new = old.select("id", "n_out", "old", (alpha / n + (1 - alpha) * got).alias("pr"))
        if stop_share is not None:
            new = cut(new)
            still = new.agg(F.count_if(F.abs(F.col("pr") - F.col("old")) < stop_delta)).first()[0]
            ranks = new.drop("old")
            if still > stop_share * n:
                break
        else:
            ranks = new.drop("old")
            if (k + 1) % every == 0 and k + 1 < iterations:
                ranks = cut(ranks)
    return ranks.select("id", "pr")


def hits(edges: DataFrame, iterations: int = 3, compat: bool = False, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """(id, a, h): authority is the sum of the hub values that link here, hub the sum of the authorities linked to, both of the
    round before; start 1, not normalised. Repeated edges count each. compat: both are sums over what a node links to, and
    all links turn round after every round."""
    # one copy by each end, shuffled once; every round reads them where they lie
    edges, by_dst = (cut(edges.select("src", "dst").repartition(_parts(edges), end)) for end in ("src", "dst"))
    scores = nodes(edges).select("id", F.lit(1.0).alias("a"), F.lit(1.0).alias("h"))
    for k in range(iterations):
        if k and k % 3 == 0:
            scores = cut(scores)
        if compat:
            here, there = ("src", "dst") if k % 2 == 0 else ("dst", "src")
            own = edges if there == "src" else by_dst
            sums = own.join(scores, own[there] == scores["id"]).groupBy(F.col(here).alias("id")).agg(F.sum("h").alias("na"), F.sum("a").alias("nh"))
            scores = scores.select("id").join(sums, "id", "left").select("id", F.coalesce("na", F.lit(0.0)).alias("a"), F.coalesce("nh", F.lit(0.0)).alias("h"))
            continue
        a = edges.join(scores, edges["src"] == scores["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum("h").alias("na"))
        h = by_dst.join(scores, by_dst["dst"] == scores["id"]).groupBy(F.col("src").alias("id")).agg(F.sum("a").alias("nh"))
        scores = scores.select("id").join(a, "id", "left").join(h, "id", "left").select("id", F.coalesce("na", F.lit(0.0)).alias("a"), F.coalesce("nh", F.lit(0.0)).alias("h"))
    return scores


def sorted_by(scores: DataFrame, column: str) -> DataFrame:
    """In descending order of a score over the whole graph, ties by id."""
    return scores.orderBy(F.desc(column), "id")
