"""Features from the click log (sid, query, geo, shown, clicked, ts): one row is a session, shown in order of rank and clicked
in order of clicks. Dictionaries are DataFrames (query) and (url), or None for no restriction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.sources.io import keep_urls

RANKS = 10
URL_FEATURES = ["url_global_ctr", *[f"url_rank_ctr_{r}" for r in range(1, RANKS + 1)], "click_count", "shows_count", "mean_click_pos", "mean_show_pos"]
QD_FEATURES = ["qdoc_ctr", "a_n", "a_d", "s_n", "s_d", "a_u", "s_u", "r_u"]
QUERY_FEATURES = ["mean_click", "mean_show_click", "mean_first_pos", "mean_last_pos"]


def _known(rows: DataFrame, dictionary: DataFrame | None, key: str) -> DataFrame:
    return rows if dictionary is None else rows.join(dictionary.select(key).distinct(), key, "left_semi")


def filter_log(log: DataFrame, queries: DataFrame | None = None, urls: DataFrame | None = None) -> DataFrame:
    """Sessions of a known query (if given) and with a known URL in shown or clicked (if given)."""
    log = _known(log, queries, "query")
    if urls is None:
        return log
    found = log.select("sid", F.explode(F.concat("shown", "clicked")).alias("url"))
    return log.join(_known(found, urls, "url").select("sid").distinct(), "sid", "left_semi")


def distinct_log(log: DataFrame) -> DataFrame:
    return log.drop("sid").dropDuplicates()


def filter_pairs(pairs: DataFrame, queries: DataFrame | None, urls: DataFrame | None) -> DataFrame:
    """Feature pairs of a known query or a known URL; without dictionaries, all."""
    if queries is None and urls is None:
        return pairs
    marked, test = pairs, F.lit(False)
    for d, key in ((queries, "query"), (urls, "url")):
        if d is not None:
            marked = marked.join(d.select(key).distinct().withColumn(f"__{key}", F.lit(True)), key, "left")
            test = test | F.col(f"__{key}").isNotNull()
    return marked.where(test).select(*pairs.columns)


def entries(log: DataFrame) -> DataFrame:
    """(query, url, pos, clicked) of every list entry; pos counts from 0 in its own list. One pass over the log."""
    tag = lambda c, k: F.transform(c, lambda u, i: F.struct(u.alias("url"), i.alias("pos"), F.lit(k).alias("clicked")))
    return log.select("query", F.explode(F.concat(tag("shown", False), tag("clicked", True))).alias("e")).select("query", "e.*")


def rate(clicks: Column, shows: Column) -> Column:
    """Null where there is no click or no show."""
    return F.when(clicks > 0, F.try_divide(clicks, shows))


def _totals() -> list[Column]:
    return [F.count_if(F.col("clicked")).alias("clicks"), F.count_if(~F.col("clicked")).alias("shows")]


def ctr_counts(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(*_totals())


def counted_pairs(log: DataFrame) -> DataFrame:
    """(query, url, clicks, shows, sessions): the log's pairs with their counts, and a row without URL for a query whose sessions
    list none. A session counts at its first entry, so a query's sum is its number of sessions. The rows lie by URL."""
    tag = lambda c, k: F.coalesce(F.transform(c, lambda u: F.struct(u.alias("url"), F.lit(k).alias("clicked"))), F.array().cast("array<struct<url:string,clicked:boolean>>"))
    every = F.transform(F.concat(tag("shown", False), tag("clicked", True)), lambda x, i: F.struct(x["url"].alias("url"), x["clicked"].alias("clicked"), (i == 0).alias("first")))
    rows = log.select("query", F.explode_outer(every).alias("e")).select("query", "e.*").repartition("url")
    return rows.groupBy("query", "url").agg(*_totals(), F.count_if(F.coalesce("first", F.lit(True))).alias("sessions"))


def qdoc_ctr(log: DataFrame, queries: DataFrame | None = None, urls: DataFrame | None = None) -> DataFrame:
    """(query, url, clicks, shows, qdoc_ctr) with multiplicity; the rate is null without clicks or shows."""
    return ctr_counts(_known(entries(_known(log, queries, "query")), urls, "url"), "query", "url").withColumn("qdoc_ctr", rate(F.col("clicks"), F.col("shows")))


def positive_ctr(log: DataFrame, grain: str = "qdoc", queries: DataFrame | None = None, urls: DataFrame | None = None) -> DataFrame:
    """The stand-alone rates, keys with clicks only. grain: qdoc (query, url, ctr), global (url, ctr), or rank (url, rank, ctr)
    for ranks with both clicks and shows, ranks unbounded."""
    if grain == "qdoc":
        return qdoc_ctr(log, queries, urls).where("qdoc_ctr is not null").select("query", "url", F.col("qdoc_ctr").alias("ctr"))
    rows = _known(entries(log), urls, "url").withColumn("rank", F.col("pos") + 1)
    key = ["url"] if grain == "global" else ["url", "rank"]
    return ctr_counts(rows, *key).select(*key, rate(F.col("clicks"), F.col("shows")).alias("ctr")).where("ctr is not null")


def url_ctr(log: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """(url, url_global_ctr, url_rank_ctr_1..10): over all queries. A click's rank is its place in the order of clicks; ranks
    past the tenth count in the last. A rank's rate is 0 without shows; if all ten are 0, all are null."""
    last = F.least(F.col("pos"), F.lit(RANKS - 1))
    at = lambda r, k: F.count_if((last == r) & (F.col("clicked") == k))
    c = _known(entries(log), urls, "url").groupBy("url").agg(*_totals(), *[at(r, k).alias(f"{'c' if k else 's'}{r}") for r in range(RANKS) for k in (True, False)])
    rates = [F.coalesce(F.try_divide(F.col(f"c{r}"), F.col(f"s{r}")), F.lit(0.0)) for r in range(RANKS)]
    some = F.greatest(*rates) > 0
    return c.select("url", rate(F.col("clicks"), F.col("shows")).alias("url_global_ctr"), *[F.when(some, x).alias(f"url_rank_ctr_{r + 1}") for r, x in enumerate(rates)])


def click_model_counters(log: DataFrame, queries: DataFrame | None = None, urls: DataFrame | None = None) -> DataFrame:
    """(query, url, a_n, a_d, s_n, s_d) of the click model, from sessions that still have a click once only known URLs count.

    s_n: the session's last click. a_d: each shown entry down to the first place of the last shown URL that was clicked (all
    shown if none was). a_n and s_d: every click.
    """
    log = _known(log, queries, "query")
    log = (log if urls is None else keep_urls(log, urls)).where(F.size("clicked") > 0)
    hit = F.filter("shown", lambda u: F.array_contains("clicked", u))
    cut = F.array_position("shown", F.try_element_at(hit, F.lit(-1)))
    seen = F.slice("shown", F.lit(1), F.coalesce(cut, F.size("shown")).cast("int"))
    tag = lambda c, a, d, s, t: F.transform(c, lambda u: F.struct(u.alias("url"), F.lit(a).alias("a_n"), F.lit(d).alias("a_d"), F.lit(s).alias("s_n"), F.lit(t).alias("s_d")))
    rows = log.select("query", F.explode(F.concat(tag("clicked", 1, 0, 0, 1), tag(seen, 0, 1, 0, 0), tag(F.slice("clicked", -1, 1), 0, 0, 1, 0))).alias("e")).select("query", "e.*")
    return rows.groupBy("query", "url").agg(*[F.sum(c).alias(c) for c in ("a_n", "a_d", "s_n", "s_d")])


def click_model(counters: DataFrame) -> DataFrame:
    """Counters with a_u (attraction), s_u (satisfaction) and r_u, their product; smoothed by .1 and .2. Null counters are 0."""
    zero = counters.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("a_n", "a_d", "s_n", "s_d")})
    a, s = ((F.col(f"{k}_n") + 0.1) / (F.col(f"{k}_d") + 0.2) for k in "as")
    return zero.withColumns({"a_u": a, "s_u": s, "r_u": a * s})


def query_features(log: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query, mean_click, mean_show_click, mean_first_pos, mean_last_pos), each a sum over all the query's sessions: clicks;
    clicks div shows in whole numbers; 0-based place of the first and of the last click among the shown (0 if not shown)."""
    place = lambda c: F.greatest(F.coalesce(F.array_position("shown", c), F.lit(0)) - 1, F.lit(0))
    n = F.count("*")
    whole = F.coalesce(F.floor(F.try_divide(F.size("clicked"), F.size("shown"))), F.lit(0))
    first, last = (place(F.try_element_at("clicked", F.lit(i))) for i in (1, -1))
    return _known(log, queries, "query").groupBy("query").agg(
        (F.sum(F.size("clicked")) / n).alias("mean_click"), (F.sum(whole) / n).alias("mean_show_click"), (F.sum(first) / n).alias("mean_first_pos"), (F.sum(last) / n).alias("mean_last_pos")
    )


def url_positions(log: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """(url, click_count, shows_count, mean_click_pos, mean_show_pos). Places count known URLs only, from 0; a shown entry
    counts towards the click place if its URL is among the session's clicks. Means are null without clicks, or shows."""
    log = log if urls is None else keep_urls(log, urls)
    none = F.lit(None).cast("int")
    row = lambda u, show, click, pos, at: F.struct(u.alias("url"), F.lit(show).alias("s"), F.lit(click).alias("c"), pos.alias("p"), at.alias("at"))
    shown = F.transform("shown", lambda u, i: row(u, 1, 0, i, F.when(F.array_contains("clicked", u), i)))
    rows = log.select(F.explode(F.concat(shown, F.transform("clicked", lambda u: row(u, 0, 1, none, none)))).alias("e")).select("e.*")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy("url").agg(F.sum("c").alias("click_count"), F.sum("s").alias("shows_count"), F.try_divide(total("at"), F.sum("c")).alias("mean_click_pos"), F.try_divide(total("p"), F.sum("s")).alias("mean_show_pos"))


def features_qd(log: DataFrame, queries: DataFrame | None = None, urls: DataFrame | None = None) -> DataFrame:
    """(query, url, QD_FEATURES): all pairs that any session of a known query lists; pairs without model data get the priors.
    Both sides are aggregated on (query, url), so the outer join needs no shuffle of its own."""
    ctr = qdoc_ctr(log, queries, urls).select("query", "url", "qdoc_ctr")
    return click_model(ctr.join(click_model_counters(log, queries, urls), ["query", "url"], "full")).select("query", "url", *QD_FEATURES)


def features_url(log: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """(url, URL_FEATURES)."""
    return url_ctr(log, urls).join(url_positions(log, urls), "url", "full").select("url", *URL_FEATURES)


def features_query(log: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    return query_features(log, queries).select("query", *QUERY_FEATURES)
