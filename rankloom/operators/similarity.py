"""Similar queries by shared links or words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators.lineage import cut_lineage

TOP = 20
THRESHOLD = 0.1


def link_rows(log: DataFrame) -> DataFrame:
    """(query, clicked, link): every link shown (clicked: false) and clicked (true) for a query, once. They lie by link, so that what
    joins them on (clicked, link) moves none of them again."""
    return _link_rows(log).where("link is not null")


def _link_rows(log: DataFrame) -> DataFrame:
    """link_rows, and a row without link for each query that has a session without links."""
    tag = lambda c, k: F.coalesce(F.transform(c, lambda u: F.struct(F.lit(k).alias("clicked"), u.alias("link"))), F.array().cast("array<struct<clicked:boolean,link:string>>"))
    rows = log.select("query", F.explode_outer(F.concat(tag("shown", False), tag("clicked", True))).alias("e")).select("query", "e.clicked", "e.link")
    return rows.repartition("clicked", "link").distinct()


def profiles(log: DataFrame) -> DataFrame:
    """(query, shown, clicked): sorted sets of all links shown, and clicked, for a query. A set is one value, and so as large as it
    is; link_rows has the same as rows."""
    some = lambda kind: F.array_sort(F.collect_list(F.when(kind, F.col("link"))))
    return _link_rows(log).groupBy("query").agg(some(~F.col("clicked")).alias("shown"), some(F.col("clicked")).alias("clicked"))


def known_sessions(log: DataFrame, queries: DataFrame, urls: DataFrame, compat: bool = False) -> DataFrame:
    """What the combiner lets pass: sessions of a known query (query), or that show a known URL (url), once each. compat: a session
    for which both hold comes twice. The sessions are numbered in a kept copy: made anew, they could come in another order."""
    log = cut_lineage(log.withColumn("__row", F.monotonically_increasing_id()))
    by_query = log.join(queries.select("query").distinct(), "query", "left_semi")
    rest = log if compat else log.join(queries.select("query").distinct(), "query", "left_anti")
    shown = rest.select("__row", F.explode("shown").alias("url")).join(urls.select("url").distinct(), "url", "left_semi").select("__row").distinct()
    return by_query.unionByName(rest.join(shown, "__row", "left_semi")).drop("__row")


def known_profiles(log: DataFrame, queries: DataFrame, urls: DataFrame, compat: bool = False) -> DataFrame:
    """profiles() of the known sessions. compat makes no difference to sets of links."""
    return profiles(known_sessions(log, queries, urls, compat))


def split_profiles(all_profiles: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles of known queries, all profiles)."""
    return all_profiles.join(queries.select("query").distinct(), "query", "left_semi"), all_profiles


def inverted_index(all_profiles: DataFrame, unicode: bool = True) -> DataFrame:
    """(word, query), a row for each occurrence of a word in a query."""
    return all_profiles.select(F.explode(X.words(F.col("query"), unicode)).alias("word"), "query")


def link_index(all_profiles: DataFrame, kind: str) -> DataFrame:
    """(link, query) over the shown or the clicked links."""
    return all_profiles.select(F.explode(kind).alias("link"), "query")


def vocabulary(queries: DataFrame, unicode: bool = True) -> DataFrame:
    """Distinct words, sorted."""
    return queries.select(F.explode(X.words(F.col("query"), unicode)).alias("word")).distinct().orderBy("word")


def similar_candidates(all_profiles: DataFrame, urls: DataFrame, words: DataFrame, url_share: float = 0.4, word_share: float = 1 / 3, unicode: bool = True) -> DataFrame:
    """Profiles of which at least url_share of the clicked links and word_share of the words are known."""
    share = lambda rows, known, key: rows.join(known.select(key).distinct().withColumn("k", F.lit(1)), key, "left").groupBy("query").agg((F.count("k") / F.count("*")).alias(f"share_{key}"))
    by_url = share(all_profiles.select("query", F.explode("clicked").alias("url")), urls, "url").where(F.col("share_url") >= url_share)
    by_word = share(inverted_index(all_profiles, unicode), words, "word").where(F.col("share_word") >= word_share)
    return all_profiles.join(by_url, "query", "left_semi").join(by_word, "query", "left_semi")


def _overlaps(left: DataFrame, right: DataFrame, key: Column, weight: Column) -> DataFrame:
    """(query, similar, sum of weight) over pairs that share a key: one equi-join instead of all pairs."""
    a, b = left.select("query", F.explode(key).alias("k"), weight.alias("w")), right.select(F.col("query").alias("similar"), F.explode(key).alias("k"))
    return a.join(b, "k").where("query <> similar").groupBy("query", "similar").agg(F.sum("w").alias("w"))


def link_distances(known: DataFrame, other: DataFrame, shown_weight: float = 1.0, clicked_weight: float = 5.0) -> DataFrame:
    """(query, similar, dist): weighted overlap of shown and clicked links for pairs that share a link and have no empty list."""
    rows = lambda p: p.select("query", F.explode(F.concat(*[F.transform(F.array_distinct(c), lambda x: F.struct(F.lit(k).alias("clicked"), x.alias("link"))) for c, k in (("shown", False), ("clicked", True))])).alias("e")).select("query", "e.*")
    return row_distances(rows(known), rows(other), shown_weight, clicked_weight)


def row_distances(known: DataFrame, other: DataFrame, shown_weight: float = 1.0, clicked_weight: float = 5.0) -> DataFrame:
    """link_distances of link_rows. Rows that share a link are only counted, a pair of queries at a time; sizes join the counts."""
    count = lambda k, name: F.count_if(F.col("clicked") == k).alias(name)
    sizes = lambda rows, q, s, c: rows.groupBy(F.col("query").alias(q)).agg(count(False, s), count(True, c)).where((F.col(s) > 0) & (F.col(c) > 0))
    shared = known.join(other.withColumnRenamed("query", "similar"), ["clicked", "link"]).where("query <> similar").groupBy("query", "similar").agg(count(False, "n"), count(True, "m"))
    both = shared.join(sizes(known, "query", "s", "c"), "query").join(sizes(other, "similar", "s2", "c2"), "similar")
    dist = shown_weight * F.col("n") / (F.col("s") * F.col("s2")) + clicked_weight * F.col("m") / (F.col("c") * F.col("c2"))
    return both.select("query", "similar", dist.alias("dist"))


def text_distances(known: DataFrame, other: DataFrame, unicode: bool = True) -> DataFrame:
    """(query, similar, dist): common distinct words over the product of the word counts."""
    w = X.words(F.col("query"), unicode)
    a = known.select("query", F.size(w).alias("n"), F.explode(F.array_distinct(w)).alias("word"))
    b = other.select(F.col("query").alias("similar"), F.size(w).alias("n2"), F.explode(F.array_distinct(w)).alias("word"))
    return a.join(b, "word").where("query <> similar").groupBy("query", "similar").agg((F.count("*") / (F.first("n") * F.first("n2"))).alias("dist"))


def all_pair_distances(known: DataFrame, other: DataFrame, unicode: bool = True) -> DataFrame:
    """(query, similar, link_dist, text_dist) of all pairs, zeros too: a check on small data, quadratic by nature."""
    o = other.select(F.col("query").alias("similar"), F.col("shown").alias("s2"), F.col("clicked").alias("c2"))
    pairs = known.crossJoin(o).where("query <> similar")
    return pairs.select("query", "similar", X.link_similarity(F.col("shown"), F.col("clicked"), F.col("s2"), F.col("c2")).alias("link_dist"), X.text_similarity(F.col("query"), F.col("similar"), unicode).alias("text_dist"))


def top_similar(distances: DataFrame, k: int = TOP, threshold: float | None = THRESHOLD, compat: bool = False) -> DataFrame:
    """(query, rank, similar, dist): the k of greatest value a query, ties by name, above the threshold. compat: only values
    within 0.001 of it are dropped."""
    if threshold is not None:
        distances = distances.where(F.abs(F.col("dist") - threshold) > 0.001 if compat else F.col("dist") > threshold)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("dist"), "similar"))
    return distances.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "similar", "dist")


def extend_dictionary(queries: DataFrame, similar: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, query): the dictionary and every similar query above the threshold that it lacks, numbered on in order."""
    new = similar.where(F.col("dist") > threshold).select(F.col("similar").alias("query")).distinct().join(queries, "query", "left_anti")
    return number_on(queries, new, "query_id", "query")


def number_on(known: DataFrame, new: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """known and new names, these with the ids after the largest, in order of name.

    Names are sorted by range, numbered inside each range, and moved on by the sizes of the ranges before: no task sees all.
    The ranges are kept, as sampling again could draw them elsewhere.
    """
    spark = known.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut_lineage(new.select(name_col).repartitionByRange(parts, name_col).withColumn("__part", F.spark_partition_id()))
    bounds = ranged.groupBy("__part").agg(F.count("*").alias("n"), F.min(name_col).alias("__lo"))
    before = Window.orderBy("__lo").rowsBetween(Window.unboundedPreceding, -1)
    starts = bounds.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(name_col))
    top = known.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    numbered = ranged.withColumn("__n", inside).join(starts, "__part").crossJoin(top)
    kind = known.schema[id_col].dataType
    return known.select(id_col, name_col).unionByName(numbered.select((F.col("__top") + F.col("__start") + F.col("__n")).cast(kind).alias(id_col), name_col))
