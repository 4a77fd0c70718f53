"""The driver's tables as this library's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators.lineage import small
from rankloom.operators.similarity import number_on


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files a core below which a table's rows are dealt out anew.
SMALL = 4 << 20


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores, if its files are so few and small that the scan would leave most of them idle (one row group can't be
    split); larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click log (sid, query, geo, shown, clicked, ts): an order is a session, its lines the results, returned ones clicked."""
    lines, orders, customers = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = lines.select("l_orderkey", line.alias("p"), F.concat(F.lit("p"), F.col("l_partkey"), F.lit(".com")).alias("url"), (F.col("l_returnflag") == "R").alias("clk"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts"))
    rows = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("p", "url", "clk", "ts"))).alias("r"))
    who = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat_ws(" ", F.lower("c_mktsegment"), F.lower("o_orderpriority")).alias("query"), F.col("c_nationkey").alias("geo"))
    hits = F.sort_array(F.transform(F.filter("r", lambda x: x["clk"]), lambda x: F.struct(x["ts"].alias("ts"), x["p"].alias("p"), x["url"].alias("url"))))
    return rows.join(who, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("sid"), "query", "geo", F.transform("r", lambda x: x["url"]).alias("shown"), F.transform(hits, lambda x: x["url"]).alias("clicked"), F.transform("r", lambda x: x["ts"]).alias("ts")
    )


def query_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the log's queries numbered in order. Few queries (`small`) go to every task: dealt out by query, a log of
    few queries would lie on as few tasks."""
    segment, priority = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    q = load(spark, sf_dir, "lineitem").select("l_orderkey").distinct().join(priority, F.col("l_orderkey") == F.col("o_orderkey")).join(segment, F.col("o_custkey") == F.col("c_custkey"))
    q = q.select(F.concat_ws(" ", F.lower("c_mktsegment"), F.lower("o_orderpriority")).alias("query")).distinct()
    return small(number_on(q.select(F.lit(0).alias("query_id"), "query").limit(0), q, "query_id", "query"))


def url_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url_id, url) of all parts."""
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("url_id"), F.concat(F.lit("p"), F.col("p_partkey"), F.lit(".com")).alias("url"))


def marked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url_id, url, mark) of all parts."""
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("url_id"), F.concat(F.lit("p"), F.col("p_partkey"), F.lit(".com")).alias("url"), F.pmod("p_size", F.lit(3)).alias("mark"))


def known_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of the operators whose feature is to keep known queries: those whose priority is specified."""
    return query_dictionary(spark, sf_dir).where("query not like '%not specified'")


def known_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of the operators whose feature is to keep known URLs: those of parts of other types than SMALL."""
    return load(spark, sf_dir, "part").where("p_type <> 'SMALL'").select(F.col("p_partkey").alias("url_id"), F.concat(F.lit("p"), F.col("p_partkey"), F.lit(".com")).alias("url"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title, body): the title ends at the first line break or full stop; the body is the whole text."""
    return dealt(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.regexp_extract("text", r"^[^\n.]*", 0).alias("title"), F.col("text").alias("body"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, tokens, synonyms): every benchmark item's words, and once more those of more than seven letters."""
    w = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.tokenize(F.col("text")).alias("tokens"))
    return w.select("query_id", "tokens", F.filter("tokens", lambda x: F.char_length(x) > 7).alias("synonyms"))


def log_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, url_id, mark) of every query-URL pair that the log shows or has clicked, once."""
    queries, urls = query_dictionary(spark, sf_dir), marked_urls(spark, sf_dir)
    found = sessions(spark, sf_dir).select("query", F.explode(F.concat("shown", "clicked")).alias("url")).distinct()
    return found.join(queries, "query").join(urls, "url").select("query_id", "url_id", "mark")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (src, dst): suppliers link to parts of returned lines, parts to suppliers of accepted ones."""
    lines = load(spark, sf_dir, "lineitem").where("l_returnflag in ('R', 'A')")
    s, p = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey"))
    back = F.col("l_returnflag") == "A"
    return lines.select(F.when(back, p).otherwise(s).alias("src"), F.when(back, s).otherwise(p).alias("dst")).distinct()
