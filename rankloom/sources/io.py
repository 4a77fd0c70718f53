"""Readers and sinks of the text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as X


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one or many files, compressed or not by extension; names that start with _ are skipped."""
    return spark.read.text(path)


def parse_log(lines: DataFrame, urls: DataFrame | None = None, keep_corrupt: bool = False) -> DataFrame:
    """(query, geo, shown, clicked, ts) of lines 'query@geo TAB shown TAB clicked TAB times', lists by comma.

    The query ends at the last @. A line of fewer than four fields (a trailing empty field counts as there), without @, or with
    a bad number is corrupt: dropped, or with keep_corrupt marked in `_corrupt`. urls (url): keep only these in both lists.
    """
    f = F.split("value", "\t")
    head = F.try_element_at(f, F.lit(1))
    field = lambda k: F.coalesce(F.try_element_at(f, F.lit(k)), F.lit(""))
    times = X.string_to_list(field(4), ",")
    longs = F.transform(times, lambda t: F.trim(t).try_cast("bigint"))
    geo = F.substring_index(head, "@", -1).try_cast("int")
    corrupt = (F.size(f) < 3) | (F.instr(head, "@") == 0) | geo.isNull() | F.exists(longs, lambda t: t.isNull())
    query = F.regexp_extract(head, r"(?s)^(.*)@[^@]*$", 1)
    out = lines.select(X.prepare_query(query).alias("query"), geo.alias("geo"), X.parse_links(field(2)).alias("shown"), X.parse_links(field(3)).alias("clicked"), longs.alias("ts"), F.coalesce(corrupt, F.lit(True)).alias("_corrupt"))
    out = out if keep_corrupt else out.where("not _corrupt").drop("_corrupt")
    return out if urls is None else keep_urls(out, urls)


def read_log(spark: SparkSession, path: str, urls: DataFrame | None = None, keep_corrupt: bool = False) -> DataFrame:
    return parse_log(read_lines(spark, path), urls, keep_corrupt)


def keep_urls(log: DataFrame, urls: DataFrame) -> DataFrame:
    """The log with only the known URLs in shown and clicked, order kept."""
    log = log.withColumn("__row", F.monotonically_increasing_id()) if "sid" not in log.columns else log.withColumn("__row", F.col("sid"))
    part = lambda k: log.select("__row", F.lit(k).alias("k"), F.posexplode(k).alias("p", "url"))
    kept = part("shown").unionByName(part("clicked")).join(urls.select("url").distinct(), "url", "left_semi")
    lists = kept.groupBy("__row").agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("k") == k, F.struct("p", "url")))), lambda s: s["url"]).alias(f"__{k}") for k in ("shown", "clicked")])
    none = F.array().cast("array<string>")
    out = log.join(lists, "__row", "left")
    for k in ("shown", "clicked"):
        out = out.withColumn(k, F.coalesce(F.col(f"__{k}"), none))
    return out.drop("__row", "__shown", "__clicked")


def log_lines(log: DataFrame) -> DataFrame:
    """The log as lines, tabs between all four fields."""
    return log.select(F.concat_ws("\t", F.concat_ws("@", "query", "geo"), F.array_join("shown", ","), F.array_join("clicked", ","), F.array_join(F.transform("ts", lambda t: t.cast("string")), ",")).alias("value"))


def read_dictionary(spark: SparkSession, path: str, is_query: bool, normalise: bool = True) -> DataFrame:
    """(id, name) of lines 'id TAB name', the name normalised as queries or URLs are; of one name's ids that of the last line stands, in order of file name."""
    f = F.split("value", "\t")
    name = F.try_element_at(f, F.lit(2))
    if normalise:
        name = X.prepare_query(name) if is_query else X.prepare_url(name)
    line = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = read_lines(spark, path).select(F.try_element_at(f, F.lit(1)).try_cast("int").alias("id"), name.alias("name"), line.alias("line"))
    return rows.where("id is not null and name is not null").groupBy("name").agg(F.max_by("id", "line").alias("id")).select("id", "name")


def read_train_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="query_id int, url_id int, mark int", mode="DROPMALFORMED")


def read_test_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs to be ranked; their mark is -1."""
    return spark.read.csv(path, header=True, schema="query_id int, url_id int", mode="DROPMALFORMED", enforceSchema=True).withColumn("mark", F.lit(-1))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", quote="", schema="doc_id int, title string, body string")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text, synonyms), synonyms null where absent."""
    return spark.read.csv(path, sep="\t", quote="", schema="query_id int, text string, synonyms string")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, html) of lines 'id TAB base64 of zlib data'."""
    return spark.read.csv(path, sep="\t", quote="", schema="doc_id int, payload string").select("doc_id", X.inflate(F.col("payload")).alias("html"))


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    return sorted({r[0].strip() for r in read_lines(spark, path).distinct().collect()} - {""})


def tagged_union(**sources: DataFrame) -> DataFrame:
    """Rows of several inputs with the name of their source in `source`; columns that one lacks are null."""
    out = None
    for name, df in sources.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def counted(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """df with counters observed while it runs; read them by .get afterwards."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in counters.items()]), seen


def write_lines(df: DataFrame, path: str, compression: str | None = None, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").text(path, compression=compression)


def write_groups(groups: dict[str, DataFrame], path: str, compression: str | None = None) -> None:
    """One folder of lines for each named group."""
    for name, df in groups.items():
        write_lines(df, f"{path}/{name}", compression)


def write_feature_names(features: dict[str, DataFrame], path: str, keys: tuple[str, ...] = ("query", "url", "query_id", "url_id", "mark")) -> None:
    """The names of each grain's features, one a line in order of columns, in the folder FeatureNames/<grain>."""
    for name, df in features.items():
        names = [c for c in df.columns if c not in keys]
        rows = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(names)], "i int, value string")
        write_lines(rows.coalesce(1).sortWithinPartitions("i").select("value"), f"{path}/FeatureNames/{name}", single=True)


def write_table(df: DataFrame, path: str, header: bool = False, sep: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, header=header, sep=sep)


def write_submission(ranked: DataFrame, path: str) -> None:
    """QueryId,DocumentId in order of query and rank."""
    rows = ranked.orderBy("query_id", "rank").select(F.col("query_id").alias("QueryId"), F.col("url_id").alias("DocumentId"))
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def sparse_text(names: list[str], offset: int = 0) -> Column:
    """'index:value' of the columns that aren't null, by space."""
    return F.concat_ws(" ", *[F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{i + offset}:"), F.col(n).cast("string"))) for i, n in enumerate(names)])


def libsvm_lines(df: DataFrame, names: list[str]) -> DataFrame:
    """'url_id TAB mark qid:query_id index:value ...'."""
    head = F.concat(F.col("url_id"), F.lit("\t"), F.col("mark"), F.lit(" qid:"), F.col("query_id"))
    return df.select(F.concat_ws(" ", head, F.when(sparse_text(names) != "", sparse_text(names))).alias("value"))


def parse_libsvm(lines: DataFrame, names: list[str]) -> DataFrame:
    """(url_id, mark, query_id, one column a feature) of such lines; a line that names an index twice is dropped."""
    f = F.split("value", r"[\t ]+")
    cells = F.transform(F.slice(f, F.lit(4), F.greatest(F.size(f) - 3, F.lit(0))), lambda x: F.split(x, ":"))
    index = F.transform(cells, lambda x: x[0].cast("int"))
    rows = lines.where(F.size(F.array_distinct(index)) == F.size(index))
    values = F.map_from_arrays(index, F.transform(cells, lambda x: x[1].cast("double")))
    rows = rows.select(f[0].cast("int").alias("url_id"), f[1].cast("int").alias("mark"), F.substring_index(f[2], ":", -1).cast("int").alias("query_id"), values.alias("v"))
    return rows.select("url_id", "mark", "query_id", *[F.try_element_at("v", F.lit(i)).alias(n) for i, n in enumerate(names)])
