"""The registered queries of this subpackage: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import bpe, chat, langid, mtree, packing, pii, quality, simhash, tokens, urls
from rankloom.llm.common import documents, table

#: Rules of op7_url_filter: (entry, action). An entry is a host, perhaps with a path; it covers the host's subdomains and the path's descendants.
URL_RULES = [
    ("spam-farm.example.org", "block"), ("cheap-pills.example.com", "block"), ("cheap-pills.example.com/en", "allow"),
    ("example.net", "allow"), ("blog.example.net", "block"), ("tiontion.example.net", "block"), ("tiontion.example.net/en", "allow"),
    ("blog.tionsh.example.com", "block"), ("blog.tionsh.example.com/de", "allow"), ("example.org/fr", "block"), ("www.ththon.example.org/fr", "allow"),
]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(documents(spark, sf_dir))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return mtree.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.segments(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_token_counts, op3_simhash_dedup, op4_byte_bpe, op5_pii_spans, op6_packing, op7_url_filter, op8_quality, op9_topk_search, op10_chat_format)
}
ORACLES: dict[str, str] = {"op6_packing": packing.SQL, "op7_url_filter": urls.sql(URL_RULES), "op9_topk_search": mtree.SQL, "op10_chat_format": chat.SQL}
