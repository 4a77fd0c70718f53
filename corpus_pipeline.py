"""The corpus pipeline: documents pass language identification, quality rules, near-duplicate removal and redaction, then packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import langid, packing, pii, quality, simhash
from rankloom.llm.common import documents, ensure_checkpoint_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the dictionaries tell apart; `lang` becomes that language. Null, empty and undecided texts go;
    repeated rows are judged one by one and alike, a tie between languages rejects; an empty table stays empty; further
    columns stay."""
    return langid.keep_identified(docs, langid.fit(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees, fitted on the labels of this stage's documents, hold for good; without usable labels all but
    null and empty texts. Repeated rows are judged alike; an empty table stays empty; further columns stay."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group of near duplicates; of repeated rows one; a null doc_id yields to any
    other. Null and empty texts stay; an empty table stays empty; further columns stay."""
    return simhash.keep_one(docs)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in `text` replaced by its kind and n_chars set anew. Null and clean texts stay as they are;
    repeated rows are treated alike; an empty table stays empty; further columns stay."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in the batches, null and blank texts as length 0; ties by doc_id, repeated rows keep a place
    each; an empty table gives an empty result; further columns, whatever their names, are ignored."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("PII", redaction), ("packing", packed)]

#: No stage but the last could be expressed in SQL (compression, trees, sketches, trained classifiers).
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next.

    A stage's table goes once the next one is written; the last one's once its documents are packed, as packing has then read
    them. What the operators checkpoint goes with the session if spark.cleaner.referenceTracking.cleanCheckpoints says so.

    Null and empty texts go in the first stage; of repeated rows, and of those alike but for some words, one stays; ties fall
    to the least doc_id. Columns beside those of documents pass through all stages but the last, whatever their names. An empty
    table gives an empty result.
    """
    docs = documents(spark, sf_dir)
    at = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            _drop(spark, f"{at}/{k - 1}")
    packed_docs = STAGES[-1][1](spark, docs, sf_dir)
    _drop(spark, at)
    return packed_docs
