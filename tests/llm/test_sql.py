"""The registered queries of the training-data part on the smallest tables: against their SQL, or for what must hold."""

import os

import duckdb
import pytest

from rankloom.llm import packing, queries
from tests.test_entry import SF, TABLES, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    r = con.execute(queries.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op1_language_id", "op2_token_counts", "op4_byte_bpe", "op8_quality"])
def test_a_row_for_each_document(spark, name):
    got = sorted(r.doc_id for r in queries.QUERIES[name](spark, SF).select("doc_id").collect())
    assert got == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_packing_against_sql_with_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "  \n\t"), (3, "a b c"), (3, "a b c"), (4, "a b d"), (None, "x y z"), (5, "w " * 40_000), (6, "one"), (7, "a\x0bb c")]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    df = packing.pack(spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id bigint, text string, n_tokens int, bucket string"))
    order = ["doc_id", "n_tokens", "bucket", "bucket_len", "batch_id", "slot", "padding"]
    assert df.columns == order
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.execute(packing.SQL).fetchall()))
    con.execute("delete from documents")
    assert con.execute(packing.SQL).fetchall() == []
