"""The registered queries against their SQL on the smallest tables, and the package without its training-data part."""

import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.plans.QUERIES)))
def test_query_against_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    r = db.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_training_data_part(tmp_path):
    for x in ("__spark_entry__.py", "rankloom"):
        src, dst = os.path.join(ROOT, x), tmp_path / x
        shutil.copytree(src, dst, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, dst)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'features_qd' in q and not any(k.startswith('op1') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def planned(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["qdoc_ctr", "features_qd", "unscored_share", "unscored_urls"])
def test_a_log_of_few_queries_is_not_dealt_out_by_query(spark, name):
    plan = planned(spark, name)
    assert "BroadcastHashJoin [query" in plan and not re.search(r"(SortMergeJoin|ShuffledHashJoin) \[query#\d+\]", plan)
