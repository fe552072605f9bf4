import glob
import os

import duckdb
import pytest

from clausewright.plans import queries
from clausewright.plans.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    cursor = sql.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(str(tuple(dict(zip(names, r, strict=True))[c] for c in columns)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", ["article_index_max", "hit_projection", "relevance_stats", "chat_messages"])
def test_tasks_grow_with_the_rows(spark, monkeypatch, name):
    """More rows make more tasks, also where Spark would join small ones, and no more memory of one."""
    monkeypatch.setattr(queries, "DEALT", 100)
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert f", {-(-rows // 100)}), REPARTITION_BY_NUM" in plan


def test_report_decides_once(spark):
    plan = QUERIES["result_report"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
