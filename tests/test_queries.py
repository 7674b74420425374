"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (sorted(map(str, x[cols].itertuples(index=False, name=None))) for x in (got, want.astype(got.dtypes.to_dict())))
    assert a == b


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_flagship_plan_shuffles_only_the_best_few(spark):
    """Each task reduces its references to a query's best few before the exchange: no product, no sort of references."""
    df = catalog.QUERIES["exact_knn5_embeddings"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and plan.count("Exchange hashpartitioning(qid") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stream_scores_every_event(spark, duck):
    """One score for each row of the table, by the query and by its SQL."""
    events = sorted(duck.sql("SELECT event_id FROM events").fetchall())
    assert sorted((r.qid,) for r in catalog.QUERIES["stream_score"](spark, SF).select("qid").collect()) == events
    assert sorted(duck.sql(f"SELECT qid FROM ({catalog.ORACLE_SQL['stream_score']})").fetchall()) == events
