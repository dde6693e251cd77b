"""Every query with SQL against DuckDB on the given tables, and the others for their shape."""

import importlib
import os

import pytest

from paychain.jobs import queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
#: Each fits models for a good part of a minute; the driver and bench.py run them.
SLOW = {"kmeans_fit_invariants", "cluster_scored", "same_project_cluster", "new_project_cluster", "kmodes_huang", "classify_kkt"}


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def same(df, con, sql):
    told = con.execute(sql)
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted(repr([row[names.index(n)] for n in sorted(names)]) for row in told.fetchall())
    assert sorted(repr([row[n] for n in sorted(names)]) for row in df.collect()) == theirs


@pytest.mark.parametrize("name", [n for n in queries.ORACLE_SQL if n not in SLOW])
def test_against_sql(name, spark, con):
    same(queries.QUERIES[name](spark, SF), con, queries.ORACLE_SQL[name])


def test_entry_has_all_queries():
    entry = importlib.import_module("__spark_entry__")
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_held_out_rows_get_decision_values(spark):
    rows = queries.ovr_scores(spark, SF).collect()
    assert rows and all(r["predict_index"] == 1 + max(range(3), key=lambda k: r[f"m{k + 1}"]) for r in rows)
