"""Every registered match query against its DuckDB SQL on the smallest tables."""

import os
from glob import glob

import duckdb
import pytest

import __spark_entry__

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
NAMES = sorted(n for n in __spark_entry__.catalog.QUERIES if n not in ("glm_goals", "tree_factors"))  # trained in test_goal_models


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(values):
    return sorted((tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row) for row in values), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = rows_of(df.select(*cols).collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    order = [names.index(c) for c in cols]
    assert sorted(names) == cols
    assert got == rows_of([tuple(r[k] for k in order) for r in found.fetchall()])


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[0] == "competition_id"


@pytest.mark.parametrize("name", ["calibration_bins", "calibration_error"])
def test_calibration_reads_goals_only(spark, name):
    plan = __spark_entry__.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" in plan and "l_quantity" not in plan and "lambdafunction" not in plan
