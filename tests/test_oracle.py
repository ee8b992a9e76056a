"""Every registered query of the forecasting side against its SQL."""

import glob
import os

import duckdb
import pytest

from weeklark.plans.oracle import ORACLE_SQL
from weeklark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def shown(v):
    return round(v, 3) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = sorted(str([shown(r[columns.index(c)]) for c in sorted(columns)]) for r in cursor.fetchall())
    ours = sorted(str([shown(r[c]) for c in sorted(columns)]) for r in df.collect())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
