"""Queries of this subpackage against their SQL."""

import glob
import os

import duckdb
import pytest

from weeklark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in sorted(columns)]) for r in df.collect()) == theirs
