"""Queries beside their SQL, on a small table of the driver where there is one."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_queries_equal_their_sql(spark):
    import duckdb

    from meshspark.llm import queries, sql

    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, text in sql.oracle_sql().items():
        want = con.execute(text)
        columns = sorted(d[0] for d in want.description)
        order = [[d[0] for d in want.description].index(c) for c in columns]
        want = sorted(tuple(r[i] for i in order) for r in want.fetchall())
        got = queries.queries()[name](spark, SF)
        assert sorted(got.columns) == columns, name
        got = sorted(map(tuple, got.select(*columns).collect()))
        assert len(got) == len(want), name
        for g, w in zip(got, want):
            assert all(math.isclose(a, b, rel_tol=1e-12) if isinstance(a, float) else a == b for a, b in zip(g, w)), (name, g, w)
