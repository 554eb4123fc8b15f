"""Each query of the corpus operators that has SQL, against it in DuckDB."""

import duckdb
import pytest

from lattica.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def rows(columns, found):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = c.sql(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert want and rows(cols, got) == rows(cols, want)
