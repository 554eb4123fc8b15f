"""Each registered query against its SQL in DuckDB."""

import duckdb
import pytest

from lattica.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(rows):
    return sorted(([round(x, 6) if isinstance(x, float) else x for x in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = norm(df.select(*cols).collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    want = norm(duck.sql(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall())
    assert len(got) == len(want) and got == want
