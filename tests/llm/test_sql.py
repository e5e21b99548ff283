import duckdb
import pytest

from vecshift.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    r = con.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(x[names.index(c)] for c in cols) for x in r.fetchall()), key=str)
    assert sorted((tuple(x[c] for c in cols) for x in df.collect()), key=str) == want
